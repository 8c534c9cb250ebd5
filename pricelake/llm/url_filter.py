"""URL filters by dated lists: a capture is judged by the entries active when it was fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pricelake.runtime import written


def host_of(url):
    """Host of a URL in lower case, without user, port, a leading ``www.`` and a final dot; NULL where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:\\]+)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", "")
    return F.when(F.length(host) > 0, host)


def validity(entries: DataFrame) -> DataFrame:
    """Intervals (pattern, action, valid_from, valid_to) of dated entries (pattern, action, changed_at).

    An entry holds until the next one of its pattern, the last one for ever;
    action ``remove`` ends the one before.  Of entries of the same moment
    ``allow`` counts before ``block`` before ``remove``.
    """
    entries = entries.where("pattern IS NOT NULL AND changed_at IS NOT NULL AND action IN ('allow', 'block', 'remove')")
    one = entries.groupBy(F.lower("pattern").alias("pattern"), "changed_at").agg(F.min("action").alias("action"))
    following = F.lead("changed_at").over(Window.partitionBy("pattern").orderBy("changed_at"))
    spans = one.select("pattern", "action", F.col("changed_at").alias("valid_from"), following.alias("valid_to"))
    return spans.where("action <> 'remove'")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """``captures`` with host, matched_pattern, listed_since, action and kept.

    A pattern names a host and all hosts under it.  Of the patterns active at
    the time of the fetch the longest decides; without one the action is
    ``none``.  Captures with action ``block`` are not kept.

    Captures are first summed up to distinct (host, time); only those meet the
    intervals, by an equality of pattern and name and a range of time, so a
    host with a third of all captures is looked up once for each moment.

    Cases: a URL without a host, a NULL URL or a NULL time matches nothing and
    is kept; an interval includes its start and not its end; extra columns of
    captures are returned (but for ones named like a result), those of entries
    ignored; repeated captures all stay; an empty list keeps everything.
    """
    named = captures.withColumns({"_host": host_of(F.col(url)), "_moment": F.col(fetched)})
    moments = named.where("_host IS NOT NULL AND _moment IS NOT NULL").select("_host", "_moment").distinct()
    moments = written(moments, "moments")
    labels = F.split("_host", r"\.")
    # every name above a host, down to the host itself
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    names = moments.select("_host").distinct().select("_host", F.explode(suffixes).alias("pattern"))
    rules = names.join(validity(entries), "pattern")
    active = moments.join(rules, "_host").where("_moment >= valid_from AND (valid_to IS NULL OR _moment < valid_to)")
    best = active.groupBy("_host", "_moment").agg(
        F.max(F.struct(F.length("pattern").alias("n"), "pattern", "valid_from", "action")).alias("_rule")
    )
    found = named.join(best, ["_host", "_moment"], "left")
    action = F.coalesce("_rule.action", F.lit("none"))
    new = {
        "host": F.col("_host"),
        "matched_pattern": F.col("_rule.pattern"),
        "listed_since": F.col("_rule.valid_from"),
        "action": action,
        "kept": action != "block",
    }
    return found.select(*[F.col(c) for c in captures.columns if c not in new], *[v.alias(k) for k, v in new.items()])
