"""Conversations put in reply order by what their messages quote."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pricelake.llm import ranks
from pricelake.runtime import written

MARK = re.compile(r"^(?:\s{0,3}>)+")
#: Turns that are ordered together.
SPAN = 1000


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The text without quoted lines, and its quoted passages with their nesting level.

    A line's level is the number of ``>`` before it; lines of one level that
    follow each other are a passage.
    """
    own, passages, level = [], [], 0
    for line in (text or "").split("\n"):
        mark = MARK.match(line)
        depth = mark.group().count(">") if mark else 0
        if not depth:
            own.append(line)
        elif depth == level:
            passages[-1][1].append(line[mark.end() :])
        else:
            passages.append((depth, [line[mark.end() :]]))
        level = depth
    return "\n".join(own).strip("\n"), [(d, "\n".join(p)) for d, p in passages]


def normalised(passage: str) -> str:
    """Lower case, one space for white space: line breaks and indents of quoting clients don't matter."""
    return " ".join(passage.lower().split())


def _hash(passage: str) -> int | None:
    words = normalised(passage)
    return int.from_bytes(hashlib.blake2b(words.encode(), digest_size=8).digest(), "big", signed=True) if words else None


def _parts(passage: str) -> set[int]:
    """Hashes by which a passage may be found: the whole, and each of its lines."""
    return {h for h in (_hash(passage), *map(_hash, passage.split("\n"))) if h is not None}


def _asked(passages: list[tuple[int, str]]) -> list[dict]:
    """What quoted passages are looked up by: the whole, with its number of lines, and each line of a longer one."""
    found = set()
    for level, passage in passages:
        whole, lines = _hash(passage), {h for h in map(_hash, passage.split("\n")) if h is not None}
        if whole is not None:
            found.add((level, whole, True, len(lines)))
            found |= {(level, h, False, 1) for h in lines - {whole}}
    return [dict(zip(("level", "hash", "whole", "lines"), f)) for f in sorted(found)]


def reply_order(
    messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """A row per message: conversation, position, turn, parent_turn, root_turn, quotes, role, text (without quotes).

    Every quoted passage is hashed whole and by lines, after white space and
    case are made alike, and joined to the earlier messages of its
    conversation that say it unquoted.  A message replies to the one that its
    least nested linked quote names; of several to one that says a passage
    whole, then to the one with most of the lines, then to the latest.  Lines
    are counted in every earlier message, so messages that quote a line often
    said, and no passage whole, meet each message that says it.  A message
    that quotes nothing known replies to the turn before it only where it
    quotes nothing at all, otherwise it starts a thread.  Threads follow each
    other by their first turn, and inside a thread every message comes after
    the one it replies to.

    Cases: a NULL or empty text quotes nothing and stays as an empty message;
    a quote of a later or of no message is dropped without a link; a row with
    a NULL conversation or turn is a conversation of its own (position 0, no
    parent, its turn as the root); rows of one conversation and turn are
    messages that follow each other in an order that their text and role
    decide, so none is lost; extra columns are ignored.  A conversation of any
    length is ordered by ranges of turns.
    """

    def run(batches):
        for batch in batches:
            found = [parse(t) for t in batch.column("text").to_pylist()]
            said = [sorted(_parts(own)) for own, _ in found]
            quoted = [_asked(passages) for _, passages in found]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(k) for k in ("conv", "turn", "role")],
                    pa.array([own for own, _ in found], pa.string()),
                    pa.array([len(p) for _, p in found], pa.int32()),
                    pa.array(said, pa.list_(pa.int64())),
                    pa.array(quoted, pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("whole", pa.bool_()), ("lines", pa.int32())]))),
                ],
                names=["conv", "turn", "role", "text", "quotes", "said", "quoted"],
            )

    plain = messages.select(
        F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).alias("text")
    )
    alone = plain.where("conv IS NULL OR turn IS NULL")
    plain = plain.where("conv IS NOT NULL AND turn IS NOT NULL")
    # messages of one turn are told apart by turns of their own between it and the next
    most = plain.groupBy("conv", "turn").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    if most > 1:
        cells = F.pmod(F.xxhash64("text", "role"), F.lit(1 << 16))
        plain = ranks.positions(plain, cells, [F.col("text"), F.col("role")], "nth", ["conv", "turn"])
        plain = plain.withColumn("turn", F.col("turn") * most + F.col("nth")).drop("nth")
    real = lambda name: F.expr(f"({name} - pmod({name}, {most})) div {most}").alias(name)
    kind = plain.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, turn long, role string, text string, quotes int, said array<long>, quoted array<struct<level: int, hash: long, whole: boolean, lines: int>>"
    parsed = written(plain.mapInArrow(run, schema), "messages")
    quoted = parsed.where("quotes > 0").select("conv", "turn", F.explode("quoted").alias("q"))
    quoted = quoted.select("conv", "turn", "q.*")
    said = parsed.select("conv", "turn", F.explode("said").alias("hash"))
    said = said.join(quoted.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")
    best = F.max(F.struct((-F.col("level")).alias("near"), "n", "source")).alias("best")
    of_one = lambda hits: hits.groupBy("conv", "turn", "level", "source").agg(F.sum("lines").alias("n")).groupBy("conv", "turn").agg(best)
    wholes = latest_before(quoted.where("whole").drop("whole"), said, ["conv", "hash"])
    wholes = written(of_one(wholes).select("conv", "turn", "best"), "wholes")
    # lines count where no passage as near is said whole
    lines = quoted.where("NOT whole").join(wholes.select("conv", "turn", F.col("best.near").alias("near")), ["conv", "turn"], "left")
    lines = lines.where("near IS NULL OR level < -near").select("conv", "turn", "level", "hash", "lines")
    hits = lines.join(said.select("conv", "hash", F.col("turn").alias("source")), ["conv", "hash"]).where("source < turn")
    parents = (
        wholes.withColumn("whole", F.lit(True))
        .unionByName(of_one(hits).withColumn("whole", F.lit(False)))
        .groupBy("conv", "turn")
        .agg(F.max(F.struct("best.near", "whole", "best.n", "best.source")).alias("best"))
        .select("conv", "turn", F.col("best.source").alias("linked"))
    )
    turns = parsed.select("conv", "turn")
    before = latest_before(turns, turns, ["conv"]).withColumnRenamed("source", "before")
    parent = F.when(F.col("quotes") > 0, F.col("linked")).otherwise(F.col("before"))
    tied = parsed.drop("said", "quoted").join(parents, ["conv", "turn"], "left").join(before, ["conv", "turn"], "left")
    tied = written(tied.withColumn("parent_turn", parent).drop("linked", "before"), "replies")
    roots = roots_of(tied.where("parent_turn IS NOT NULL").select("conv", "turn", F.col("parent_turn").alias("up")))
    threads = tied.join(roots, ["conv", "turn"], "left").withColumn("root_turn", F.coalesce("root", "turn")).drop("root")
    ordered = _in_order(written(threads, "threads")).select(
        "conv", "position", *[real(c) for c in ("turn", "parent_turn", "root_turn")], "quotes", "role", "text"
    )
    none = F.lit(None).cast("long")
    loose = alone.mapInArrow(run, schema).select(
        "conv", F.lit(0).cast("long").alias("position"), "turn", none.alias("parent_turn"), F.col("turn").alias("root_turn"), "quotes", "role", "text"
    )
    names = [conversation, "position", turn, "parent_turn", "root_turn", "quotes", role, text]
    return ordered.unionByName(loose).toDF(*names)


def roots_of(ups: DataFrame) -> DataFrame:
    """(conv, turn, root) for messages with a turn ``up`` that they reply to.

    Every round a message that is on its way takes over the ``up`` of its own
    ``up``, so the way left is halved, and one that arrives is set aside: rows
    never multiply, few threads need more than a few rounds, and the rounds
    follow the logarithm of the longest thread.
    """
    moving, done = written(ups.select("conv", "turn", "up"), "ups"), None
    while True:
        known = moving.withColumn("arrived", F.lit(False))
        if done is not None:
            known = known.unionByName(done.select("conv", "turn", F.col("root").alias("up"), F.lit(True).alias("arrived")))
        further = known.select("conv", F.col("turn").alias("up"), F.col("up").alias("next"), "arrived")
        moved = written(moving.join(further, ["conv", "up"], "left"), "ups")
        there = moved.where("next IS NULL OR arrived").select("conv", "turn", F.coalesce("next", "up").alias("root"))
        done = there if done is None else done.unionByName(there)
        moving = moved.where("next IS NOT NULL AND NOT arrived").select("conv", "turn", F.col("next").alias("up"))
        if moving.isEmpty():
            return done


def latest_before(asking: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``asking`` that have an earlier turn of ``sources`` with the same keys, with the latest such turn as ``source``.

    Turns are compared inside ranges; ranges are compared by the latest source
    in each, so no task takes all turns of a key.
    """
    rows = asking.withColumns({"source": F.lit(None).cast("long"), "kind": F.lit(0)}).unionByName(
        sources.withColumns({"source": F.col("turn"), "kind": F.lit(1)}), allowMissingColumns=True
    )
    rows = rows.withColumn("range", F.floor(F.col("turn") / SPAN))
    inside = Window.partitionBy(*keys, "range").orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ranges = rows.groupBy(*keys, "range").agg(F.max("source").alias("top"))
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*keys, "range", F.last("top", ignorenulls=True).over(earlier).alias("earlier"))
    found = rows.withColumn("inside", F.last("source", ignorenulls=True).over(inside)).where("kind = 0")
    found = found.join(ranges, [*keys, "range"]).withColumn("source", F.coalesce("inside", "earlier"))
    return found.where("source IS NOT NULL").select(*asking.columns, "source")


def _in_order(threads: DataFrame) -> DataFrame:
    """``threads`` with ``position`` in the order of root_turn, then turn, of each conversation."""
    sizes = threads.groupBy("conv", "root_turn").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("range", F.floor(F.col("root_turn") / SPAN))
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.groupBy("conv", "range").agg(F.sum("n").alias("n"))
    ranges = ranges.select("conv", "range", ahead(Window.partitionBy("conv").orderBy("range")).alias("before"))
    starts = sizes.withColumn("inside", ahead(Window.partitionBy("conv", "range").orderBy("root_turn")))
    starts = starts.join(ranges, ["conv", "range"]).select("conv", "root_turn", (F.col("before") + F.col("inside")).alias("first"))
    nth = ranks.positions(threads, F.floor(F.col("turn") / SPAN), [F.col("turn")], "nth", ["conv", "root_turn"])
    return nth.join(starts, ["conv", "root_turn"]).withColumn("position", F.col("first") + F.col("nth"))
