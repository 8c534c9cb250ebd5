"""Registered queries of the operators and their SQL."""

from __future__ import annotations

import json

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricelake.llm import collocations, decontaminate, exact_dedup, licenses, manifest, near_dedup, packing, ppm, quality, quotes, shards, url_filter, wrappers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hyperminhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, share=85, whole=100)


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts of ``pages`` and the domains above them: added, excepted and removed on days of 2024."""
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    above = hosts.select(F.regexp_replace("host", r"^[^.]+\.", "").alias("host")).where("host LIKE '%.%'")
    names = hosts.union(above).distinct()
    day = lambda salt, span: F.pmod(F.conv(F.substring(F.md5(F.concat("host", F.lit(salt))), 1, 7), 16, 10).cast("long"), F.lit(span)).cast("int")
    entries = [
        ("block", day("a", 200)),
        ("remove", day("a", 200) + 30 + day("b", 60)),
        ("allow", day("c", 300)),
        ("block", day("d", 360)),
    ]
    start = F.lit("2024-01-01").cast("date")
    return names.select(
        F.col("host").alias("pattern"),
        F.explode(F.array(*[F.struct(F.lit(a).alias("action"), F.date_add(start, d).alias("changed_at")) for a, d in entries])).alias("e"),
    ).select("pattern", "e.action", "e.changed_at")


def op2_temporal_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")
    captures = pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), day))
    return url_filter.judge(captures, list_entries(pages))


def op3_stratified_shards(spark, sf_dir):
    return shards.stratified_shards(table(spark, sf_dir, "documents"))


def op4_extendible_hash_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json")) as file:
        added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added)


def op5_harmonic_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))


def op6_cgk_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def quoting(conversations: DataFrame) -> DataFrame:
    """``conversations`` as mails: every turn but the first quotes, before its own text, the turn before it or the one before that.

    Lines of the quoted turn are marked with one sign; the table itself holds
    no quotes.  The turn that is quoted follows from conversation and turn.
    """
    back = F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)) == 0, 2).otherwise(1)
    asked = conversations.withColumn("quoted_turn", F.when(F.col("turn") >= back, F.col("turn") - back))
    said = conversations.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("text").alias("quoted"))
    both = asked.join(said, (F.col("conv_id") == F.col("c")) & (F.col("quoted_turn") == F.col("t")), "left")
    quote = F.concat(F.lit("> "), F.regexp_replace("quoted", "\n", "\n> "), F.lit("\n\n"))
    return both.select("conv_id", "turn", "role", F.concat(F.coalesce(quote, F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))


def op7_quotation_linking(spark, sf_dir):
    return quotes.reply_order(quoting(table(spark, sf_dir, "conversations")))


def op8_ppm_scores(spark, sf_dir):
    return ppm.score(table(spark, sf_dir, "documents"))


def op9_subword_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_wrapper_extraction(spark, sf_dir):
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op11_signature_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op12_merkle_manifest(spark, sf_dir):
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    return manifest.manifest(
        table(spark, sf_dir, "documents"), changed=changed, changes={"n_chars": F.col("n_chars") + F.lit(1)}
    )


def op13_suffix_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_hyperminhash_near_dedup,
        op2_temporal_url_filter,
        op3_stratified_shards,
        op4_extendible_hash_dedup,
        op5_harmonic_packing,
        op6_cgk_decontamination,
        op7_quotation_linking,
        op8_ppm_scores,
        op9_subword_quality,
        op10_wrapper_extraction,
        op11_signature_licenses,
        op12_merkle_manifest,
        op13_suffix_collocations,
        pipeline,
    )
}

_OP1 = r"""
with recursive lowered as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents
), sets as (
    select doc_id, case
        when len(w) = 0 then []
        when len(w) < 3 then [array_to_string(w, ' ')]
        else list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])
    end as s
    from lowered
), classes as (
    select min(doc_id) as node, list_sort(s) as s, len(s) as n from sets where len(s) > 0 group by 2, 3
), shingles as (
    select node, n, unnest(s) as h from classes
), near as (
    select a.node as a, b.node as b
    from shingles a join shingles b on a.h = b.h and a.node < b.node and 100 * a.n >= 85 * b.n and 100 * b.n >= 85 * a.n
    group by a.node, b.node, a.n, b.n
    having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), links as (
    select a, b from near union all select b, a from near
), reach as (
    select node, node as root from classes
    union
    select links.b, reach.root from reach join links on links.a = reach.node
), named as (
    select node, min(root) as root from reach group by node
)
select sets.doc_id, cast(len(sets.s) as bigint) as n_shingles, coalesce(named.root, sets.doc_id) as component_id,
    coalesce(named.root, sets.doc_id) = sets.doc_id as kept
from sets
left join classes on len(sets.s) > 0 and list_sort(sets.s) = classes.s
left join named using (node)
"""

_HOST = r"""regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.$', ''), '^www\.', '')"""

_OP2 = rf"""
with captures as (
    select page_id, url, date '2024-01-01' + cast((page_id * 37) % 366 as integer) as fetched_at, nullif({_HOST}, '') as host from pages
), hosts as (
    select distinct host from captures where host is not null
), names as (
    select host from hosts union select regexp_replace(host, '^[^.]+\.', '') from hosts where regexp_replace(host, '^[^.]+\.', '') like '%.%'
), days as (
    select host as pattern,
        cast(('0x' || substr(md5(host || 'a'), 1, 7)) as bigint) % 200 as a,
        cast(('0x' || substr(md5(host || 'b'), 1, 7)) as bigint) % 60 as b,
        cast(('0x' || substr(md5(host || 'c'), 1, 7)) as bigint) % 300 as c,
        cast(('0x' || substr(md5(host || 'd'), 1, 7)) as bigint) % 360 as d
    from names
), entries as (
    select pattern, 'block' as action, a as day from days
    union all select pattern, 'remove', a + 30 + b from days
    union all select pattern, 'allow', c from days
    union all select pattern, 'block', d from days
), one as (
    select pattern, date '2024-01-01' + cast(day as integer) as valid_from, min(action) as action from entries group by all
), spans as (
    select pattern, action, valid_from, lead(valid_from) over (partition by pattern order by valid_from) as valid_to from one
), found as (
    select page_id, fetched_at, pattern, valid_from, action,
        row_number() over (partition by page_id order by length(pattern) desc) as nth
    from captures join spans on (host = pattern or host like '%.' || pattern)
    where action <> 'remove' and fetched_at >= valid_from and (valid_to is null or fetched_at < valid_to)
)
select captures.page_id, captures.url, captures.fetched_at, captures.host, found.pattern as matched_pattern,
    found.valid_from as listed_since, coalesce(found.action, 'none') as action, coalesce(found.action, 'none') <> 'block' as kept
from captures left join found on captures.page_id = found.page_id and nth = 1
"""

_OP4 = """
with texts as (select doc_id, coalesce(text, '') as text from documents),
same as (select text, max(doc_id) as keep_id, count(*) as group_size from texts group by text)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(text) as text_sha256 from texts join same using (text)
"""

#: Which turn is quoted follows from the rule of ``quoting``; that the links find it is what is compared.
_OP7 = """
with asked as (
    select *, case when (conv_id + turn) % 3 = 0 then 2 else 1 end as back from conversations
)
select conv_id, row_number() over (partition by conv_id order by turn) - 1 as position, turn,
    case when turn >= back then turn - back when turn > 0 then turn - 1 end as parent_turn,
    min(turn) over (partition by conv_id) as root_turn, cast(turn >= back as integer) as quotes, role,
    trim(coalesce(text, ''), chr(10)) as text
from asked
"""

#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(4294967295, list_reduce([4294967295::bigint] || [ascii(x)::bigint for x in string_split(cast(doc_id as varchar), '')],
    lambda c, b: list_reduce([xor(c, b)] || [x::bigint for x in range(8)],
        lambda a, y: xor(a >> 1, case when a & 1 = 1 then 3988292384 else 0 end))))"""


def _told(value: str) -> str:
    return f"coalesce(strlen(cast({value} as varchar)) || ':' || cast({value} as varchar), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_told, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


_OP12 = f"""
with recursive leaves as (
    select row_number() over () as k, doc_id, lang, {_leaf('n_chars')} as leaf, {_leaf('n_chars + 1')} as other,
        coalesce({_CRC} % 7 = 0, false) as changed
    from documents
), placed as (
    select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from leaves
), tree as (
    select lang, 0 as level, i, n, leaf as h from placed
    union all
    select lang, level + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' order by i)) from tree where n > 1 group by lang, level, i // 2
), subroots as (
    select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from tree where n = 1
), tops as (
    select 0 as level, i, n, subroot as h from subroots
    union all
    select level + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' order by i)) from tops where n > 1 group by level, i // 2
), inner_steps as (
    select k, t.level, t.n, s.i as si, p.i >> t.level as own, s.h
    from placed p join (select distinct lang, level, n from tree where n > 1) t on t.lang is not distinct from p.lang
    left join tree s on s.lang is not distinct from p.lang and s.level = t.level and s.i = xor(p.i >> t.level, 1)
), outer_steps as (
    select k, 1000 + t.level as level, t.n, s.i as si, r.i >> t.level as own, s.h
    from placed p join subroots r on r.lang is not distinct from p.lang
    join (select distinct level, n from tops where n > 1) t on true
    left join tops s on s.level = t.level and s.i = xor(r.i >> t.level, 1)
), steps as (
    select k, list(case when h is null then 'N' when si < own then 'L' || h else 'R' || h end order by level) as steps
    from (select * from inner_steps union all select * from outer_steps) group by k
), folded as (
    select p.*, r.subroot, (select h from tops where n = 1) as root, coalesce(steps, []) as steps,
        list_reduce([case when changed then coalesce(other, leaf) else leaf end] || coalesce(steps, []),
            lambda a, s: sha256(case s[1] when 'N' then a when 'L' then s[2:] || a else a || s[2:] end)) as folded_root
    from placed p join subroots r on r.lang is not distinct from p.lang left join steps using (k)
)
select doc_id, leaf, subroot, root, sha256(coalesce(array_to_string([s[2:] for s in steps if s <> 'N'], ''), '')) as proof_sha256,
    folded_root, folded_root = root as verified
from folded
"""

_OP13 = r"""
with pieces as (
    select coalesce(lang, 'und') as lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), worded as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), grams as (
    select lang, size, unnest([w[i : i + size - 1] for i in range(1, len(w) - size + 2)]) as w
    from worded, (select unnest(range(1, 6)) as size) where len(w) >= size
), counts as (
    select lang, size, w, array_to_string(w, ' ') as phrase, count(*) as n from grams group by lang, size, w
), totals as (
    select lang, sum(n) as total from counts where size = 1 group by lang
), frequent as (
    select * from counts where n >= 100
), inside as (
    select lang, w[1 : size - 1] as w, n from frequent where size > 2
    union all select lang, w[2 : size] as w, n from frequent where size > 2
), kept as (
    select f.* from frequent f left join (select lang, w, max(n) as longer from inside group by lang, w) i using (lang, w)
    where size > 1 and (longer is null or 100 * longer < 100 * n)
), cuts as (
    select lang, phrase, size, w, n as a, unnest(range(1, size)) as k from kept
), scored as (
    select c.lang, c.phrase, c.a, k, l.n as l, r.n as r, cast(total as bigint) as n,
        cast((1000::hugeint * c.a * total::hugeint) // (l.n::hugeint * r.n) as bigint) as score
    from cuts c join totals t on t.lang = c.lang
    join frequent l on l.lang = c.lang and l.w = c.w[1 : k]
    join frequent r on r.lang = c.lang and r.w = c.w[k + 1 : c.size]
), lowest as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from lowest qualify rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {
    "op1_hyperminhash_near_dedup": _OP1,
    "op2_temporal_url_filter": _OP2,
    "op4_extendible_hash_dedup": _OP4,
    "op7_quotation_linking": _OP7,
    "op12_merkle_manifest": _OP12,
    "op13_suffix_collocations": _OP13,
}
