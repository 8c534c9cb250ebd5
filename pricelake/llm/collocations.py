"""Phrase collocations: frequent phrases by suffix subtrees that are built group by group, and their scores.

Every place where a word stands starts a suffix, cut at ``LONGEST`` words.  A
suffix goes on only as long as pairs of neighbours may be frequent, since no
frequent phrase holds a rare pair.  Suffixes are cut vertically: those with a
common prefix, the first word, go to one group; the prefix of a word that is
too frequent for a group is the word and the next one, that of such a pair the
suffix itself.  A group's suffixes, in order, are the leaves of a subtree of
bounded depth; the total of the leaves below a node is the number of times its
phrase occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from pricelake.llm import arrays as A
from pricelake.runtime import written

#: Words of the longest phrase, and places from which on a phrase is a candidate.
LONGEST, LEAST = 5, 100
#: Phrases returned per language.
BEST = 2000
#: Suffixes in a group: more of one word, or of one pair, are cut by longer prefixes.
GROUP = 1 << 19
#: Words, and pairs, with this share of all words have longer prefixes in small tables too; in large ones at most 16 times as many do.
SHARES = 4096
#: Bits of a filter of words or pairs: 16 for each, up to 2^MOST_BITS.
LEAST_BITS, MOST_BITS = 16, 28
#: Bytes of text, and rows of a subtree, handled at once.
CHUNK, ROWS = 1 << 20, 100_000
#: Rows of phrase counts that are sent to all tasks; more are shuffled.
SENT = 200_000

UNKNOWN = "und"
_BREAKS = frozenset(b".,;:!?") | set(range(0x0A, 0x0E))
_IN_WORD = np.array([c not in _BREAKS and c not in (0x20, 0x09) for c in range(256)])
_IS_BREAK = np.array([c in _BREAKS for c in range(256)])


def _chunk_words(part: pa.RecordBatch):
    """Words of a chunk: their dictionary, the code and language code of each, whether the next one follows it, and the languages."""
    data, offsets = A.text_bytes(part.column("text"))
    data = A.LOWER[data]
    inside = _IN_WORD[data]
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    sizes = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    letters = data[inside]
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(sizes.tobytes()), pa.py_buffer(letters.tobytes()))
    coded = words.dictionary_encode()
    text = np.searchsorted(offsets, starts, "right") - 1
    langs = part.column("lang").dictionary_encode()
    lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text] if len(starts) else np.empty(0, np.int64)
    breaks = np.concatenate([[0], np.cumsum(_IS_BREAK[data])])
    follows = np.zeros(len(starts), bool)
    if len(starts):
        follows[:-1] = (text[1:] == text[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]])
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), lang, follows, langs.dictionary


def _hashes(values: pa.Array) -> np.ndarray:
    data, offsets = A.text_bytes(values)
    return A.span_hashes(data, offsets[:-1], offsets[1:])


def _word_hashes(dictionary: pa.Array, langs: pa.Array, code: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """A hash of each word and its language."""
    if not len(code):
        return np.empty(0, np.uint64)
    return A.mix(_hashes(dictionary)[code] + A.mix(_hashes(langs) + A.U64(1))[lang])


def _pair_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of each word with the next one; of the last word it means nothing."""
    return A.mix(words * A.U64(0x9E3779B97F4A7C15) + A.mix(np.concatenate([words[1:], words[:1]])))


class Filter:
    """Hashes in a bit array of bounded size: members are always told, some others too."""

    def __init__(self, bits: int, found: list[tuple[int, int]]):
        self.shift = A.U64(64 - bits)
        self.words = np.zeros(1 << (bits - 6), np.uint64)
        for place, word in found:
            self.words[place] = word & 0xFFFFFFFFFFFFFFFF

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slots = hashes >> self.shift
        return (self.words[(slots >> A.U64(6)).astype(np.int64)] >> (slots & A.U64(63))) & A.U64(1) != 0


def _filter(members: DataFrame) -> Filter:
    """A filter of the hashes ``h``; the driver sees a bit array of bounded size, not the members."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * members.count()).bit_length()))
    slot = F.shiftrightunsigned("h", 64 - bits)
    found = (
        members.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("place"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("word"))
    )
    return Filter(bits, [tuple(r) for r in found.toLocalIterator()])


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, h, n) of every word."""

    def run(batches):
        for part in A.chunks(batches, "text", CHUNK):
            dictionary, code, lang, _, langs = _chunk_words(part)
            if not len(code):
                continue
            found, n = np.unique(lang * len(dictionary) + code, return_counts=True)
            of, word = found // len(dictionary), found % len(dictionary)
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(pa.array(of)),
                    dictionary.take(pa.array(word)),
                    pa.array(_word_hashes(dictionary, langs, word, of).view(np.int64)),
                    pa.array(n),
                ],
                names=["lang", "word", "h", "n"],
            )

    found = docs.mapInArrow(run, "lang string, word string, h long, n long")
    return found.groupBy("lang", "word").agg(F.first("h").alias("h"), F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, sent) -> DataFrame:
    """(h, n): how often pairs of maybe frequent words follow each other, by hash; equal hashes only add up."""

    def run(batches):
        words = sent.value
        for part in A.chunks(batches, "text", CHUNK):
            dictionary, code, lang, follows, langs = _chunk_words(part)
            if not len(code):
                continue
            hashes = _word_hashes(dictionary, langs, code, lang)
            frequent = words.has(hashes)
            pairs = _pair_hashes(hashes)[follows & frequent & np.concatenate([frequent[1:], [False]])]
            if len(pairs):
                found, n = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["h", "n"])

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def suffixes(docs: DataFrame, sent) -> DataFrame:
    """(lang, suffix, prefix, key, n): suffixes of two to ``LONGEST`` words, each with a space behind every word.

    ``prefix`` is the number of words by which the suffix is grouped, ``key``
    a hash of these.
    """

    def run(batches):
        words, pairs, heavy_words, heavy_pairs = sent.value
        for part in A.chunks(batches, "text", CHUNK):
            dictionary, code, lang, follows, langs = _chunk_words(part)
            n = len(code)
            if not n:
                continue
            hashes = _word_hashes(dictionary, langs, code, lang)
            frequent = words.has(hashes)
            linked = _pair_hashes(hashes)
            go_on = follows & frequent & np.concatenate([frequent[1:], [False]])
            go_on[go_on] = pairs.has(linked[go_on])
            depth = go_on.astype(np.int64)
            on = go_on.copy()
            for k in range(1, min(n, LONGEST - 1)):
                on[: n - k] &= go_on[k:]
                on[n - k :] = False
                depth += on
            depth[depth > 0] += 1
            prefix = np.where(np.isin(hashes, heavy_words), np.where(np.isin(linked, heavy_pairs), LONGEST, 2), 1)
            tables = []
            for k in range(2, LONGEST + 1):
                at = np.flatnonzero(depth == k)
                if not len(at):
                    continue
                parts = [dictionary.take(pa.array(code[at + j])) for j in range(k)]
                whole = linked[at].copy()
                for j in range(1, k):
                    whole = A.mix(whole * A.U64(0xD6E8FEB86659FD93) + hashes[at + j])
                key = np.where(prefix[at] == 1, hashes[at], np.where(prefix[at] == 2, linked[at], whole))
                tables.append(
                    pa.table(
                        {
                            "lang": langs.take(pa.array(lang[at])),
                            "suffix": pc.binary_join_element_wise(*parts, "", " "),
                            "prefix": pa.array(prefix[at].astype(np.int32)),
                            "key": pa.array(key.view(np.int64)),
                            "n": pa.array(np.ones(len(at), np.int64)),
                        }
                    )
                )
            if tables:
                same = pa.concat_tables(tables).group_by(["lang", "suffix", "prefix", "key"]).aggregate([("n", "sum")])
                same = same.rename_columns(["lang", "suffix", "prefix", "key", "n"])
                yield from same.combine_chunks().to_batches(max_chunksize=ROWS)

    return docs.mapInArrow(run, "lang string, suffix string, prefix int, key long, n long")


def _subtree(rows: pa.Table, least: int) -> pa.RecordBatch:
    """Nodes (lang, phrase, size, n) of the subtree over sorted suffixes, with the totals of the leaves below them.

    Rare nodes are left out where no other rows can have leaves of them: not
    those at the first and last row, and none above the prefix of its group.
    """
    rows = rows.combine_chunks()
    count = rows.num_rows
    split = pc.split_pattern(rows.column("suffix").chunk(0), " ")
    lengths = np.diff(split.offsets.to_numpy()) - 1
    values = split.values.dictionary_encode()
    codes = np.full((count, LONGEST), -1, np.int64)
    starts = split.offsets.to_numpy()[:-1] - split.offsets.to_numpy()[0]
    flat = values.indices.to_numpy(zero_copy_only=False)
    for k in range(LONGEST):
        own = lengths > k
        codes[own, k] = flat[starts[own] + k]
    lang = rows.column("lang").chunk(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    n, prefix = (rows.column(c).to_numpy() for c in ("n", "prefix"))
    changed = np.ones(count, bool)
    changed[1:] = (lang[1:] != lang[:-1]) | (codes[1:, 0] != codes[:-1, 0])
    out = []
    for k in range(1, LONGEST):
        changed[1:] |= codes[1:, k] != codes[:-1, k]
        first = np.flatnonzero(changed)
        total = np.add.reduceat(n, first)
        edge = np.zeros(len(first), bool)
        edge[[0, -1]] = True
        real = lengths[first] > k
        wanted = real & ((total >= least) | edge | (prefix[first] > k + 1))
        at = first[wanted]
        if len(at):
            parts = [values.dictionary.take(pa.array(codes[at, j])) for j in range(k + 1)]
            out.append(
                pa.table(
                    {
                        "lang": rows.column("lang").chunk(0).take(pa.array(at)),
                        "phrase": pc.binary_join_element_wise(*parts, " "),
                        "size": pa.array(np.full(len(at), k + 1, np.int32)),
                        "n": pa.array(total[wanted]),
                    }
                )
            )
    return pa.concat_tables(out).combine_chunks() if out else None


def phrase_counts(found: DataFrame, groups: int, least: int) -> DataFrame:
    """(lang, phrase, size, n) of phrases of two and more words that occur ``least`` times, from ``suffixes``."""

    def run(batches):
        kept, size = [], 0
        for batch in batches:
            kept.append(batch)
            size += batch.num_rows
            if size >= ROWS:
                nodes = _subtree(pa.Table.from_batches(kept), least)
                kept, size = [], 0
                if nodes is not None:
                    yield from nodes.to_batches()
        if size:
            nodes = _subtree(pa.Table.from_batches(kept), least)
            if nodes is not None:
                yield from nodes.to_batches()

    dealt = found.repartition(groups, "key").sortWithinPartitions("lang", "suffix")
    nodes = dealt.mapInArrow(run, "lang string, phrase string, size int, n long")
    return nodes.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Written tables of the frequent words and phrases (lang, phrase, size, n), and of all words of a language (lang, total)."""
    spark = docs.sparkSession
    counts = written(word_counts(docs), "words")
    totals = written(counts.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    words = counts.where(F.col("n") >= least)
    word_filter = _filter(words.select("h"))
    pairs = written(pair_counts(docs, spark.sparkContext.broadcast(word_filter)).where(F.col("n") >= least), "pairs")
    pair_filter = _filter(pairs.select("h"))
    places = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    every = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    most = max(1000, min(GROUP, every // SHARES), every // (16 * SHARES))
    heavy = lambda df: np.array([r.h for r in df.where(F.col("n") > most).select("h").distinct().collect()], np.int64).view(np.uint64)
    sent = spark.sparkContext.broadcast((word_filter, pair_filter, heavy(words), heavy(pairs)))
    groups = max(spark.sparkContext.defaultParallelism, -(-places // GROUP))
    phrases = phrase_counts(suffixes(docs, sent), groups, least)
    singles = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n")
    return written(singles.unionByName(phrases), "phrases"), totals


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, share: int = 100, best: int | None = BEST
) -> DataFrame:
    """Rows lang, rank, phrase, a, l, r, n, score: the phrases of two to five words that hold together best.

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends, and split
    at spaces and tabs.  A phrase that occurs ``a >= least`` times in its
    language is a candidate.  Cut after its first k words it has the score
    floor(1000 * a * n / (l * r)), where l and r are the counts of both parts
    and n that of all words; the cut with the lowest score counts, of equal
    ones that with the least k.  A candidate goes if a longer one that holds
    it in a row has ``share`` percent of its count or more.  Phrases are
    ranked by score, count and text (UTF-8 bytes); ``best`` of each language
    stay, all if None.  All numbers are exact: filters that are sent to the
    tasks only spare rare pairs the way, equal hashes only keep more of them.

    Cases: a NULL language is ``und``; NULL and empty texts have no words;
    texts of any length are read whole, a repeated row counts each time; a
    table without candidates gives no rows; extra columns are ignored,
    whatever their names.
    """
    plain = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text")).where("text IS NOT NULL")
    found, totals = frequent_phrases(plain, least)
    phrases = found.where("size > 1")
    # A longer phrase with so many places has phrases of one word more in it that have as many: those are enough.
    parts = F.split("phrase", " ")
    joined = lambda words, start, size: F.array_join(F.slice(words, start, size), " ")
    longer = phrases.where("size > 2").withColumn("w", parts)
    inside = longer.select(
        "lang", F.explode(F.array(joined("w", 1, F.col("size") - 1), joined("w", 2, F.col("size") - 1))).alias("phrase"), F.col("n").alias("longer")
    )
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    covered = F.coalesce(100 * F.col("longer") >= share * F.col("n"), F.lit(False))
    kept = phrases.join(most, ["lang", "phrase"], "left").where(~covered).drop("longer")
    # Counts of both parts of every cut.
    cuts = kept.withColumn("w", parts).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select(
        "lang", "phrase", F.col("n").alias("a"), "k",
        joined("w", F.lit(1), F.col("k")).alias("head"), joined("w", F.col("k") + 1, F.col("size")).alias("tail"),
    )
    known = _sent(found)
    counts = lambda part, name: known.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    both = cuts.join(counts("head", "l"), ["lang", "head"]).join(counts("tail", "r"), ["lang", "tail"])
    both = both.join(F.broadcast(totals), "lang") if totals.limit(SENT + 1).count() <= SENT else both.join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = both.withColumn("above", (F.lit(1000).cast("decimal(4,0)") * wide("a")).cast("decimal(22,0)")).withColumn(
        "score", F.expr("(cast(above * cast(total as decimal(16,0)) as decimal(38,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    )
    lowest = scored.groupBy("lang", "phrase", "a", "total").agg(F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("cut"))
    rows = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if best is not None:
        # the best of every part of a language first, so no task sorts all its phrases
        some = Window.partitionBy("lang", "part").orderBy(*order)
        rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(some))
        rows = rows.where(F.col("rank") <= best)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
