"""Log probabilities of texts by prediction by partial matching over byte contexts."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pricelake.llm import arrays as A
from pricelake.runtime import written

#: Bytes of the longest context.
ORDER = 5
#: Contexts of fewer bytes have at most 2^24 pairs with their symbols, whatever the corpus; they go to all tasks.
LOW = 3
#: A word is sent to all tasks if it makes up this share of all words in training.
SHARE = 2.0**-20
#: Byte runs, the most used ones, whose scores are sent to all tasks; documents meet the scores of others in a join.
HOT = 1 << 20
#: Slots for scores of byte runs that a task remembers.
SLOTS = 20
#: Distinct keys a task gathers before it sends them on.
GATHERED = 700_000

END = np.uint64(0xE27B4C7F2D9A1351)


def canonical(data: np.ndarray, found: A.Words, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as words with one space between and a line feed at the end, ``ORDER`` line feeds before each.

    Gives the bytes, where each text's symbols begin and how many it has.
    """
    counts = np.diff(found.of)
    lengths = found.ends - found.starts
    total = np.concatenate([[0], np.cumsum(lengths)])
    size = total[found.of[1:]] - total[found.of[:-1]] + np.maximum(counts, 1)
    ends = np.cumsum(size + ORDER)
    starts = ends - size
    out = np.full(int(ends[-1]) if len(ends) else 0, 10, np.uint8)
    if len(lengths):
        text = np.repeat(np.arange(len(counts)), counts)
        # a word's place: its text's start, and the words and spaces before it there
        place = starts[text] + total[:-1] - total[found.of[:-1]][text] + np.arange(len(lengths)) - found.of[:-1][text]
        out[np.repeat(place - total[:-1], lengths) + np.arange(total[-1])] = data[
            np.repeat(found.starts - total[:-1], lengths) + np.arange(total[-1])
        ]
        gaps = place + lengths
        out[gaps] = 32
        out[ends[counts > 0] - 1] = 10
    return out, starts, size


def runs(stream: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each symbol the ``ORDER`` bytes before it and itself as one integer, texts one after the other."""
    n = len(stream) - ORDER
    if n <= 0:
        return np.empty(0, np.uint64)
    found = np.zeros(n, np.uint64)
    for j in range(ORDER + 1):
        found <<= A.U64(8)
        found |= stream[j : j + n]
    total = np.concatenate([[0], np.cumsum(size)])
    return found[np.repeat(starts - ORDER - total[:-1], size) + np.arange(total[-1])]


def _read(texts: pa.Array):
    data, offsets = A.text_bytes(texts)
    data = A.LOWER[data]
    found = A.words(data, offsets)
    return found, canonical(data, found, offsets)


class _Counter:
    """Counts of 64-bit keys, summed up where many have come together."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray):
        found = np.unique(keys, return_counts=True)
        self.parts.append(found)
        self.size += len(found[0])
        if self.size > GATHERED and len(self.parts) > 1:
            self.sum()

    def sum(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([p[0] for p in self.parts] or [np.empty(0, np.uint64)])
        counts = np.concatenate([p[1] for p in self.parts] or [np.empty(0, np.int64)])
        if len(keys):
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, counts = keys[first], np.add.reduceat(counts, first)
        self.parts, self.size = [(keys, counts)], len(keys)
        return keys, counts


def counted(docs: DataFrame) -> DataFrame:
    """Counts (kind, key, n, uses): kind 0 are runs of bytes, kind 1 words and ends; ``n`` in training texts, ``uses`` in all."""

    def run(batches):
        # runs and words of training texts, runs of held-out texts
        counters = _Counter(), _Counter(), _Counter()

        def rows(which):
            keys, n = counters[which].sum()
            counters[which].__init__()
            for a in range(0, len(keys), 100_000):
                part, uses = keys[a : a + 100_000], n[a : a + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(part), which % 2, np.int32)),
                        pa.array(part.view(np.int64)),
                        pa.array(uses if which < 2 else np.zeros_like(uses)),
                        pa.array(uses),
                    ],
                    names=["kind", "key", "n", "uses"],
                )

        for part in A.chunks(batches, "text"):
            found, (stream, starts, size) = _read(part.column("text"))
            held = part.column("held_out").to_numpy(zero_copy_only=False)
            every = runs(stream, starts, size)
            of = np.repeat(held, size)
            counters[0].add(every[~of])
            counters[2].add(every[of])
            trains = ~np.repeat(held, np.diff(found.of))
            counters[1].add(np.concatenate([found.hashes[trains], np.full(int((~held).sum()), END)]))
            for which in range(3):
                if counters[which].size > GATHERED:
                    yield from rows(which)
        for which in range(3):
            yield from rows(which)

    found = docs.mapInArrow(run, "kind int, key long, n long, uses long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses"))


def _pairs(keys: np.ndarray, n: np.ndarray, orders: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, key and count of the (context, symbol) pairs at the end of counted runs; a key's last byte is the symbol."""
    order, key, count = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for k in orders:
        found, back = np.unique(keys & A.U64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, back, n)
        order.append(np.full(len(found), k))
        key.append(found)
        count.append(total)
    return np.concatenate(order), np.concatenate(key), np.concatenate(count)


def probabilities(runs: DataFrame) -> DataFrame:
    """(key, uses, score): the log10 probability of the last byte of every run, by all runs of training texts.

    A context and all longer ones that end with it are in one task, so that it
    has every count from order ``LOW`` on; the counts of lower orders, which
    the alphabet bounds, are sent to all tasks.
    """
    low = runs.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * LOW) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    low = _pairs(low.column("key").to_numpy().view(np.uint64), low.column("n").to_numpy(), range(LOW))
    sent = runs.sparkSession.sparkContext.broadcast(low)

    def of_groups(part: pa.Table) -> pa.RecordBatch:
        keys, n = part.column("key").to_numpy().view(np.uint64), part.column("n").to_numpy()
        high = _pairs(keys[n > 0], n[n > 0], range(LOW, ORDER + 1))
        model = Model(*(np.concatenate(both) for both in zip(sent.value, high)))
        for a in range(0, len(keys), 100_000):
            own = part.slice(a, 100_000)
            found = model.log_probability(keys[a : a + 100_000]) / math.log(10)
            yield pa.RecordBatch.from_arrays(
                [own.column("key").combine_chunks(), own.column("uses").combine_chunks(), pa.array(found)], names=["key", "uses", "score"]
            )

    def run(batches):
        kept, size = [], 0
        for group in A.groups(batches, ["context"]):
            kept.append(group)
            size += group.num_rows
            if size > GATHERED:
                yield from of_groups(pa.concat_tables(kept))
                kept, size = [], 0
        if kept:
            yield from of_groups(pa.concat_tables(kept))

    context = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * LOW) - 1))
    dealt = runs.withColumn("context", context).repartition("context").sortWithinPartitions("context")
    return dealt.mapInArrow(run, "key long, uses long, score double")


def least_hot(scores: DataFrame) -> int:
    """Uses, a power of two, from which on there are no more than ``HOT`` runs."""
    sizes = dict(scores.groupBy((F.length(F.bin("uses")) - 1).alias("bits")).count().collect())
    bits, n = max(sizes, default=-1) + 1, 0
    while bits > 0 and n + sizes.get(bits - 1, 0) <= HOT:
        bits -= 1
        n += sizes.get(bits, 0)
    return 1 << bits


class _Remembering:
    """Scores of runs met before are remembered; ``log_probability`` gives those of others."""

    slots = None

    def scores(self, run: np.ndarray) -> np.ndarray:
        if self.slots is None:
            self.slots = np.zeros(1 << SLOTS, np.uint64)
            self.values = np.zeros(1 << SLOTS)
            self.used = np.zeros(1 << SLOTS, bool)
        slot = (A.mix(run) >> A.U64(64 - SLOTS)).astype(np.int64)
        out = self.values[slot]
        missed = np.flatnonzero((self.slots[slot] != run) | ~self.used[slot])
        if len(missed):
            distinct, back = np.unique(run[missed], return_inverse=True)
            found = self.log_probability(distinct)
            out[missed] = found[back]
            at = (A.mix(distinct) >> A.U64(64 - SLOTS)).astype(np.int64)
            self.slots[at], self.values[at], self.used[at] = distinct, found, True
        return out


class _Hot(_Remembering):
    """Scores of the runs that are sent to all tasks, not a number for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        by = np.argsort(keys)
        self.keys, self.found = keys[by], values[by]

    def log_probability(self, run: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(run), np.nan)
        at = np.minimum(np.searchsorted(self.keys, run), len(self.keys) - 1)
        return np.where(self.keys[at] == run, self.found[at], np.nan)


class Model(_Remembering):
    """PPM probabilities with escape method D and exclusion, from counts of (context, symbol) pairs.

    Each symbol seen after a context gives up half a count to the escape.

    Symbols seen after a context are seen after every shorter one, so what is
    excluded after an escape are the symbols of the context left last.
    """

    def __init__(self, order: np.ndarray, key: np.ndarray, n: np.ndarray):
        self.keys, self.n, self.context, self.total, self.distinct = [], [], [], [], []
        for k in range(ORDER + 1):
            own = order == k
            by = np.argsort(key[own])
            keys = key[own][by]
            self.keys.append(keys)
            self.n.append(n[own][by].astype(np.float64))
            context, first, distinct = np.unique(keys >> A.U64(8), return_index=True, return_counts=True)
            self.context.append(context)
            self.distinct.append(distinct.astype(np.float64))
            self.total.append(np.add.reduceat(self.n[k], first) if len(first) else np.empty(0))
        # after an escape from a context of order k: what is left at order k - 1
        self.left, self.fresh = [None], [None]
        for k in range(1, ORDER + 1):
            shorter = self.keys[k] & A.U64((1 << 8 * k) - 1)
            seen = self.n[k - 1][np.searchsorted(self.keys[k - 1], shorter)] if len(shorter) else np.empty(0)
            of = np.searchsorted(self.context[k], self.keys[k] >> A.U64(8))
            up = np.searchsorted(self.context[k - 1], self.context[k] & A.U64((1 << 8 * (k - 1)) - 1))
            excluded = np.bincount(of, weights=seen, minlength=len(self.context[k]))
            self.left.append(self.total[k - 1][up] - excluded)
            self.fresh.append(self.distinct[k - 1][up] - self.distinct[k])

    def log_probability(self, run: np.ndarray) -> np.ndarray:
        """Natural log probability of the last byte of each run after the bytes before it."""
        out = np.zeros(len(run))
        open_ = np.ones(len(run), bool)
        entered = np.zeros(len(run), bool)
        above = np.full(len(run), -1)  # the context left last, at one order more
        for k in range(ORDER, -1, -1):
            if not len(self.context[k]):
                continue
            key = run & A.U64((1 << 8 * (k + 1)) - 1)
            of = np.minimum(np.searchsorted(self.context[k], key >> A.U64(8)), len(self.context[k]) - 1)
            known = open_ & (self.context[k][of] == key >> A.U64(8))
            at = np.minimum(np.searchsorted(self.keys[k], key), len(self.keys[k]) - 1)
            hit = known & (self.keys[k][at] == key)
            total, fresh = self.total[k][of], self.distinct[k][of]
            if k < ORDER and len(self.left[k + 1]):
                # rows that are not open may hold places of another order
                last = np.minimum(above, len(self.left[k + 1]) - 1)
                total = np.where(entered, self.left[k + 1][last], total)
                fresh = np.where(entered, self.fresh[k + 1][last], fresh)
            out[hit] += np.log((self.n[k][at][hit] - 0.5) / total[hit])
            escape = known & ~hit & (fresh > 0)
            out[escape] += np.log(0.5 * fresh[escape] / total[escape])
            open_ &= ~hit
            entered |= known
            above = np.where(known, of, above)
        seen = len(self.keys[0])
        out[open_] -= math.log(max(1, 256 - seen))
        return out


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """A row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32 of the id as text is ``held`` modulo ``folds`` are held
    out, the others train.  A text is its words (runs without white space, A-Z
    in lower case) and an end.  ``score`` is the log10 probability of the
    words, one space between and an end sign after them, as bytes: contexts
    of up to ``ORDER`` bytes predict the next, a byte not seen after a context
    costs an escape (half a count for each distinct symbol, method D),
    and symbols excluded by longer contexts are not counted again.
    ``base_score`` adds log10((c + 1) / (N + V + 1)) over words and the end.

    1. Runs of ``ORDER`` + 1 bytes and words are counted in each task and summed up by key.
    2. Every distinct run is scored once, by all contexts of the training
       texts, in tasks that hold whole contexts.
    3. Scores of the most used runs and counts of the most used words go to
       every task; of its texts, other runs (with their number in the text)
       and words are sent on and meet theirs in a join.

    Cases: a NULL or empty text is its end alone; a NULL id counts as the
    empty text in the fold; repeated rows are scored each; an empty table
    gives no rows; without training texts every symbol is one of 256 alike;
    extra columns are ignored.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % folds
    plain = A.with_small_batches(docs).select(F.col(id).alias("id"), (fold == held).alias("held_out"), F.col(text).alias("text"))
    counts = written(counted(plain.select("held_out", "text")), "counts", ("kind",))
    words = counts.where("kind = 1").select("key", "n")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = words.where(F.col("n") >= max(1, n * SHARE)).toArrow()
    of_runs = written(probabilities(counts.where("kind = 0").select("key", "n", "uses")), "probabilities")
    least = least_hot(of_runs)
    hot = of_runs.where(F.col("uses") >= least).select("key", "score").toArrow()
    sent = spark.sparkContext.broadcast(
        {
            "words": (frequent.column("key").to_numpy(), frequent.column("n").to_numpy()),
            "runs": (hot.column("key").to_numpy().view(np.uint64), hot.column("score").to_numpy()),
        }
    )
    kind = plain.schema["id"].dataType.simpleString()
    scored = plain.mapInArrow(
        _scoring(sent, uuid.uuid4().hex, n + v + 1),
        f"row long, id {kind}, held_out boolean, n_tokens long, known long, base double, model double, rare array<long>, "
        "runs array<struct<key: long, times: long>>",
    )
    scored = written(scored, "scores")
    rare = scored.select("row", F.explode("rare").alias("key")).join(words, "key", "left")
    rare = rare.groupBy("row").agg(
        F.count("n").alias("more"), F.sum(F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(n + v + 1)))).alias("rest")
    )
    seldom = scored.select("row", F.explode("runs").alias("r")).select("row", "r.key", "r.times")
    seldom = seldom.join(of_runs.where(F.col("uses") < least).select("key", "score"), "key")
    seldom = seldom.groupBy("row").agg(F.sum(F.col("score") * F.col("times")).alias("rest_of_model"))
    return scored.drop("rare", "runs").join(rare, "row", "left").join(seldom, "row", "left").select(
        F.col("id").alias(id),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("rest_of_model", F.lit(0.0))).alias("score"),
    )


#: The scores a worker process used last, by the run it belongs to.
_models: dict = {}


def _by_text(of: np.ndarray, run: np.ndarray, texts: int) -> pa.Array:
    """For each text its distinct runs, each with its number."""
    by = np.lexsort((run, of))
    of, run = of[by], run[by]
    first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (run[1:] != run[:-1])])) if len(of) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(of)))
    offsets = np.searchsorted(of[first], np.arange(texts + 1)).astype(np.int32)
    found = pa.StructArray.from_arrays([pa.array(run[first].view(np.int64)), pa.array(times.astype(np.int64))], names=["key", "times"])
    return pa.ListArray.from_arrays(pa.array(offsets), found)


def _scoring(sent, name: str, whole: int):
    def run(batches):
        from pyspark import TaskContext

        if name not in _models:
            _models.clear()
            keys, n = sent.value["words"]
            order = np.argsort(keys)
            _models[name] = _Hot(*sent.value["runs"]), keys[order], np.log10((n[order] + 1) / whole)
        known_runs, frequent, logs = _models[name]
        row = TaskContext.get().partitionId() << 40
        for part in A.chunks(batches, "text"):
            found, (stream, starts, size) = _read(part.column("text"))
            docs = part.num_rows
            every = runs(stream, starts, size)
            found_scores = known_runs.scores(every)
            seldom = np.isnan(found_scores)
            found_scores[seldom] = 0
            total = np.concatenate([[0.0], np.cumsum(found_scores)])
            ends = np.cumsum(size)
            score = total[ends] - total[ends - size]
            seldom = _by_text(np.repeat(np.arange(docs), size)[seldom], every[seldom], docs)
            of = np.concatenate([np.repeat(np.arange(docs), np.diff(found.of)), np.arange(docs)])
            keys = np.concatenate([found.hashes, np.full(docs, END)]).view(np.int64)
            at = np.minimum(np.searchsorted(frequent, keys), max(0, len(frequent) - 1))
            hit = frequent[at] == keys if len(frequent) else np.zeros(len(keys), bool)
            base = np.bincount(of[hit], weights=logs[at[hit]], minlength=docs) if len(frequent) else np.zeros(docs)
            known = np.bincount(of[hit], minlength=docs)
            miss = np.flatnonzero(~hit)
            miss = miss[np.argsort(of[miss], kind="stable")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + docs)),
                    part.column("id"),
                    part.column("held_out"),
                    pa.array(np.diff(found.of) + 1),
                    pa.array(known),
                    pa.array(base),
                    pa.array(score),
                    A.lists(keys[miss], np.bincount(of[miss], minlength=docs), pa.int64()),
                    seldom,
                ],
                names=["row", "id", "held_out", "n_tokens", "known", "base", "model", "rare", "runs"],
            )
            row += docs

    return run
