"""Token sequences of fixed capacity by harmonic packing."""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pricelake.llm import arrays as A
from pricelake.runtime import written

CAPACITY = 1024
#: Pieces leave at most this share of their bin empty, or are cut to fit exactly.
SLACK = 1 / 48
#: Distinct words whose ids a task remembers.
REMEMBERED = 250_000

#: Bytes after which a text may be cut before white space, because no token reaches over: ASCII signs, and the
#: ends of two-byte letters.
_SIGN = np.array([0x21 <= c <= 0x7E for c in range(256)])
_SPACE = ~A.NOT_SPACE


def cuts(capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """How a rest of 0 to ``capacity`` - 1 tokens is cut into pieces.

    A piece of length n belongs to the class k = capacity // n, whose bins
    take k pieces.  Where k such pieces fill a bin well the rest stays whole;
    otherwise it is cut at the exact reciprocal capacity // (k + 1), which
    wastes nothing, and what is left is cut by the same rule.
    """
    out: list[tuple[int, ...]] = [()]
    for n in range(1, capacity):
        k = capacity // n
        exact = capacity // (k + 1)
        out.append((n,) if capacity - k * n <= SLACK * capacity else (exact, *out[n - exact]))
    return out


class Tokens:
    """Ids of texts by a byte-level BPE vocabulary, whole words remembered."""

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int]):
        import tiktoken

        self.added = added
        self.signs = re.compile("|".join(f"({re.escape(sign)})" for sign in added) or r"(?!)")
        self.sign_bytes = [sign.encode() for sign in added]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(token) for token in ranks]
        self.encode = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.forget()

    def word_ids(self, word: str) -> list[int]:
        """Ids of a part of a text; an added token in it is one id, and what stands on its sides is encoded apart."""
        out, at = [], 0
        for found in self.signs.finditer(word):
            out += [*self.encode(word[at : found.start()]), self.added[found.group()]]
            at = found.end()
        return [*out, *self.encode(word[at:])]

    def parts_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts of texts: in which order the parts are taken, all their ids, and how many each has.

        Parts that begin with white space and end so that no token reaches
        over are put one behind the other and encoded as one text; the bytes
        of its tokens tell where each part's ids end.
        """
        raw = data.tobytes()
        parts = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        two = (ends - starts >= 2) & (data[ends - 1] >= 0x80) & (data[ends - 2] >= 0xC3) & (data[ends - 2] <= 0xDF)
        joins = _SPACE[data[starts]] & (_SIGN[data[ends - 1]] | two)
        together = b"".join(parts)
        if any(sign in together for sign in self.sign_bytes):
            joins &= np.array([not any(sign in part for sign in self.sign_bytes) for part in parts])
        chosen = np.flatnonzero(joins)
        try:
            ids = np.array(self.encode(b"".join([parts[i] for i in chosen.tolist()]).decode()), np.int32)
        except UnicodeDecodeError:
            chosen, ids = chosen[:0], np.empty(0, np.int32)
        bounds, tops = np.cumsum((ends - starts)[chosen]), np.cumsum(self.sizes[ids])
        lasts = np.searchsorted(tops, bounds)
        if len(chosen) and not np.array_equal(tops[np.minimum(lasts, len(tops) - 1)], bounds):
            chosen, ids, lasts = chosen[:0], ids[:0], lasts[:0]
        others = np.setdiff1d(np.arange(len(parts)), chosen)
        alone = [self.word_ids(parts[i].decode("utf-8", "replace")) for i in others.tolist()]
        counts = np.concatenate([np.diff(lasts + 1, prepend=0), np.fromiter(map(len, alone), np.int64, len(alone))])
        rest = np.fromiter((t for f in alone for t in f), np.int32)
        return np.concatenate([chosen, others]), np.concatenate([ids, rest]), counts

    def forget(self):
        self.known: dict[int, int] = {}
        self.starts = np.zeros(1, np.int64)
        self.flat = np.empty(0, np.int32)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin.

        Texts are cut before each white space that follows a visible
        character; a token holds white space only at its start, so the parts
        can be encoded one by one, and equal ones once.
        """
        before = np.zeros(len(data), bool)
        two = np.zeros(len(data), bool)
        before[1:] = _SIGN[data[:-1]]
        two[2:] = (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF) & (data[1:-1] >= 0x80)
        cut = _SPACE[data] & (before | two)
        first = offsets[:-1]
        cut[first[first < offsets[1:]]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        hashes = A.span_hashes(data, starts, ends)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.forget()
        slots = np.array([self.known.get(h, -1) for h in distinct.tolist()], np.int64)
        fresh = np.flatnonzero(slots < 0)
        at = where[fresh]
        order, found, lengths = self.parts_ids(data, starts[at], ends[at])
        fresh, first = fresh[order], len(self.known)
        slots[fresh] = np.arange(first, first + len(fresh))
        self.known.update(zip(distinct[fresh].tolist(), slots[fresh].tolist()))
        self.flat = np.concatenate([self.flat, found])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        slots = slots[back]
        counts = self.starts[slots + 1] - self.starts[slots]
        total = np.concatenate([[0], np.cumsum(counts)])
        take = np.repeat(self.starts[slots] - total[:-1], counts) + np.arange(total[-1])
        return self.flat[take], total[np.searchsorted(starts, offsets)]


def pieces(docs: DataFrame, ranks_path: str, pattern: str, end: int, capacity: int, added: dict[str, int]) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, class, worker, nth) of all documents."""

    def run(batches):
        from pyspark import TaskContext

        worker = TaskContext.get().partitionId()
        tokens, plan = Tokens(ranks_path, pattern, added), cuts(capacity)
        used = np.zeros(capacity + 1, np.int64)
        for part in A.chunks(batches, "text"):
            ids, at = tokens.ids(*A.text_bytes(part.column("text")))
            rows = []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                own = np.append(ids[a:b], end).astype("<u4")
                size, start = len(own), 0
                for n in (*[capacity] * (size // capacity), *plan[size % capacity]):
                    k = capacity // n
                    rows.append((i, start, n, zlib.crc32(own[start : start + n].tobytes()), size, k, int(used[k])))
                    used[k] += 1
                    start += n
            table = np.array(rows, np.int64).reshape(-1, 7)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(pa.array(table[:, 0])),
                    *[pa.array(table[:, k]) for k in (1, 2, 3, 4, 5, 6)],
                    pa.array(np.full(len(table), worker)),
                ],
                names=["id", "start", "length", "ids_crc32", "doc_tokens", "class", "nth", "worker"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, class long, nth long, worker long"
    )


def pack(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id: str = "doc_id",
    text: str = "text",
    end: int = 0,
    capacity: int = CAPACITY,
    added: dict[str, int] | None = None,
) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Ids are those of the vocabulary's tokenizer; ``added`` are its tokens that
    stand for a text as a whole (without white space), wherever it occurs.

    A document's ids and ``end`` are cut into pieces of ``capacity`` and a
    rest, cut by ``cuts``.  Every task numbers its pieces of each class by
    itself; how many pieces of a class earlier tasks have (one small row per
    task and class) makes the numbers gapless, and piece number p of class k
    goes to bin p // k.  Only the last bin of a class can lack pieces; those
    few (a number that ``capacity`` bounds, whatever the input) are packed
    together, largest first.

    Cases: a NULL or empty text is one piece of the end token; a text of any
    length is cut; repeated rows and NULL ids are packed like all others; an
    empty table gives no rows; extra columns are ignored.
    """
    plain = A.with_small_batches(docs).select(F.col(id).alias("id"), F.col(text).alias("text"))
    cut = written(pieces(plain, ranks_path, pattern, end, capacity, added or {}), "pieces")
    counts = cut.groupBy("class", "worker").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("class", "worker", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    totals = counts.groupBy("class").agg(F.sum("n").alias("total"))
    full = F.col("total") - F.col("total") % F.col("class")
    earlier = Window.orderBy(F.col("class")).rowsBetween(Window.unboundedPreceding, -1)
    bins = totals.select(
        "class", full.alias("full"), F.coalesce(F.sum(F.expr("total div class")).over(earlier), F.lit(0)).alias("base")
    )
    placed = (
        cut.join(starts.join(bins, "class"), ["class", "worker"])
        .withColumn("number", F.col("ahead") + F.col("nth"))
        .withColumn("last", F.col("number") >= F.col("full"))
    )
    placed = written(placed.drop("worker", "nth", "ahead"), "placed")
    in_bins = placed.where("NOT last").withColumn("sequence_id", F.expr("base + number div class"))
    filled = totals.agg(F.coalesce(F.sum(F.expr("total div class")), F.lit(0))).first()[0]
    rest = placed.where("last").repartition(1).mapInArrow(_largest_first(capacity, filled), placed.select("*", F.lit(0).cast("long").alias("sequence_id")).schema)
    inside = Window.partitionBy("sequence_id").orderBy("class", "number").rowsBetween(Window.unboundedPreceding, -1)
    return (
        in_bins.unionByName(rest)
        .withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
        .select(F.col("id").alias(id), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    )


def _largest_first(capacity: int, first: int):
    """Packs the pieces of incomplete bins, each into the first bin with room."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        lengths = table.column("length").to_numpy()
        order = np.lexsort((table.column("number").to_numpy(), -lengths))
        room, bins = [], np.zeros(len(lengths), np.int64)
        for i in order.tolist():
            at = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
            if at == len(room):
                room.append(capacity)
            room[at] -= int(lengths[i])
            bins[i] = first + at
        yield from table.append_column("sequence_id", pa.array(bins)).combine_chunks().to_batches()

    return run
