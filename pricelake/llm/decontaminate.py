"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pricelake.llm import arrays as A

#: Words of a passage that may be inserted, deleted or changed, as a share of the item's words.
EDITS = 0.2
#: Words in a row with which a window begins; only windows whose first words stand so in an item are embedded.
GRAM = 3
#: Words of a window, samples of an embedding that make a key, and keys of a window.
WINDOW, SAMPLED, REPEATS = 16, 2, 8
#: Items of fewer words are compared wherever one of their runs stands.
SHORT = 10
#: Windows embedded at once.
WINDOWS = 4096
#: Words of the items handled in one pass over the documents.
BLOCK_WORDS = 500_000

_BITS = 22


def edits_allowed(words: int, share: float = EDITS) -> int:
    """Edits such that at least one run of ``GRAM`` words stays whole: words - GRAM + 1 > GRAM * edits."""
    return max(0, min(int(share * words), (words - GRAM) // GRAM if words >= GRAM else 0))


def sampled_steps() -> np.ndarray:
    """The steps of the walk at which each repeat samples its embedding: all behind the first words, earlier ones more often."""
    draw = (A.numbers(REPEATS * SAMPLED * 2, 5000) >> A.U64(20)).astype(np.int64).reshape(2, REPEATS, SAMPLED)
    first, span = 2 * GRAM, 2 * (WINDOW - GRAM)
    return np.sort(first + np.minimum(draw[0] % span, draw[1] % span), axis=1)


_AT = sampled_steps()


def embed(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled symbols of the CGK embeddings of rows of words, and the words they come from: an array (row, repeat, sample) each.

    A pointer walks along each row; at every step the symbol under it is
    written and a random bit of step and symbol says whether it moves on.
    Rows at a small edit distance fall into step again after an edit, so they
    differ in few steps.
    """
    n, length = windows.shape
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)
    at = np.zeros((n, REPEATS), np.int64)
    rows = np.arange(n)[:, None]
    symbols = np.empty((n, REPEATS, SAMPLED), np.uint64)
    places = np.empty((n, REPEATS, SAMPLED), np.int64)
    last = int(_AT.max())
    steps = A.numbers(REPEATS * (last + 1), 1000).reshape(REPEATS, -1)
    for step in range(last + 1):
        symbol = padded[rows, at]
        for r, k in zip(*np.nonzero(_AT == step)):
            symbols[:, r, k], places[:, r, k] = symbol[:, r], at[:, r]
        at = np.minimum(at + ((symbol * steps[:, step]) >> A.U64(63)).astype(np.int64), length)
    return symbols, places


def keys(runs: np.ndarray, symbols: np.ndarray, back: bool) -> np.ndarray:
    """LSH keys (row, repeat, samples used): a window's first words, its direction, and none, one or both samples of a repeat."""
    base = runs[:, None] + (np.arange(REPEATS, dtype=np.uint64) * A.U64(2) + A.U64(back))[None, :] * A.U64(0xA0761D6478BD642F)
    out = np.empty((*symbols.shape[:2], SAMPLED + 1), np.uint64)
    for used in range(SAMPLED + 1):
        if used:
            base = base + A.mix(symbols[:, :, used - 1] + A.U64(used))
        out[:, :, used] = A.mix(base * A.U64(0xD6E8FEB86659FD93) + A.U64(used))
    return out


def windows_at(hashes: np.ndarray, places: np.ndarray, lows: np.ndarray, highs: np.ndarray, back: bool) -> np.ndarray:
    """Windows that begin with the run of words at ``places``, and go on to either side within [low, high); 0 beyond."""
    offsets = (GRAM - 1 - np.arange(WINDOW)) if back else np.arange(WINDOW)
    at = places[:, None] + offsets[None, :]
    inside = (at >= lows[:, None]) & (at < highs[:, None])
    return np.where(inside, hashes[np.clip(at, 0, max(0, len(hashes) - 1))], A.U64(0))


def best_match(item: list[int], region: list[int]) -> tuple[int, int]:
    """Least edit distance of ``item`` to any run of words of ``region``, and where the first best run ends.

    One column of the edit table per word, kept as bits of two integers.
    """
    m = len(item)
    where: dict[int, int] = {}
    for i, word in enumerate(item):
        where[word] = where.get(word, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    best, end = m, 0
    for j, word in enumerate(region):
        same = where.get(word, 0)
        across = (((same & up) + up) ^ up) | same
        along = same | down
        plus = (down | ~(across | up)) & full
        minus = up & across
        distance += bool(plus & top) - bool(minus & top)
        plus = plus << 1 & full
        up = (minus << 1 | ~(along | plus)) & full
        down = plus & along
        if distance < best:
            best, end = distance, j + 1
    return best, end


class Items:
    """Benchmark items prepared for search: their words, the runs windows begin with, and LSH keys of the windows."""

    def __init__(self, ids: list, texts: list[str | None], share: float):
        found = A.words(*A.text_bytes(lowered(pa.array(texts, pa.string()))), A.LETTERS)
        spans = list(zip(found.of[:-1].tolist(), found.of[1:].tolist()))
        self.words = [found.hashes[a:b] for a, b in spans]
        self.ids = ids
        self.edits = [edits_allowed(len(w), share) for w in self.words]
        self.known = [np.unique(w) for w in self.words]
        #: Items of fewer words than a run, by their number of words: hashes and owners.
        self.tiny = {}
        for size in range(1, GRAM):
            own = [i for i, w in enumerate(self.words) if len(w) == size]
            if own:
                hashes = np.array([_runs(self.words[i], size)[0] for i in own], np.uint64)
                order = np.argsort(hashes, kind="stable")
                self.tiny[size] = hashes[order], np.array(own, np.int64)[order]
        # Every place of an item at which a run stands, and the side to which more of the item lies.
        sizes = np.diff(found.of)
        owner = np.repeat(np.arange(len(spans)), sizes)
        place = np.arange(len(found.hashes)) - np.repeat(found.of[:-1], sizes)
        left = np.repeat(sizes, sizes) - place
        whole = left >= GRAM
        at, self.owners, self.places, left = np.flatnonzero(whole), owner[whole], place[whole], left[whole]
        runs = _runs(found.hashes, GRAM)[at] if len(at) else np.empty(0, np.uint64)
        self.runs = np.unique(runs)
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.runs >> A.U64(64 - _BITS)).astype(np.int64)] = True
        found_keys, rows = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        lows, highs = at - self.places, at + left
        for back in (False, True):
            extent = np.minimum(WINDOW, self.places + GRAM if back else left)
            own = np.flatnonzero((left < self.places + GRAM) == back)
            for part in np.array_split(own, max(1, -(-len(own) // WINDOWS))):
                symbols, walked = embed(windows_at(found.hashes, at[part], lows[part], highs[part], back))
                # samples behind the item's end say nothing; keys without any count only where no repeat has one
                usable = (walked < extent[part][:, None, None]).sum(2)
                none = (usable.max(1, initial=0) == 0) | (sizes[owner[at[part]]] < SHORT)
                usable = np.where(none[:, None], 0, usable)
                every = keys(runs[part], symbols, back)
                wanted = (usable > 0) | none[:, None] & (np.arange(REPEATS) == 0)[None, :]
                row, repeat = np.nonzero(wanted)
                found_keys.append(every[row, repeat, usable[row, repeat]])
                rows.append(part[row])
        found_keys, rows = np.concatenate(found_keys), np.concatenate(rows)
        order = np.argsort(found_keys, kind="stable")
        self.keys, self.rows = found_keys[order], rows[order]
        self.maybe_key = np.zeros(1 << _BITS, bool)
        self.maybe_key[(self.keys >> A.U64(64 - _BITS)).astype(np.int64)] = True

    def candidates(self, found: A.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts, items and the words of the text at which the items would begin, without repeats, in order."""
        text_of = lambda p: np.searchsorted(found.of, p, "right") - 1
        out = [(np.empty(0, np.int64),) * 3]
        for size, (hashes, owners) in self.tiny.items():
            runs = _runs(found.hashes, size)
            at, k = _matches(runs, hashes)
            d = text_of(at)
            real = at + size <= found.of[d + 1]
            out.append((d[real], owners[k][real], at[real]))
        runs = _runs(found.hashes, GRAM)
        at = np.flatnonzero(self.maybe[(runs >> A.U64(64 - _BITS)).astype(np.int64)])
        if len(at) and len(self.runs):
            near = np.minimum(np.searchsorted(self.runs, runs[at]), len(self.runs) - 1)
            at = at[self.runs[near] == runs[at]]
            d = text_of(at)
            at = at[at + GRAM <= found.of[d + 1]]
        for start in range(0, len(at), WINDOWS):
            part = at[start : start + WINDOWS]
            d = text_of(part)
            for back in (False, True):
                symbols, _ = embed(windows_at(found.hashes, part, found.of[d], found.of[d + 1], back))
                every = keys(runs[part], symbols, back)
                flat = every.reshape(-1)
                maybe = np.flatnonzero(self.maybe_key[(flat >> A.U64(64 - _BITS)).astype(np.int64)])
                hit, k = _matches(flat[maybe], self.keys)
                row, q = maybe[hit] // (every.shape[1] * every.shape[2]), self.rows[k]
                out.append((d[row], self.owners[q], part[row] - self.places[q]))
        d, i, s = (np.concatenate(c) for c in zip(*out))
        order = np.lexsort((s, i, d))
        d, i, s = d[order], i[order], s[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (s[1:] != s[:-1])
        return d[new], i[new], s[new]

    def search(self, found: A.Words) -> list[tuple[int, int, int, int]]:
        """Matches (text, item, distance, first word) in the words of some texts."""
        out = []
        texts, items, starts = self.candidates(found)
        if not len(texts):
            return out
        bounds = np.flatnonzero(np.concatenate([[True], (texts[1:] != texts[:-1]) | (items[1:] != items[:-1]), [True]]))
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            d, i = int(texts[x]), int(items[x])
            words, edits = self.words[i], self.edits[i]
            n, best, lead = len(words), None, None
            for s in starts[x:y].tolist():
                if lead is not None and s <= lead:
                    continue
                a = max(int(found.of[d]), s - edits)
                b = min(int(found.of[d + 1]), s + 2 * n + 2 * edits)
                lead = s + n  # windows that start up to here lie in the same region
                region = found.hashes[a:b]
                known = self.known[i]
                if (known[np.minimum(np.searchsorted(known, region), len(known) - 1)] == region).sum() < n - edits:
                    continue  # too few of its words are the item's
                distance, end = best_match(words.tolist(), region.tolist())
                if distance <= edits and (best is None or distance < best[0]):
                    best = distance, max(a, a + end - n) - int(found.of[d])
            if best:
                out.append((d, i, *best))
        return out


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))


def _matches(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of equal entries of ``values`` and sorted ``known``."""
    low = np.searchsorted(known, values, "left")
    count = np.searchsorted(known, values, "right") - low
    at = np.repeat(np.arange(len(values)), count)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)


def _runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words; those over the end mean nothing."""
    out = np.zeros(len(hashes), np.uint64)
    for j, f in enumerate(A.numbers(size, 9)):
        out[: len(hashes) - j] += hashes[j:] * f
    return A.mix(out + A.U64(size))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    share: float = EDITS,
) -> DataFrame:
    """A row per document and item whose passage it holds: id, item, item_words, distance, first_word.

    Texts are compared as sequences of words (letters and digits, lower case).
    A document holds an item if some run of its words is at most
    ``edits_allowed`` insertions, deletions and changes away from the item.

    Windows of the text, as long as an item or ``WINDOW`` words, begin at
    every run of three words that stands in an item (so few edits leave at
    least one such run whole, many edits of a long item some hundred) and are
    embedded by CGK walks to both sides.  A key is the run and two sampled
    steps of a walk; equal keys, in one of eight repeats, name the items to
    compare with; the exact edit distance of the whole item decides.  An item
    has a window at each of its words, so long ones have many chances.  The
    benchmark is a stated query set: it goes to the tasks in blocks of a
    bounded number of words, documents are never shuffled.

    Cases: a NULL or empty text or item matches nothing; items of fewer than
    six words must occur unchanged; equal items are all reported; of several
    occurrences the closest, then the first, counts; repeated rows are all
    reported; extra columns are ignored; memory for an item follows its
    length.  Of passages at the limit of edits, spread evenly or at random, at
    least 95 in 100 are found at every length (tests measure 15 to 400 words,
    changes, insertions and deletions apart).
    """
    spark = docs.sparkSession
    plain = A.with_small_batches(docs).select(F.col(id).alias("id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("item_text")).where("item_text IS NOT NULL")
    kinds = plain.schema["id"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    schema = f"id {kinds[0]}, item {kinds[1]}, item_words int, distance int, first_word long"
    total = items.agg(F.coalesce(F.sum(F.size(F.split("item_text", r"\s+"))), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / BLOCK_WORDS))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "item_text"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).select("item", "item_text").toArrow()
        sent = spark.sparkContext.broadcast((rows.column("item").to_pylist(), rows.column("item_text").to_pylist()))
        found = plain.mapInArrow(_searching(sent, uuid.uuid4().hex, share, rows.schema.field("item").type), schema)
        out = found if out is None else out.union(found)
    return out.select(
        F.col("id").alias(id), F.col("item").alias(item), "item_words", "distance", "first_word"
    )


#: The items a worker process prepared last, by the search they belong to.
_prepared: dict = {}


def _searching(sent, name: str, share: float, kind):
    def run(batches):
        if name not in _prepared:
            _prepared.clear()
            _prepared[name] = Items(*sent.value, share)
        items = _prepared[name]
        for part in A.chunks(batches, "text"):
            found = A.words(*A.text_bytes(lowered(part.column("text"))), A.LETTERS)
            hits = items.search(found)
            if hits:
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array([h[0] for h in hits])),
                        pa.array([items.ids[h[1]] for h in hits], kind),
                        pa.array([len(items.words[h[1]]) for h in hits], pa.int32()),
                        pa.array([h[2] for h in hits], pa.int32()),
                        pa.array([h[3] for h in hits], pa.int64()),
                    ],
                    names=["id", "item", "item_words", "distance", "first_word"],
                )

    return run
