"""Quality classifier: averaged vectors of hashed word and character n-grams, softmax output."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pricelake.llm import arrays as A

#: Labelled rows the classifier is trained on at most; the ones with the least hashes of their ids.
SAMPLE = 4_000
#: Bits of a bucket of n-grams, numbers in its vector.
BUCKETS, DIMENSION = 17, 8
#: Bytes in character n-grams.
GRAMS = (3, 4)
#: Passes over the training rows: six, and more over few rows, so that there are as many steps.
EPOCHS, STEPS, RATE = 6, 12_000, 0.5
SEED = 7


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and which text each belongs to.

    Words and pairs of neighbours in lower case, and runs of bytes as they
    are.  A pair of equal words is one and the same n-gram whatever the word.
    """
    data, offsets = A.text_bytes(texts)
    found = A.words(A.LOWER[data], offsets)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(found.of))
    parts = [(found.hashes, of)]
    if len(of) > 1:
        first, second = found.hashes[:-1], found.hashes[1:]
        pair = np.where(first == second, A.U64(99), A.mix(first * A.U64(3) + second))
        own = of[:-1] == of[1:]
        parts.append((pair[own], of[:-1][own]))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for n in GRAMS:
        if len(data) >= n:
            run = np.zeros(len(data) - n + 1, np.uint64)
            for j in range(n):
                run <<= A.U64(8)
                run |= data[j : j + len(run)]
            own = text[: len(run)] == text[n - 1 :]
            parts.append((A.mix(run[own] + A.U64(n << 40)), text[: len(run)][own]))
    hashes = np.concatenate([p[0] for p in parts])
    return (A.mix(hashes) >> A.U64(64 - BUCKETS)).astype(np.int64), np.concatenate([p[1] for p in parts])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Weight of each bucket and the bias, from (buckets, counts, label) of the training rows.

    A row's vector is the mean of its n-grams' vectors; softmax over two
    labels, stochastic gradient descent with a falling rate.  For two labels
    the difference of the outputs is all that matters, and a mean of vectors
    times that difference is a mean of numbers: those are what is returned.
    """
    draw = np.random.default_rng(SEED)
    vectors = draw.uniform(-1 / DIMENSION, 1 / DIMENSION, (1 << BUCKETS, DIMENSION)).astype(np.float32)
    outputs = np.zeros((2, DIMENSION), np.float32)
    bias = np.zeros(2, np.float32)
    epochs = max(EPOCHS, STEPS // max(1, len(rows)))
    steps, step = epochs * max(1, len(rows)), 0
    for _ in range(epochs if rows else 0):
        for i in draw.permutation(len(rows)).tolist():
            buckets, counts, label = rows[i]
            rate = RATE * (1 - step / steps)
            step += 1
            share = (counts / counts.sum()).astype(np.float32) if len(counts) else counts.astype(np.float32)
            mean = share @ vectors[buckets]
            out = outputs @ mean + bias
            p = np.exp(out - out.max())
            p /= p.sum()
            p[label] -= 1
            back = outputs.T @ p
            outputs -= rate * np.outer(p, mean)
            bias -= 0.1 * rate * p
            # steps of the vectors are as long as for a text of one n-gram
            vectors[buckets] -= (rate / max(1e-6, float(np.sqrt(share @ share)))) * share[:, None] * back
    return vectors @ (outputs[1] - outputs[0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, folds: int, held: int) -> tuple[np.ndarray, float]:
    """Trains on a bounded sample of the labelled rows outside the held-out fold, in one task."""
    train_rows = labels.where(_fold(id, folds) != held).where(F.col(label).isin(0, 1))
    train_rows = train_rows.groupBy(F.col(id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    chosen = train_rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    texts = A.with_small_batches(docs).select(F.col(id).alias("id"), F.col(text).alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), F.crc32(F.col("text").cast("binary"))).limit(SAMPLE)

    def run(batches):
        rows = []
        for part in A.chunks(batches, "text"):
            buckets, of = features(part.column("text"))
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(part.num_rows + 1))
            for i, y in enumerate(part.column("label").to_pylist()):
                own, n = np.unique(buckets[order[cuts[i] : cuts[i + 1]]], return_counts=True)
                rows.append((own.astype(np.int32), n.astype(np.int32), y))
        weights, bias = train(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([bias], pa.float64())],
            names=["weights", "bias"],
        )

    got = sample.coalesce(1).mapInArrow(run, "weights binary, bias double").first()
    if got is None:
        return np.zeros(1 << BUCKETS, np.float32), 0.0
    return np.frombuffer(got["weights"], np.float32), got["bias"]


def _fold(id: str, folds: int):
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % folds


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    folds: int = 5,
    held: int = 0,
    least: float = 0.3,
) -> DataFrame:
    """A row per document: id, held_out, score, predicted.

    ``score`` is the probability of label 1 by the text alone; ``predicted``
    is 1 from ``least`` on.  Labels of rows whose crc32 of the id as text is
    ``held`` modulo ``folds`` are never read.  Training takes at most
    ``SAMPLE`` labelled rows, in one task; scoring sums one number per n-gram
    of the whole text and needs no shuffle.

    Cases: a NULL or empty text has no n-grams and gets the score of the bias;
    labels that are NULL or neither 0 nor 1, or of unknown documents, are
    ignored, of contradicting ones 1 counts; without labels every score is
    1/2; a NULL id counts as the empty text in the fold; repeated rows are
    scored each; extra columns are ignored.
    """
    weights, bias = fit(docs, labels, id, text, label, folds, held)
    sent = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches):
        weights, bias = sent.value
        for part in A.chunks(batches, "text"):
            buckets, of = features(part.column("text"))
            n = np.bincount(of, minlength=part.num_rows)
            total = np.bincount(of, weights=weights[buckets], minlength=part.num_rows)
            odds = total / np.maximum(n, 1) + bias
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("held_out"), pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))],
                names=["id", "held_out", "score"],
            )

    plain = A.with_small_batches(docs).select(F.col(id).alias("id"), (_fold(id, folds) == held).alias("held_out"), F.col(text).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    scored = plain.mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id), "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"))
