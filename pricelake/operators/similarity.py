"""Cosine search of cached queries."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

MIN_CONFIDENCE = 0.9
THRESHOLD = 0.90
MATCHES = 5

# Query vectors held by every task at a time, in bytes of float64.
BLOCK_BYTES = 64 * 1024 * 1024
# Similarities a task holds at a time, in bytes.
PRODUCT_BYTES = 64 * 1024 * 1024


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equally long vectors; NULL when either has no length."""
    dot = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    norm = lambda v: F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    )
    return F.try_divide(dot, norm(a) * norm(b))


def confident(cache: DataFrame) -> DataFrame:
    return cache.where(F.col("confidence_score") >= MIN_CONFIDENCE)


def comparable(vector: Column, dimension: int) -> Column:
    """True for vectors of ``dimension`` numbers; others can't be compared and are no hits."""
    return (F.size(vector) == dimension) & ~F.exists(vector, lambda x: x.isNull())


def search(
    cache: DataFrame,
    vector: list[float],
    threshold: float = THRESHOLD,
    limit: int = MATCHES,
) -> DataFrame:
    """Confident entries closer to ``vector`` than ``threshold``, nearest first."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    return (
        confident(cache)
        .where(comparable(F.col("query_embedding"), len(vector)))
        .withColumn("similarity", cosine(F.col("query_embedding"), query))
        .where(F.col("similarity") > threshold)
        .drop("query_embedding")
        .orderBy(F.desc("similarity"), "id")
        .limit(limit)
    )


def degraded_search(cache: DataFrame, limit: int = MATCHES) -> DataFrame:
    """Confident entries without similarity, for when vectors cannot be compared."""
    return confident(cache).drop("query_embedding").orderBy("id").limit(limit)


def _block_hits(ids, matrix, threshold: float, limit: int):
    """Task function: ``limit`` best hits of each query in each batch of entries."""
    import numpy as np
    import pandas as pd

    def unit(m):
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(norms > 0, m / norms, np.nan)

    def hits(batches: Iterator) -> Iterator:
        queries = unit(matrix.value)
        for batch in batches:
            if batch.empty:
                continue
            entries = unit(np.stack(batch["query_embedding"].to_numpy()).astype("float64"))
            step = max(1, PRODUCT_BYTES // (8 * len(entries)))
            for start in range(0, len(queries), step):
                sims = entries @ queries[start : start + step].T
                keep = sims > threshold
                if limit < len(entries):
                    # Anything below the limit-th best of its batch cannot be
                    # among the best of all; ties with it stay.
                    ranked = np.where(keep, sims, -np.inf)
                    keep &= sims >= np.partition(ranked, -limit, axis=0)[-limit]
                row, col = np.nonzero(keep)
                yield pd.DataFrame(
                    {
                        "query_id": ids.value[start + col],
                        "id": batch["id"].to_numpy()[row],
                        "similarity": sims[row, col],
                    }
                )

    return hits


def search_many(
    cache: DataFrame,
    queries: DataFrame,
    threshold: float = THRESHOLD,
    limit: int = MATCHES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(query_id, id, similarity, rank) of the nearest entries of each query vector.

    ``queries`` holds (query_id, query_vector).  The cache is scanned in place;
    each Arrow batch is multiplied with a block of query vectors whose size is
    bounded, and only hits above the threshold that can still be among the best
    leave the task.  More queries than one block holds take one scan per block.
    Vectors that are NULL or hold NULLs are skipped, and vectors are compared
    with those of the same length.
    """
    import numpy as np

    spark = cache.sparkSession
    entries = confident(cache).select("id", "query_embedding")
    queries = queries.where("query_vector IS NOT NULL AND NOT exists(query_vector, x -> x IS NULL)")
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", cache.schema["id"].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    hits = None
    for ids, matrix in _blocks(queries, block_bytes):
        found = entries.where(comparable(F.col("query_embedding"), len(matrix[0]))).mapInPandas(
            _block_hits(
                spark.sparkContext.broadcast(np.array(ids)),
                spark.sparkContext.broadcast(np.array(matrix, dtype="float64")),
                threshold,
                limit,
            ),
            schema,
        )
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _blocks(queries: DataFrame, block_bytes: int) -> Iterator[tuple[list, list]]:
    """Query vectors of one length in blocks of bounded size, streamed partition by partition."""
    blocks: dict[int, tuple[list, list]] = {}
    for row in queries.select("query_id", "query_vector").toLocalIterator():
        n = len(row.query_vector)
        ids, vectors = blocks.setdefault(n, ([], []))
        ids.append(row.query_id)
        vectors.append(row.query_vector)
        if 8 * n * len(ids) >= block_bytes:
            yield blocks.pop(n)
    yield from (block for n, block in blocks.items() if n)
