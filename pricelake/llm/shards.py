"""Shards that all hold the same mixture of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pricelake.llm import ranks
from pricelake.runtime import written

#: Rows that are numbered together, about; more where there are more than its square, so that cells stay few too.
CELL = 1_000


def stratified_shards(
    docs: DataFrame, shards: int = 16, id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix"
) -> DataFrame:
    """A row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    Rows of each source are shuffled by a seeded hash and get a fractional
    rank, (rank + 1/2) / rows of the source.  All rows in the order of that
    rank are cut into ``shards`` equal runs, so each run has every source in
    proportion, and so has every part of a run.  Law ``rows``: counts differ
    by one at most.

    Cases: a NULL text has size 1 and the checksum of the empty text; a NULL
    source is a source of its own; rows with equal ids and NULL ids are told
    apart by text, and rows equal in all of that are interchangeable; an empty
    table gives no rows; extra columns are ignored.
    """
    plain = docs.select(
        F.col(id).alias("id"),
        F.col(source).cast("string").alias("source"),
        (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(F.concat_ws("/", F.lit(seed), F.col(id).cast("string")).cast("binary"))).alias("draw"),
    )
    rows = written(plain, "shard-rows")
    sizes = rows.groupBy("source").agg(F.count("*").alias("rows")).withColumnRenamed("source", "of")
    rows = rows.join(sizes, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    order = [F.col("draw"), F.col("id"), F.col("text_crc32"), F.col("size")]
    drawn = F.conv(F.substring(F.hex("draw"), 1, 8), 16, 10).cast("long") / F.lit(1 << 32)
    cell = F.floor(drawn * F.ceil(F.col("rows") / F.greatest(F.lit(float(CELL)), F.sqrt("rows"))))
    ranked = ranks.positions(rows, cell, order, "rank", ["source"])
    placed = ranked.withColumn("fraction", (F.col("rank") * 2 + 1) / (F.col("rows") * 2))
    placed = written(placed.select("id", "size", "text_crc32", "draw", "fraction", "source"), "shard-ranks")
    total = placed.count()
    cells = max(1, int(total / max(CELL, total**0.5)))
    order = [F.col("fraction"), F.col("source"), *order]
    placed = ranks.positions(placed, F.floor(F.col("fraction") * cells), order, "position")
    n = F.lit(max(1, total))
    # shard = position * shards / n, so a shard starts at the first position with position * shards >= shard * n
    return placed.withColumn("shard", _exact(F.col("position") * shards, n)).select(
        F.col("id").alias(id),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("position") - _exact(F.col("shard") * n + (shards - 1), F.lit(shards))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _exact(a, b):
    """Whole part of a / b of two non-negative long Columns."""
    return ((a - a % b) / b).cast("long")
