"""Counters per file and per run, and error samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pricelake.operators import normalize as N

REASONS = (N.NO_STANDARD_CODE, N.NO_CASH_PRICE, N.NOT_OUTPATIENT)
#: Reasons of lines that could not be read as records, from ``sources``.
FAULTS = ("unclosed_quote", "incomplete_item")


def line_counts(lines: DataFrame) -> DataFrame:
    """Per file: lines read, accepted, rejected, and rejected for each reason."""
    return lines.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("read_records"),
        F.count_if(F.size("reasons") == 0).alias("accepted_records"),
        F.count_if(F.size("reasons") > 0).alias("failed_records"),
        *[F.count_if(F.array_contains("reasons", r)).alias(r) for r in REASONS],
        F.count_if(F.arrays_overlap("reasons", F.array(*[F.lit(f) for f in FAULTS]))).alias("broken_records"),
    )


def winner_counts(winners: DataFrame) -> DataFrame:
    return winners.groupBy("source_file").agg(F.count(F.lit(1)).alias("successful_records"))


def run_counts(lines: DataFrame, winners: DataFrame) -> DataFrame:
    """Counters per source file; read = successful + failed + duplicate."""
    zero = F.lit(0)
    return (
        line_counts(lines)
        .join(winner_counts(winners), "source_file", "left")
        .withColumn("successful_records", F.coalesce("successful_records", zero))
        .withColumn(
            "duplicate_records", F.col("accepted_records") - F.col("successful_records")
        )
        .withColumn("total_records", F.col("successful_records") + F.col("failed_records"))
    )


def file_report(
    catalog: DataFrame, lines: DataFrame, winners: DataFrame, seconds: float = 0.0
) -> DataFrame:
    """One row per catalogued file, files that could not be loaded included.

    A loaded file with lines that are no records has status 'malformed'.
    ``error`` is what went wrong in reading the file.  ``processing_seconds``
    is the time its head took, and its share by size of the ``seconds`` in
    which the lines of all files were read together.
    """
    counts = run_counts(lines, winners).withColumnRenamed("source_file", "file")
    known = catalog.select(
        "file",
        "path",
        "facility_id",
        "format",
        "size_bytes",
        "status",
        "error",
        "head_seconds",
        F.array_union(
            F.coalesce("missing_metadata", F.array().cast("array<string>")),
            F.coalesce("missing_fields", F.array().cast("array<string>")),
        ).alias("missing"),
    )
    numbers = [c for c in counts.columns if c != "file"]
    loaded = known.where(F.col("status") == "ok").agg(
        F.greatest(F.sum("size_bytes"), F.lit(1)).alias("loaded_bytes")
    )
    share = F.when(F.col("status") == "ok", F.lit(seconds) * F.col("size_bytes") / F.col("loaded_bytes"))
    return (
        known.join(counts, "file", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})
        .join(F.broadcast(loaded))
        .withColumn(
            "processing_seconds",
            F.coalesce("head_seconds", F.lit(0.0)) + F.coalesce(share, F.lit(0.0)),
        )
        .withColumn(
            "status",
            F.when((F.col("status") == "ok") & (F.col("broken_records") > 0), F.lit("malformed")).otherwise(
                F.col("status")
            ),
        )
        .drop("file", "head_seconds", "loaded_bytes")
    )


def totals(report: DataFrame) -> DataFrame:
    """Sums over all files of a report."""
    return report.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("total_records").alias("total_records"),
        F.sum("successful_records").alias("successful_records"),
        F.sum("failed_records").alias("failed_records"),
        *(
            [
                F.count_if(F.col("error").isNotNull()).alias("file_errors"),
                F.sum("processing_seconds").alias("processing_seconds"),
            ]
            if "processing_seconds" in report.columns
            else []
        ),
    )


def error_sample(rejected: DataFrame, limit: int = 5) -> DataFrame:
    """Per file: reasons of its first rejected lines, and how many more there are.

    The rank filter runs before the shuffle, so no file sends more than
    ``limit`` lines per task; the rest only counts.
    """
    order = Window.partitionBy("source_file").orderBy("source_block", "source_row")
    first = (
        rejected.select("source_file", "source_block", "source_row", "reasons")
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= limit)
        .groupBy("source_file")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("n", F.array_join("reasons", ",").alias("r")))),
                lambda x: x["r"],
            ).alias("errors")
        )
    )
    counted = rejected.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_errors"))
    return counted.join(first, "source_file").withColumn(
        "more_errors", F.col("n_errors") - F.size("errors")
    )
