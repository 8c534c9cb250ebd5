"""Queries over the two tables."""

from __future__ import annotations

from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pricelake.functions import codes as C, prices as P


def hospitals_matching(
    hospitals: DataFrame, facility_id: str | None = None, state: str | None = None
) -> DataFrame:
    if facility_id:
        hospitals = hospitals.where(F.col("facility_id") == facility_id)
    if state:
        hospitals = hospitals.where(F.col("state") == state)
    return hospitals


def latest_hospitals(
    hospitals: DataFrame,
    facility_id: str | None = None,
    state: str | None = None,
    limit: int = 10,
) -> DataFrame:
    """Most recently ingested hospitals; equal times by facility id."""
    found = hospitals_matching(hospitals, facility_id, state)
    return found.orderBy(F.desc_nulls_first("ingested_at"), "facility_id").limit(limit)


def _bound(operations: DataFrame, price: float, rounding: str) -> Column:
    """Price bound in the type of the stored column, so that it reaches the scan.

    Rounding inwards to the scale of the column keeps the same rows.
    """
    stored = operations.schema["cash_price"].dataType
    if not isinstance(stored, T.DecimalType):
        return F.lit(price)
    exact = Decimal(str(price)).quantize(Decimal(1).scaleb(-stored.scale), rounding=rounding)
    if abs(exact) >= Decimal(10) ** (stored.precision - stored.scale):
        return F.lit(price)
    return F.lit(str(exact)).cast(stored)


def operations_matching(
    operations: DataFrame,
    facility_id: str | None = None,
    min_price: float | None = None,
    max_price: float | None = None,
    description: str | None = None,
) -> DataFrame:
    """Inclusive price bounds; ``description`` may hold % and _ wildcards."""
    if facility_id:
        operations = operations.where(F.col("facility_id") == facility_id)
    if min_price is not None:
        operations = operations.where(
            F.col("cash_price") >= _bound(operations, min_price, ROUND_CEILING)
        )
    if max_price is not None:
        operations = operations.where(
            F.col("cash_price") <= _bound(operations, max_price, ROUND_FLOOR)
        )
    if description:
        operations = operations.where(F.col("description").ilike(f"%{description}%"))
    return operations


def with_facility_name(operations: DataFrame, hospitals: DataFrame) -> DataFrame:
    """Inner join; the smaller side is broadcast when its measured size allows."""
    return operations.join(hospitals.select("facility_id", "facility_name"), "facility_id")


def most_expensive(
    operations: DataFrame, hospitals: DataFrame, limit: int = 10, **filters
) -> DataFrame:
    """Matching operations with facility name, by falling cash price.

    Equal prices are ordered by facility, description and codes, so that the
    cut is the same on every run.
    """
    found = with_facility_name(operations_matching(operations, **filters), hospitals)
    return (
        found.withColumn("codes_key", C.codes_text(F.col("codes")))
        .orderBy(F.desc_nulls_first("cash_price"), "facility_id", "description", "codes_key")
        .limit(limit)
    )


def display(operations: DataFrame) -> DataFrame:
    """The same rows with prices as text."""
    return operations.withColumns(
        {
            "cash_text": P.money_or_na(F.col("cash_price")),
            "gross_text": P.money_or_na(F.col("gross_charge")),
            "negotiated_text": P.money_range(F.col("negotiated_min"), F.col("negotiated_max")),
        }
    )


def with_code(operations: DataFrame, code: str, code_type: str | None = None) -> DataFrame:
    """Operations that list ``code``, under ``code_type`` if given.

    The map of codes is opened for every row; where the code is known to be
    the primary one, ``with_primary_code`` skips row groups by their
    statistics.
    """
    if code_type is None:
        return operations.where(C.has_code(F.col("codes"), code))
    listed = F.array_contains(F.try_element_at("codes", F.lit(code_type)), code)
    return operations.where(F.coalesce(listed, F.lit(False)))


def with_primary_code(
    operations: DataFrame, hcpcs_code: str | None = None, rc_code: str | None = None
) -> DataFrame:
    """Operations by their first HCPCS or revenue code; filters reach the scan."""
    if hcpcs_code:
        operations = operations.where(F.col("hcpcs_code") == hcpcs_code)
    if rc_code:
        operations = operations.where(F.col("rc_code") == rc_code)
    return operations


def facility_stats(operations: DataFrame) -> DataFrame:
    """Count, and exact sums, counts and extremes of the prices, per facility; each map task sends one row per facility."""
    prices = ("cash_price", "gross_charge")
    return operations.groupBy("facility_id").agg(
        F.count(F.lit(1)).alias("total_operations"),
        *[getattr(F, how)(price).alias(f"{how}_{price}") for price in prices for how in ("sum", "min", "max", "count")],
    )


def summary_of(hospitals: DataFrame, stats: DataFrame) -> DataFrame:
    """Counts and cash statistics per hospital from ``facility_stats``; hospitals without operations stay."""
    mean = lambda price: F.col(f"sum_{price}").cast("double") / F.col(f"count_{price}")
    return hospitals.join(stats, "facility_id", "left").select(
        "facility_id",
        "facility_name",
        "city",
        "state",
        F.coalesce("total_operations", F.lit(0)).alias("total_operations"),
        mean("cash_price").alias("avg_cash_price"),
        "min_cash_price",
        "max_cash_price",
        mean("gross_charge").alias("avg_gross_charge"),
        "last_updated",
        "ingested_at",
    )


def pricing_summary(hospitals: DataFrame, operations: DataFrame) -> DataFrame:
    """Counts and cash statistics per hospital; hospitals without operations stay.

    Operations are aggregated before the join, so neither their number nor a
    hot facility matters to it.
    """
    return summary_of(hospitals, facility_stats(operations))


def purge(
    operations: DataFrame, hospitals: DataFrame, facility_ids: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both tables without the given facilities, and how many rows went.

    ``facility_ids`` is a DataFrame with that column; None purges everything.
    """
    if facility_ids is None:
        kept_ops, kept_hospitals = operations.where(F.lit(False)), hospitals.where(F.lit(False))
        gone_ops, gone_hospitals = operations, hospitals
    else:
        ids = facility_ids.select("facility_id").distinct()
        kept_ops = operations.join(ids, "facility_id", "left_anti")
        kept_hospitals = hospitals.join(ids, "facility_id", "left_anti")
        gone_ops = operations.join(ids, "facility_id", "left_semi")
        gone_hospitals = hospitals.join(ids, "facility_id", "left_semi")
    count = lambda df, name: df.select(F.lit(name).alias("table_name")).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("deleted_rows")
    )
    deleted = count(gone_ops, "medical_operations").unionByName(count(gone_hospitals, "hospitals"))
    return kept_ops, kept_hospitals, deleted
