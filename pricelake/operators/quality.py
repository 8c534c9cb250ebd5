"""Table rules as reject reasons: a row is kept with the names of the rules it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pricelake.functions import prices as P
from pricelake.schemas import PRICE_FIELDS

# Widest text each column of the tables takes.
HOSPITAL_LENGTHS = {
    "facility_id": 255,
    "facility_name": 500,
    "city": 100,
    "state": 2,
    "file_version": 50,
    "last_updated": 50,
}
OPERATION_LENGTHS = {"facility_id": 255, "rc_code": 50, "hcpcs_code": 50, "currency": 3}

HOSPITAL_REQUIRED = (
    "facility_id",
    "facility_name",
    "city",
    "state",
    "address",
    "source_url",
    "file_version",
    "last_updated",
)
OPERATION_REQUIRED = ("facility_id", "codes", "description", "cash_price", "gross_charge")
FILE_REQUIRED = ("facility_name", "city", "state", "address")


def _broken(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold; an unknown outcome does not break one."""
    return F.array_compact(
        F.array(*[F.when(~holds, F.lit(name)) for name, holds in rules.items()])
    )


def _not_null(columns) -> dict[str, Column]:
    return {f"{c}_missing": F.col(c).isNotNull() for c in columns}


def _lengths(limits: dict[str, int]) -> dict[str, Column]:
    return {f"{c}_too_long": F.length(c) <= n for c, n in limits.items()}


def hospital_rules() -> dict[str, Column]:
    return {
        **_not_null(HOSPITAL_REQUIRED),
        "facility_id_format": F.col("facility_id").rlike("^[a-z0-9-]+$"),
        "state_format": F.col("state").rlike("^[A-Z]{2}$"),
        **_lengths(HOSPITAL_LENGTHS),
    }


def operation_rules() -> dict[str, Column]:
    return {
        **_not_null(OPERATION_REQUIRED),
        "facility_id_format": F.col("facility_id").rlike("^[a-z0-9-]+$"),
        "currency_format": F.col("currency").rlike("^[A-Z]{3}$"),
        **{f"{p}_negative": F.col(p) >= 0 for p in PRICE_FIELDS},
        **{f"{p}_out_of_range": P.fits_table_price(F.col(p)) for p in PRICE_FIELDS},
        "negotiated_range": F.col("negotiated_min") <= F.col("negotiated_max"),
        **_lengths(OPERATION_LENGTHS),
    }


def cache_rules(dimension: int) -> dict[str, Column]:
    return {
        **_not_null(("user_query", "confidence_score", "query_embedding")),
        "confidence_range": F.col("confidence_score").between(0, 1),
        "embedding_dimension": F.size("query_embedding") == dimension,
    }


def check_hospitals(hospitals: DataFrame) -> DataFrame:
    return hospitals.withColumn("broken_rules", _broken(hospital_rules()))


def check_operations(operations: DataFrame) -> DataFrame:
    return operations.withColumn("broken_rules", _broken(operation_rules()))


def check_cache(entries: DataFrame, dimension: int) -> DataFrame:
    return entries.withColumn("broken_rules", _broken(cache_rules(dimension)))


def missing_file_metadata() -> Column:
    """Required facility fields a file does not tell; a file with any is rejected."""
    return F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c))
                for c in FILE_REQUIRED
            ]
        )
    )


def passing(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("broken_rules") == 0).drop("broken_rules")


def failing(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("broken_rules") > 0)


def id_collisions(hospitals: DataFrame) -> DataFrame:
    """Facility ids that more than one hospital row claims."""
    return (
        hospitals.groupBy("facility_id")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min("facility_name").alias("first_name"),
            F.max("facility_name").alias("last_name"),
        )
        .where(F.col("n_rows") > 1)
    )


def orphans(operations: DataFrame, hospitals: DataFrame) -> DataFrame:
    """Operations whose facility has no hospital row."""
    return operations.join(hospitals.select("facility_id"), "facility_id", "left_anti")
