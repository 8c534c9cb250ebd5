"""Best record per duplicate group, with the merged negotiated range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pricelake.schemas import POSITION

GROUP_KEY = ("facility_id", "description", "codes_key")


def score(cash_price: Column, gross_charge: Column) -> Column:
    """Any cash price beats any gross charge; among equals the higher price wins."""
    return (
        F.when(cash_price.isNotNull(), 1000 + cash_price)
        .when(gross_charge.isNotNull(), 500 + gross_charge * 0.1)
        .otherwise(F.lit(0.0))
    )


def best_records(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per (facility, description, codes), and per values of ``by`` (columns of the position) if given.

    The winner has the highest score, the earliest position among equal ones;
    it takes the smallest minimum and the largest maximum of its group.  All
    aggregates combine map-side, so a group of any size sends one row per map
    task, and results of separate batches can be merged by running this again.
    The group hash leads the key so that sorting compares 8-byte prefixes
    instead of long texts.
    """
    winner = F.min_by(
        F.struct("cash_price", "gross_charge", *POSITION),
        F.struct(
            (-score(F.col("cash_price"), F.col("gross_charge"))).alias("rank"), *POSITION
        ),
    )
    grouped = (
        rows.withColumn("group_hash", F.xxhash64(*GROUP_KEY))
        .groupBy("group_hash", *GROUP_KEY, *by)
        .agg(
            winner.alias("winner"),
            F.min("negotiated_min").alias("negotiated_min"),
            F.max("negotiated_max").alias("negotiated_max"),
        )
    )
    return grouped.select(
        *GROUP_KEY,
        "winner.cash_price",
        "winner.gross_charge",
        "negotiated_min",
        "negotiated_max",
        *[c if c in by else f"winner.{c}" for c in POSITION],
    )
