"""The query cache: validated append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pricelake.operators import quality as Q
from pricelake.schemas import QUERY_CACHE


def new_entries(entries: DataFrame, now: Column) -> DataFrame:
    """Entries in the shape of the cache, defaults filled in.

    Without the fallback an absent list or reasoning would be NULL where the
    cache holds an empty one.
    """
    defaults = {
        "hcpcs_codes": F.array().cast("array<string>"),
        "rc_codes": F.array().cast("array<string>"),
        "reasoning": F.lit(""),
    }
    filled = {
        c: F.coalesce(c, d) if c in entries.columns else d for c, d in defaults.items()
    }
    return (
        entries.withColumns({**filled, "created_at": now, "updated_at": now})
        .withColumn("confidence_score", F.col("confidence_score").try_cast("decimal(38,2)"))
        .select(*QUERY_CACHE.names)
    )


def append(entries: DataFrame, path: str, dimension: int, now: Column | None = None) -> DataFrame:
    """Append the valid ``entries``; returns the others with the rules they break."""
    shaped = new_entries(entries, F.current_timestamp() if now is None else now)
    checked = Q.check_cache(shaped, dimension)
    valid = Q.passing(checked).withColumn(
        "confidence_score", F.col("confidence_score").cast("decimal(3,2)")
    )
    valid.write.mode("append").parquet(path)
    return Q.failing(checked)
