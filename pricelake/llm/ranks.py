"""Positions in a total order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def positions(df: DataFrame, cell: Column, order: list[Column], name: str, by: list[str] = ()) -> DataFrame:
    """``df`` with ``name``: the position (long, from 0) of each row in its group ``by``, in the order of ``cell``, then ``order``.

    ``cell`` is a number that cuts the order into many small cells.  Rows are
    numbered inside their cell; how many lie in earlier cells follows from
    the cells' counts, which are few and summed up in the tasks that read them.
    """
    keys = [*by, "cell"]
    df = df.withColumn("cell", cell)
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"{k}_at") for k in keys], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_at")) for k in keys]
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    numbered = df.withColumn("inside", inside)
    return (
        numbered.join(starts, same)
        .withColumn(name, F.col("start") + F.col("inside"))
        .drop("cell", "start", "inside", *[f"{k}_at" for k in keys])
    )
