"""Price files as they come, derived from the table ``part``: stray quotes, broken documents, colliding names.

A file for each of five hospitals (``r``), written whole by one task and named
alike in every run, so that a file can be delivered again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import fixtures as X
from pricelake.runtime import delete_folder, new_folder

HEADER = "description,code|1,code|1|type,setting,standard_charge|gross,standard_charge|discounted_cash"
HOSPITALS = 5
#: Longer than what is read of a file to find out its format.
LONG = 300_000


def _name(kind: str):
    if kind == "colliding":
        names = ["Northside Hospital", "Northern Hospital", "Southern Clinic", "Southside Clinic", "Lone Center"]
        return F.get(F.array(*[F.lit(n) for n in names]), F.col("r"))
    return F.concat(F.lit("Rough R"), F.col("r"), F.lit(" Hospital"))


def _meta(kind: str):
    updated = F.concat(F.lit("2025-0"), F.col("r") + 1, F.lit("-01"))
    return F.concat(
        F.lit("hospital_name,last_updated_on,version,hospital_location,hospital_address\n"),
        _name(kind),
        F.lit(","),
        updated,
        F.lit(',2.0.0,"Austin, TX","1 East St, Austin, TX 78613"'),
    )


def _line(description, cash="p_size"):
    return F.concat_ws(
        ",", description, F.col("p_partkey"), F.lit("CPT"), F.lit("outpatient"), F.col("p_size") + 1, F.col(cash) if isinstance(cash, str) else cash
    )


def _item(description, **more):
    return F.to_json(
        F.struct(
            description.alias("description"),
            F.array(F.struct(F.col("p_partkey").cast("string").alias("code"), F.lit("CPT").alias("type"))).alias("code_information"),
            F.array(
                F.struct(
                    F.lit("outpatient").alias("setting"),
                    F.col("p_size").alias("discounted_cash"),
                    (F.col("p_size") + 1).alias("gross_charge"),
                )
            ).alias("standard_charges"),
            *[v.alias(k) for k, v in more.items()],
        )
    )


def _document_start(kind: str):
    header = F.to_json(
        F.struct(
            _name(kind).alias("hospital_name"),
            F.array(F.lit("1 East St, Austin, TX 78613")).alias("hospital_address"),
            F.lit("2.0.0").alias("version"),
            F.lit("2025-01-01").alias("last_updated_on"),
        )
    )
    return F.concat(F.regexp_replace(header, r"\}$", ""), F.lit(',"standard_charge_information":[{}'))


def _rows(kind: str):
    """First rows, last rows and the row of a part, as Columns over (r, part)."""
    name = F.col("p_name")
    if kind == "inch":
        which = F.col("p_partkey") % 4
        description = (
            F.when(which == 0, F.concat(name, F.lit(' 5" LONG')))
            .when(which == 1, F.concat(F.lit('"say ""'), name, F.lit('"""')))
            .when(which == 2, F.concat(F.lit('"'), name, F.lit('\nsecond"')))
            .otherwise(name)
        )
        ends = [F.lit('"never closed,1,CPT,outpatient,2,1'), F.lit("after,2,CPT,outpatient,2,1")]
        return [_meta(kind), F.lit(HEADER)], ends, _line(description)
    if kind in ("plain", "colliding", "faulty"):
        cash = F.when(F.col("p_partkey") % 7 == 0, F.lit(10**12)).otherwise(F.col("p_size")) if kind == "faulty" else "p_size"
        return [_meta(kind), F.lit(HEADER)], [], _line(name, cash)
    if kind == "mixed":
        row = F.concat(F.lit(","), _item(name), F.lit(",["), _item(F.concat(name, F.lit(" b"))), F.lit(","), _item(F.concat(name, F.lit(" c"))), F.lit("]"))
        return [_document_start(kind)], [F.lit("]}")], row
    if kind == "truncated":
        end = F.lit(',{"description":"cut","code_information":[{"code":"1"')
        return [_document_start(kind)], [end], F.concat(F.lit(","), _item(name))
    if kind == "long":
        return [_item(name, note=F.repeat(F.lit("x"), F.lit(LONG)))], [], _item(name)
    raise ValueError(kind)


def write(spark: SparkSession, sf: str, kind: str, target: str, where: str = "true") -> None:
    """Files of one kind under ``target``/r=N, those written before replaced."""
    parts = X.table(spark, sf, "part").withColumn("r", (F.col("p_partkey") % HOSPITALS).cast("int")).where(where)
    first, last, row = _rows(kind)
    if kind == "long":
        # the first part of each file is the long line
        least = parts.groupBy("r").agg(F.min("p_partkey").alias("least"))
        rows = parts.join(F.broadcast(least), "r")
        rows = rows.select("r", F.col("p_partkey").cast("long").alias("at"), F.when(F.col("p_partkey") == F.col("least"), first[0]).otherwise(row).alias("row"))
    else:
        edges = [(-100 + i, c) for i, c in enumerate(first)] + [(10**12 + i, c) for i, c in enumerate(last)]
        heads = parts.select("r").distinct().select(
            "r", F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("at"), c.alias("row")) for i, c in edges]))
        )
        rows = parts.select("r", F.col("p_partkey").cast("long").alias("at"), row.alias("row")).unionByName(heads)
    aside = new_folder(spark, "rough")
    rows.repartition(HOSPITALS, "r").sortWithinPartitions("r", "at").select("r", "row").write.partitionBy("r").text(aside)
    extension = {"mixed": "json", "truncated": "json", "long": "json"}.get(kind, "csv")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    system = fs_path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in system.globStatus(fs_path(f"{aside}/r=*/part-*")):
        hospital = found.getPath().getParent().getName()
        system.mkdirs(fs_path(f"{target}/{hospital}"))
        goal = fs_path(f"{target}/{hospital}/prices.{extension}")
        system.delete(goal, False)
        system.rename(found.getPath(), goal)
    delete_folder(spark, aside)


def files(spark: SparkSession, sf: str, kind: str) -> str:
    """Pattern of newly written files of one kind."""
    target = new_folder(spark, f"rough-{kind}")
    write(spark, sf, kind, target)
    return target + "/r=*"


def given(files: DataFrame) -> DataFrame:
    """Explicit facility fields by path."""
    r = F.regexp_extract("path", "r=([0-9]+)", 1)
    return files.select(
        "path",
        F.concat(F.lit("Given G"), r, F.lit(" Clinic")).alias("facility_name"),
        F.lit("Dallas").alias("city"),
        F.lit("TX").alias("state"),
        F.lit("9 West St").alias("address"),
        F.lit("3.0.0").alias("file_version"),
        F.lit("2025-03-03").alias("last_updated"),
    )
