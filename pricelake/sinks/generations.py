"""Tables that many runs write: generations of rows that one commit publishes together.

A run writes the rows it makes, of all tables, into a generation of its own,
with the keys whose older rows these replace.  Nothing of it is visible until
a commit file that names it is renamed into place, which is one atomic step:
readers take the latest commit and see all tables as one run left them.  A row
counts unless a later generation replaces its key, so what a run writes
follows what it changes, not the size of the tables.  Generations are merged,
small ones first, before they become many, and those that no recent commit
names are deleted.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pricelake.runtime import delete_folder
from pricelake.schemas import HOSPITALS, OPERATIONS, POSITION, PRICE_FIELDS, STORED_HOSPITALS, STORED_OPERATIONS

#: Generations that a commit may name, and commits whose generations are kept for readers that began before the last one.
MOST_GENERATIONS, KEPT_COMMITS = 8, 3

_text = lambda *names: [T.StructField(n, T.StringType()) for n in names]
_GROUP = [T.StructField("group_hash", T.LongType())]
_RULES = [T.StructField("broken_rules", T.ArrayType(T.StringType()))]
_FILES = [f for f in HOSPITALS.fields if f.name != "ingested_at"]
_PRICES = [T.StructField(p, T.DoubleType()) for p in PRICE_FIELDS]
_POSITION = [T.StructField(p, T.StringType() if p == "source_file" else T.LongType()) for p in POSITION]
_STATS = [
    T.StructField("total_operations", T.LongType()),
    *[
        T.StructField(f"{how}_{price}", kind)
        for price in ("cash_price", "gross_charge")
        for how, kind in (("sum", T.DecimalType(28, 2)), ("min", T.DecimalType(10, 2)), ("max", T.DecimalType(10, 2)), ("count", T.LongType()))
    ],
]


@dataclass(frozen=True)
class Table:
    """Columns of a table, what deals its rows to buckets, their order in a file, and what replaces them."""

    schema: T.StructType
    bucket_by: str
    buckets: int
    order: tuple[str, ...]
    replaced_by: tuple[str, ...]


#: Keys that a generation replaces: groups of duplicates, files, facilities in small tables, and facilities as a whole.
REPLACED = {
    "groups": ("facility_id", "description", "group_hash"),
    "loaded": ("source_file",),
    "touched": ("facility_id",),
    "cleared": ("facility_id",),
}
_KEY_TYPES = {"group_hash": T.LongType()}

TABLES = {
    "medical_operations": Table(
        T.StructType([*STORED_OPERATIONS.fields, *_GROUP]), "facility_id", 32, ("facility_id", "hcpcs_code", "rc_code"), ("groups", "cleared")
    ),
    "operations_by_code": Table(
        T.StructType([*STORED_OPERATIONS.fields, *_text("code_type", "code"), T.StructField("is_first", T.BooleanType()), *_GROUP]),
        "code", 64, ("code", "code_type", "facility_id"), ("groups", "cleared"),
    ),
    "quarantine_operations": Table(T.StructType([*OPERATIONS.fields, *_RULES, *_GROUP]), "facility_id", 8, ("facility_id",), ("groups", "cleared")),
    "state": Table(
        T.StructType([*_text("facility_id", "description", "codes_key"), *_PRICES, *_POSITION, *_GROUP]),
        "facility_id", 32, ("facility_id", "group_hash"), ("loaded", "cleared"),
    ),
    "hospitals": Table(STORED_HOSPITALS, "facility_id", 1, ("facility_id",), ("touched",)),
    "quarantine_hospitals": Table(T.StructType([*HOSPITALS.fields, *_RULES]), "facility_id", 1, ("facility_id",), ("touched",)),
    "files": Table(T.StructType([*_text("source_file"), *_FILES]), "facility_id", 1, ("facility_id",), ("touched",)),
    "summaries": Table(T.StructType([*_text("facility_id"), *_STATS]), "facility_id", 1, ("facility_id",), ("touched",)),
    **{
        name: Table(T.StructType([T.StructField(k, _KEY_TYPES.get(k, T.StringType())) for k in keys]), keys[0], 1, keys, ())
        for name, keys in REPLACED.items()
    },
}


@dataclass(frozen=True)
class Generation:
    """Rows of one run: its name, how many records it holds, and the buckets it has of each table."""

    name: str
    records: int
    buckets: dict[str, list[int]]


def bucket_of(table: str, value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(TABLES[table].buckets)).cast("int")


class Snapshot:
    """What a commit names: generations, oldest first."""

    def __init__(self, spark: SparkSession, folder: str, number: int = 0, generations: tuple[Generation, ...] = ()):
        self.spark, self.folder, self.number, self.generations = spark, folder, number, tuple(generations)

    def _scan(self, table: str, generations: list[int], values: list | None = None) -> DataFrame:
        """Rows of some generations with ``at``, the generation's place; only of the buckets of ``values`` if given."""
        schema = T.StructType([*TABLES[table].schema.fields, T.StructField("generation", T.StringType())])
        names = {self.generations[k].name: k for k in generations}
        wanted = None if values is None else self._buckets(table, values)
        paths = []
        for k in generations:
            own = self.generations[k].buckets.get(table, [])
            base = f"{self.folder}/{table}/generation={self.generations[k].name}"
            if wanted is None:
                paths += [base] if own else []
            else:
                paths += [f"{base}/bucket={b}" for b in own if b in wanted]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("at", F.lit(0)).drop("generation")
        rows = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{table}").parquet(*paths)
        at = F.lit(None).cast("int")
        for name, k in names.items():
            at = F.when(F.col("generation") == name, F.lit(k)).otherwise(at)
        return rows.select(*TABLES[table].schema.names, at.alias("at"))

    def _buckets(self, table: str, values: list) -> set[int]:
        if TABLES[table].buckets == 1:
            return {0}
        rows = self.spark.range(1).select(F.explode(F.lit(list(values))).alias("v")).select(bucket_of(table, F.col("v")).alias("b"))
        return {r.b for r in rows.distinct().collect()}

    def read(self, table: str, values: list | None = None) -> DataFrame:
        """The rows of ``table`` that no later generation replaces; ``values`` of the column that deals them to buckets spare the rest."""
        every = list(range(len(self.generations)))
        rows = self._scan(table, every, values)
        for kind in TABLES[table].replaced_by:
            # the oldest generation replaces nothing
            later = [k for k in every[1:] if self.generations[k].buckets.get(kind)]
            if later:
                keys = list(REPLACED[kind])
                gone = self._scan(kind, later).groupBy(*keys).agg(F.max("at").alias("gone_at"))
                rows = rows.join(gone, keys, "left").where(F.coalesce("gone_at", F.lit(-1)) <= F.col("at")).drop("gone_at")
        return rows.select(*TABLES[table].schema.names)

    def with_generation(self, generation: Generation) -> Snapshot:
        return Snapshot(self.spark, self.folder, self.number + 1, (*self.generations, generation))

    def files(self) -> int:
        """Data files of all tables."""
        return sum(
            sum(p.endswith(".parquet") for p in _names(self.spark, f"{self.folder}/{table}/generation={g.name}/bucket={b}"))
            for g in self.generations
            for table, own in g.buckets.items()
            for b in own
        )


def _system(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it is missing."""
    at, system = _system(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def _commits(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in _names(spark, f"{folder}/_commits") if n.endswith(".json") and n[0] != "_")


def snapshot(spark: SparkSession, folder: str, number: int | None = None) -> Snapshot:
    """The tables as the latest commit, or that of the given number, left them; empty where there is none."""
    found = _commits(spark, folder)
    number = (found[-1] if found else 0) if number is None else number
    if number == 0:
        return Snapshot(spark, folder)
    path, system = _system(spark, f"{folder}/_commits/{number:012d}.json")
    stream = system.open(path)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return Snapshot(spark, folder, number, tuple(Generation(**g) for g in json.loads(text)["generations"]))


def write(rows: DataFrame, folder: str, table: str, name: str) -> None:
    """Rows of one table into a generation; large buckets are split over tasks, small ones share a task."""
    spec = TABLES[table]
    dealt = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.schema.fields])
    dealt = dealt.withColumn("bucket", bucket_of(table, F.col(spec.bucket_by)))
    (
        (dealt.hint("rebalance", "bucket") if spec.buckets > 1 else dealt.hint("rebalance"))
        .sortWithinPartitions("bucket", *spec.order)
        .write.partitionBy("bucket")
        .parquet(f"{folder}/{table}/generation={name}")
    )


def new_name(found: Snapshot) -> str:
    """A name of its own for each run, also if one before it broke off."""
    return f"{found.number + 1:06d}-{uuid.uuid4().hex[:8]}"


def finished(spark: SparkSession, folder: str, name: str) -> Generation:
    """The generation as it lies in the folder."""
    buckets = {}
    for table in TABLES:
        own = [int(n.removeprefix("bucket=")) for n in _names(spark, f"{folder}/{table}/generation={name}") if n.startswith("bucket=")]
        if own:
            buckets[table] = own
    records = spark.read.parquet(f"{folder}/state/generation={name}").count() if "state" in buckets else 0
    return Generation(name, records, buckets)


class Outrun(RuntimeError):
    """Another run has published since this one read the tables."""


def publish(new: Snapshot) -> None:
    """The atomic step: a commit file appears under its number, if there is none yet."""
    spark, folder = new.spark, new.folder
    text = json.dumps({"generations": [vars(g) for g in new.generations]})
    aside, system = _system(spark, f"{folder}/_commits/_{uuid.uuid4().hex}")
    stream = system.create(aside)
    stream.write(bytearray(text.encode()))
    stream.close()
    final, _ = _system(spark, f"{folder}/_commits/{new.number:012d}.json")
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
    if system.exists(final):
        raise Outrun(f"commit {new.number} of {folder} has been published by another run")
    context.rename(system.makeQualified(aside), system.makeQualified(final), options)


def compacted(found: Snapshot) -> Snapshot:
    """A snapshot of fewer generations: the newest ones merged as far as that is cheap, at least until half of the most are left.

    An older generation is merged too as long as it holds at most twice the
    records of those after it, so every record is rewritten a number of times
    that follows the logarithm of the tables' size.
    """
    spark, folder, generations = found.spark, found.folder, found.generations
    first, records = len(generations) - 1, generations[-1].records
    while first and (first + 1 > MOST_GENERATIONS // 2 or generations[first - 1].records <= 2 * records):
        first -= 1
        records += generations[first].records
    part = Snapshot(spark, folder, found.number, generations[first:])
    name = new_name(found)
    for table, spec in TABLES.items():
        if spec.replaced_by:
            write(part.read(table), folder, table, name)
        elif first:
            write(part._scan(table, list(range(len(part.generations)))).select(*spec.schema.names).distinct(), folder, table, name)
    return Snapshot(spark, folder, found.number + 1, (*generations[:first], finished(spark, folder, name)))


def vacuum(spark: SparkSession, folder: str, kept: int = KEPT_COMMITS) -> None:
    """Deletes what none of the last ``kept`` commits names: replaced generations and those of runs that broke off."""
    numbers = _commits(spark, folder)
    named = {g.name for n in numbers[-kept:] for g in snapshot(spark, folder, n).generations}
    for table in TABLES:
        for entry in _names(spark, f"{folder}/{table}"):
            if entry.startswith("generation=") and entry.removeprefix("generation=") not in named:
                delete_folder(spark, f"{folder}/{table}/{entry}")
    for n in numbers[:-kept]:
        delete_folder(spark, f"{folder}/_commits/{n:012d}.json")
    for entry in _names(spark, f"{folder}/_commits"):
        if entry.startswith("_"):
            delete_folder(spark, f"{folder}/_commits/{entry}")


def commit(found: Snapshot, name: str) -> Snapshot:
    """Publishes the generation after those of ``found``; merges generations and deletes old ones where it is time."""
    new = found.with_generation(finished(found.spark, found.folder, name))
    publish(new)
    if len(new.generations) > MOST_GENERATIONS:
        new = compacted(new)
        publish(new)
    vacuum(found.spark, found.folder)
    return new
