"""Ingesting files: catalog, scan, normalise, de-duplicate, report."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pricelake.operators import dedup as D, normalize as N
from pricelake.plans import report as R
from pricelake.runtime import written
from pricelake.schemas import HOSPITALS, OPERATIONS
from pricelake.sources import catalog as K, charges as X, sniff as S


@dataclass(frozen=True)
class Options:
    """How charge lines are accepted."""

    outpatient_only: bool = True
    require_cash_price: bool = True
    dedup: bool = True
    ingested_at: datetime | None = None

    def clock(self) -> Column:
        if self.ingested_at is None:
            return F.current_timestamp()
        return F.lit(self.ingested_at).cast("timestamp")


@dataclass(frozen=True)
class Ingested:
    """Results of one run; all but ``catalog`` and ``lines`` are lazy plans over these two."""

    catalog: DataFrame
    lines: DataFrame
    hospitals: DataFrame
    operations: DataFrame
    rejected: DataFrame
    report: DataFrame
    options: Options
    #: In which the lines of all files were read.
    seconds: float = 0.0


def best_operations(accepted: DataFrame, dedup: bool = True) -> DataFrame:
    """Accepted lines, one per duplicate group unless ``dedup`` is off."""
    return D.best_records(accepted) if dedup else accepted


def to_operations(rows: DataFrame, clock: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows in the shape of the operations table, and the columns to ``keep`` beside it."""
    return (
        N.with_codes(rows)
        .withColumns({"currency": F.lit("USD"), "ingested_at": clock})
        .select(*OPERATIONS.names, *keep)
    )


#: Ways in which price files write dates.
DATES = ("yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "yyyy/MM/dd", "yyyyMMdd", "MM-dd-yyyy", "MMMM d, yyyy")


def date_of(text: Column) -> Column:
    """Date of a text in one of the usual ways; NULL where it is none."""
    tries = [F.try_to_timestamp(F.left(F.trim(text), F.lit(10)), F.lit("yyyy-MM-dd"))]
    tries += [F.try_to_timestamp(F.trim(text), F.lit(form)) for form in DATES[1:]]
    return F.coalesce(*tries).cast("date")


def loaded_files(catalog: DataFrame) -> DataFrame:
    """What each loaded file tells of its hospital: the hospital columns and ``source_file``."""
    return catalog.where(F.col("status") == "ok").select(
        F.col("file").alias("source_file"),
        *[F.col("path" if c == "source_url" else c).alias(c) for c in HOSPITALS.names if c != "ingested_at"],
    )


def latest_of_files(files: DataFrame, clock: Column) -> DataFrame:
    """One hospital row per facility; of several files the latest update tells."""
    latest = F.max_by(
        F.struct(*[c for c in HOSPITALS.names if c not in ("facility_id", "ingested_at")]),
        F.struct(
            F.coalesce(date_of(F.col("last_updated")), F.lit("0001-01-01").cast("date")),
            F.coalesce("last_updated", F.lit("")),
            "source_url",
        ),
    )
    return (
        files.groupBy("facility_id")
        .agg(latest.alias("h"))
        .select("facility_id", "h.*", clock.alias("ingested_at"))
        .select(*HOSPITALS.names)
    )


def to_hospitals(catalog: DataFrame, clock: Column) -> DataFrame:
    return latest_of_files(loaded_files(catalog), clock)


def _write_lines(raw: DataFrame, catalog: DataFrame, options: Options) -> DataFrame:
    """Normalised lines, written once, split by outcome.

    A line that reads like the header or one above it is one only if it is
    among the first such lines of its file, as many as there are; those few
    are told apart by position after the writing.
    """
    normalized = N.normalize(
        raw, options.outpatient_only, options.require_cash_price, keep=(X.MAYBE_TOP,)
    )
    lines = written(
        normalized.withColumn("accepted", F.size("reasons") == 0), "lines", ("accepted", X.MAYBE_TOP)
    )
    above = catalog.select(
        F.col("file").alias("source_file"),
        F.size(F.filter("top_texts", lambda t: F.trim(t) != "")).alias("n_top"),
    )
    order = Window.partitionBy("source_file").orderBy("source_block", "source_row")
    repeated = (
        lines.where(F.col(X.MAYBE_TOP))
        .withColumn("nth", F.row_number().over(order))
        .join(above, "source_file")
        .where(F.col("nth") > F.col("n_top"))
        .select(*lines.columns)
    )
    return lines.where(~F.col(X.MAYBE_TOP)).unionByName(repeated).drop(X.MAYBE_TOP)


def normalized_lines(catalog: DataFrame, options: Options) -> DataFrame:
    """Normalised lines of all loadable files, written and split by outcome.

    Files are read line by line, which splits them freely.  The few that have
    line breaks inside cells are found first and read as whole records.
    """
    broken = written(X.quoted_files(catalog), "broken")
    if broken.isEmpty():
        return _write_lines(X.raw_charges(catalog), catalog, options)
    fine = _write_lines(X.raw_charges(catalog.join(broken, "file", "left_anti")), catalog, options)
    whole = X.quoted_charges(catalog.join(broken, "file", "left_semi"))
    return fine.unionByName(_write_lines(whole, catalog, options))


def ingest_files(
    files: DataFrame,
    options: Options = Options(),
    metadata: DataFrame | None = None,
    stored: DataFrame | None = None,
) -> Ingested:
    """One plan over all ``files`` (see ``sniff.manifest``).

    Text is parsed once: the normalised lines are written, split by outcome,
    and every result is read back from there.  A file that can't be read or
    loaded has a status that says why, and does not touch the others.
    ``stored`` are the hospitals of earlier runs, whose ids stay theirs.
    """
    catalog = written(K.build_catalog(files, metadata, stored), "catalog")
    start = time.perf_counter()
    lines = normalized_lines(catalog, options)
    seconds = time.perf_counter() - start
    return _results(catalog, lines, seconds, options)


def _results(catalog: DataFrame, lines: DataFrame, seconds: float, options: Options) -> Ingested:
    accepted = lines.where(F.col("accepted")).drop("accepted", "reasons")
    rejected = lines.where(~F.col("accepted")).drop("accepted")
    winners = best_operations(accepted, options.dedup)
    return Ingested(
        catalog=catalog,
        lines=lines,
        hospitals=to_hospitals(catalog, options.clock()),
        operations=to_operations(winners, options.clock()),
        rejected=rejected,
        report=R.file_report(catalog, lines, winners, seconds),
        options=options,
        seconds=seconds,
    )


def merged(runs: Iterable[Ingested]) -> Ingested:
    """Runs over different files, with the same options, as one run over all of them.

    Runs are made as they are asked for, so each may ingest files that take
    the place of those before.  Files that share an id with one of another
    run are not loaded, as in one run.
    """
    runs = list(runs)
    if len(runs) == 1:
        return runs[0]
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    single = union([r.catalog for r in runs])
    catalog = written(K.without_collisions(single), "catalog")
    lines = union([r.lines for r in runs])
    shared = catalog.where(F.col("status") == "id_collision").select("file")
    late = single.where(F.col("status") == "ok").join(shared, "file", "left_semi").select(F.col("file").alias("source_file"))
    if not late.isEmpty():
        lines = lines.join(late, "source_file", "left_anti").select(*lines.columns)
    return _results(catalog, lines, sum(r.seconds for r in runs), runs[0].options)


def ingest_directory(
    spark: SparkSession,
    folder: str,
    pattern: str = "*",
    options: Options = Options(),
    metadata: DataFrame | None = None,
    stored: DataFrame | None = None,
) -> Ingested:
    """Ingest the files of ``folder`` whose names match ``pattern``."""
    return ingest_files(S.manifest(spark, folder, pattern), options, metadata, stored)


def ingest_file(
    spark: SparkSession,
    path: str,
    options: Options = Options(),
    metadata: DataFrame | None = None,
    stored: DataFrame | None = None,
) -> Ingested:
    """Ingest a single file."""
    return ingest_files(S.manifest(spark, K.glob_safe(path)), options, metadata, stored)
