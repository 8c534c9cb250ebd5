"""Continuous ingestion: files that appear in a folder are merged into the tables.

The stream carries file names only; what a file holds is read by the batch
plan, which copes with a different layout per file.  Every micro-batch is
stored as a batch run is: what a file gave before is replaced, and the groups
of duplicates that it touches are merged with the stored ones and written; the
rest of a facility stays as it lies.  So repeating a batch after a failure
changes nothing, and the result does not depend on how files arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pricelake.plans import ingest as I
from pricelake.runtime import scratch, written
from pricelake.sinks import tables as W
from pricelake.sources import sniff as S

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, folder: str, pattern: str = "*", max_files: int | None = None):
    """Stream of the files appearing in ``folder``; contents are not read."""
    stream = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", pattern)
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)
    return S.file_info(stream.load(folder))


def merge_batch(
    files: DataFrame,
    target: str,
    options: I.Options = I.Options(),
    metadata: DataFrame | None = None,
) -> None:
    """Ingest ``files`` and merge what they change into the tables."""
    spark = files.sparkSession
    with scratch(spark):
        result = I.ingest_files(written(files, "batch"), options, metadata, W.read_hospitals(spark, target))
        W.store(result, target, options.clock())


def watch(
    spark: SparkSession,
    folder: str,
    target: str,
    checkpoint: str,
    pattern: str = "*",
    options: I.Options = I.Options(),
    metadata: DataFrame | None = None,
    max_files: int | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Start ingesting ``folder``; stops at the files present unless ``interval`` is given."""
    stream = new_files(spark, folder, pattern, max_files)
    writer = stream.writeStream.foreachBatch(
        lambda files, batch_id: merge_batch(files, target, options, metadata)
    ).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()
