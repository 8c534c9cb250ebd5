"""Exact duplicates over an extendible-hash index kept in shared files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pricelake.runtime import written

#: Keys a bucket of the index may hold before it is split.
BUCKET_KEYS = 50_000
#: Bits of a key that the directory may use.
DEPTH = 24
#: Keys of 8 bytes that are sent to all executors rather than shuffling all texts.
BROADCAST_KEYS = 4_000_000


def directory(keys: DataFrame, capacity: int = BUCKET_KEYS) -> DataFrame:
    """Directory (cell, depth, bucket) of an extendible hash table over distinct ``key`` (long).

    The directory has a cell for each value of the leading bits of a key.  A
    bucket takes the keys that share its first ``depth`` bits; one that is
    overfull is split by one bit more, so cells of a full region point to
    buckets of their own while those of an empty one share a bucket.  The
    depth at which a bucket is small enough follows from the counts of keys by
    cell, summed up once for every depth.  A bucket is numbered by its bits
    behind a leading 1.
    """
    depth = min(DEPTH, (keys.count() // capacity).bit_length() + 3)
    cells = written(keys.groupBy(cell(depth).alias("cell")).agg(F.count("*").alias("n")), "cells")
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn(
        "bucket", F.expr(f"shiftright(cell, {depth} - depth) + shiftleft(1L, depth)")
    )
    small = levels.groupBy("bucket").agg(F.sum("n").alias("keys"))
    fits = levels.join(small, "bucket").where((F.col("keys") <= capacity) | (F.col("depth") == depth))
    found = fits.groupBy("cell").agg(F.min(F.struct("depth", "bucket")).alias("at"))
    return found.select("cell", "at.depth", "at.bucket", F.lit(depth).alias("global_depth"))


def cell(depth: int):
    return F.shiftrightunsigned("key", 64 - depth)


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = BUCKET_KEYS) -> DataFrame:
    """A row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; of equal ones the largest id stays.

    1. Every text is read once into its 64-bit key and SHA-256, written to the shared folder.
    2. The directory of an extendible hash table over the keys deals every row
       to a bucket; owner tasks take the key ranges of their buckets.
    3. Owners write the buckets' files, in order: a link for every text of a
       key, with the largest id and the number of its rows.  Where rows share
       a key, bytes are compared (in each task first, so a group of copies
       sends one row per task), and different texts make a chain of links.
    4. Every document finds its bucket through the directory, its key in the
       bucket and its link in the chain, which tells what becomes of it.

    Cases: a NULL text is the empty one; repeated rows and rows that share an
    id and a text share its fate; rows with a NULL id never win against an id,
    and all stay where no row of the group has one; an empty table gives no
    rows; extra columns are ignored.
    """
    plain = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(
        "key", F.xxhash64("text")
    )
    rows = written(plain.select("id", "key", F.sha2("text", 256).alias("text_sha256")), "keyed-rows")
    keys = written(rows.groupBy("key").agg(F.count("*").alias("rows")), "keys")
    table = written(directory(keys, capacity), "directory")
    links = written(bucket_files(plain, rows, keys, table), "index")
    found = in_buckets(rows, table).join(links, ["bucket", "key", "text_sha256"])
    return found.select(
        F.col("id").alias(id),
        "keep_id",
        "group_size",
        F.col("keep_id").eqNullSafe(F.col("id")).alias("kept"),
        "text_sha256",
    )


def in_buckets(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` (with ``key``) with the ``bucket`` that the directory's cell of the key points to."""
    depth = table.select("global_depth").first()
    # a cell for some ten thousand keys at most: the directory is small beside the rows
    return rows.withColumn("cell", cell(depth[0] if depth else 1)).join(table.select("cell", "bucket"), "cell").drop("cell")


def bucket_files(plain: DataFrame, rows: DataFrame, keys: DataFrame, table: DataFrame) -> DataFrame:
    """Links (bucket, key, text_sha256, keep_id, group_size) of all texts, in the order of buckets and keys."""
    shared = keys.where("rows > 1").select("key")
    if shared.count() <= BROADCAST_KEYS:
        shared = F.broadcast(shared)
    single = rows.join(shared, "key", "left_anti").select("key", "text_sha256", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    chained = (
        plain.join(shared, "key")
        .groupBy("key", "text")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("key", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    links = in_buckets(single.unionByName(chained), table)
    return links.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "text_sha256")
