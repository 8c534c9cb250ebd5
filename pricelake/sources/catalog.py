"""The file catalog: one row per file with everything later plans need to know of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pricelake.functions import names as N
from pricelake.operators import match as M, quality as Q
from pricelake.runtime import written
from pricelake.sources import sniff as S
from pricelake.sources.documents import document_headers, document_pieces

METADATA = ("facility_name", "city", "state", "address", "file_version", "last_updated")
SUPPORTED = ("csv", "json", "ndjson")


def build_catalog(
    files: DataFrame, metadata: DataFrame | None = None, stored: DataFrame | None = None
) -> DataFrame:
    """Catalog of ``files`` (as listed by ``sniff.manifest``).

    ``metadata`` optionally gives facility fields per ``path``; where a row
    exists it replaces what the file tells.  ``status`` says why a file cannot
    be loaded: 'unreadable' (see ``error``), 'unsupported_format',
    'missing_metadata', 'invalid_metadata', 'id_collision' or 'ok'.

    ``stored`` are hospitals (facility_id, facility_name) of earlier runs.  A
    facility id stands for one hospital: files are not loaded if others of the
    run, or the stored row, have the same id under another name.
    """
    heads = written(_describe(files), "heads")
    known = written(_with_facility(_read_late_headers(heads), metadata), "known")
    known = without_collisions(known, stored)
    mapping = M.column_mapping(known.where(F.col("format") == "csv").select("file", "columns"))
    return known.join(
        mapping.withColumn("missing_fields", M.missing_fields()), "file", "left"
    )


def _describe(files: DataFrame) -> DataFrame:
    """Format, facility header and layout of each file, from its head."""
    extension = N.file_extension(F.col("path"))
    kind = S.detect_format(extension, F.col("head"), F.col("line_1"), F.col("line_2"))
    is_csv, is_json = F.col("format") == "csv", F.col("format") == "json"
    heads = (
        S.read_heads(files)
        .withColumn("format", kind)
        .withColumns(
            {
                "header_row": F.when(is_csv, S.header_row(F.col("rows"))),
                "json_header": F.when(is_json, S.json_header(F.col("head"))),
            }
        )
        .withColumn("top", F.slice("rows", F.lit(1), F.col("header_row") + 1))
    )
    return heads.select(
        *files.columns,
        "format",
        F.when(is_csv, S.csv_header(F.col("rows"), F.col("header_row")))
        .when(is_json, S.json_facility(F.col("json_header")))
        .alias("told"),
        F.transform(F.element_at("top", -1), lambda c: F.trim(c)).alias("columns"),
        F.array_max(F.transform("top", lambda r: F.size(r))).alias("width"),
        F.slice("row_texts", F.lit(1), F.col("header_row") + 1).alias("top_texts"),
        F.when(is_json, F.col("head").rlike(r"^\s*\{")).alias("is_object"),
        F.when(is_json & F.col("head").rlike(r"^\s*\{"), S.json_facility(S.late_json_header(F.col("tail")))).alias("late"),
        "error",
        "head_seconds",
    )


def _read_late_headers(heads: DataFrame) -> DataFrame:
    """Header fields of JSON documents whose head did not tell name and address.

    They may follow the items: the end of the document tells them then.  Where
    it does not either, they are looked for between the items, in the blocks
    into which the document is split.
    """
    whole = F.col("late.hospital_name").isNotNull() & F.col("late.hospital_address").isNotNull()
    short = F.col("told.hospital_name").isNull() | F.col("told.hospital_address").isNull()
    heads = heads.withColumn("told", F.when(short & whole, F.col("late")).otherwise(F.col("told"))).drop("late")
    lacking = heads.where(
        F.col("is_object")
        & (F.col("told.hospital_name").isNull() | F.col("told.hospital_address").isNull())
    )
    paths = [glob_safe(r.path) for r in lacking.select("path").toLocalIterator()]
    if not paths:
        return heads
    headers = document_headers(document_pieces(heads.sparkSession, paths), lacking)
    late = headers.select("file", S.json_facility(F.col("header")).alias("late"))
    return (
        heads.join(late, "file", "left")
        .withColumn("told", F.coalesce("late", "told"))
        .drop("late")
    )


def _with_facility(heads: DataFrame, metadata: DataFrame | None) -> DataFrame:
    """Facility fields, their gaps, and whether the file can be loaded."""
    is_json = F.col("format") == "json"
    place = F.when(is_json, N.city_state_of_address(F.col("told.hospital_address"))).otherwise(
        N.city_state_of_location(F.col("told.hospital_location"), F.col("told.hospital_address"))
    )
    told_any = F.coalesce(*[F.col(f"told.{k}") for k in S.FACILITY_KEYS]).isNotNull()
    from_path = F.when(
        is_json & ~told_any, N.name_from_json_file(F.col("path"))
    ).otherwise(N.name_from_file(F.col("path")))
    found = heads.withColumn("place", place).withColumn(
        "own",
        F.struct(
            F.lit(None).cast("string").alias("facility_id"),
            F.coalesce("told.hospital_name", from_path).alias("facility_name"),
            "place.city",
            "place.state",
            F.col("told.hospital_address").alias("address"),
            F.col("told.version").alias("file_version"),
            F.col("told.last_updated_on").alias("last_updated"),
        ),
    )
    if metadata is not None:
        given = F.struct(
            *[
                (F.col(c) if c in metadata.columns else F.lit(None).cast("string")).alias(c)
                for c in ("facility_id", *METADATA)
            ]
        )
        found = found.join(metadata.select("path", given.alias("given")), "path", "left")
        found = found.withColumn("own", F.coalesce("given", "own")).drop("given")
    return (
        found.select(*[c for c in heads.columns if c != "told"], "own.*")
        .withColumn("facility_id", F.coalesce("facility_id", N.facility_id(F.col("facility_name"))))
        .withColumn("missing_metadata", Q.missing_file_metadata())
        .withColumn(
            "status",
            F.when(F.col("error").isNotNull(), F.lit("unreadable"))
            .when(~F.col("format").isin(*SUPPORTED), F.lit("unsupported_format"))
            .when(F.size("missing_metadata") > 0, F.lit("missing_metadata"))
            .when(
                ~F.col("facility_id").rlike("^[a-z0-9-]+$") | ~F.col("state").rlike("^[A-Z]{2}$"),
                F.lit("invalid_metadata"),
            )
            .otherwise(F.lit("ok")),
        )
    )


def without_collisions(known: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``known`` with status 'id_collision' where an id stands for hospitals of different names."""
    named = known.where(F.col("status").isin("ok", "id_collision")).select("facility_id", "facility_name")
    if stored is not None:
        named = named.unionByName(stored.select("facility_id", "facility_name"))
    same = F.lower(F.regexp_replace(F.trim("facility_name"), r"\s+", " "))
    colliding = (
        named.groupBy("facility_id")
        .agg(F.min(same).alias("first"), F.max(same).alias("last"))
        .where(F.col("first") != F.col("last"))
        .select("facility_id", F.lit(True).alias("colliding"))
    )
    collides = (F.col("status") == "ok") & F.coalesce("colliding", F.lit(False))
    return (
        known.join(colliding, "facility_id", "left")
        .withColumn("status", F.when(collides, F.lit("id_collision")).otherwise(F.col("status")))
        .select(*known.columns)
    )


def glob_safe(path: str) -> str:
    """Path whose glob characters stand for themselves."""
    return "".join("\\" + c if c in "[]{}*?\\" else c for c in path)
