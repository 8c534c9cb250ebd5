"""Raw charge lines of CSV, JSON and NDJSON files, in one common shape."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricelake.functions.names import without
from pricelake.operators import match as M
from pricelake.operators.normalize import FAULT
from pricelake.runtime import written
from pricelake.schemas import JSON_ITEM, RAW_CHARGES
from pricelake.sources.catalog import glob_safe
from pricelake.sources.documents import document_items, document_pieces
from pricelake.sources.records import UNCLOSED_QUOTE, opens_quote, whole_records

RAW_FIELDS = (
    "description",
    "setting",
    "cash_price",
    "gross_charge",
    "negotiated_min",
    "negotiated_max",
)

MIN_WIDTH = 16
#: Distinct layouts, and files, whose descriptions are sent to all tasks at once.
SENT_LAYOUTS, SENT_FILES = 20_000, 200_000
MAYBE_TOP = "maybe_top"
INCOMPLETE_ITEM = "incomplete_item"


def width_class(width: int) -> int:
    """Power of two that holds ``width`` cells; scans are shared per class."""
    return max(MIN_WIDTH, 1 << (max(width, 1) - 1).bit_length())


def raw_charges(catalog: DataFrame) -> DataFrame:
    """Raw charge lines of all loadable files of ``catalog``.

    CSV files are read by width class and JSON files by shape, so the plan has
    a handful of scans however many layouts the files have.  Every CSV line is
    taken for a record; ``quoted_files`` have to be read by ``quoted_charges``
    instead.  Lines that may be the header or stand above it are marked
    ``maybe_top``.  JSON documents are split.
    """
    loadable = catalog.where(F.col("status") == "ok")
    parts = []
    for (kind, variant), paths in _paths(loadable).items():
        if kind == "csv":
            lines = _csv_lines(loadable, paths).withColumn("unclosed", F.lit(False))
            parts.append(_csv_charges(lines, loadable, variant))
        elif kind == "ndjson":
            parts.append(_ndjson_items(loadable, paths))
        else:
            parts.append(_document_items(loadable, paths, variant))
    return _union(catalog, parts)


def quoted_files(catalog: DataFrame) -> DataFrame:
    """(file) of loadable CSV files with line breaks inside cells.

    They have a line that ends inside one.  A line that reads like the header
    or one above it is one only among the first such lines of its file, as
    many as there are; the others count.
    """
    csv = catalog.where((F.col("status") == "ok") & (F.col("format") == "csv"))
    opens = F.max(F.when(~F.col(MAYBE_TOP), True)).alias("beside")
    found = written(_marked_lines(csv).where(opens_quote(F.col("value"))).groupBy("file").agg(opens), "open")
    doubtful = found.where(F.col("beside").isNull()).select("file")
    if doubtful.isEmpty():
        return found.select("file")
    order = Window.partitionBy("file").orderBy("source_block", "source_row")
    n_top = F.size(F.filter("top_texts", lambda t: F.trim(t) != ""))
    like_top = _marked_lines(csv.join(doubtful, "file", "left_semi")).where(MAYBE_TOP)
    late = like_top.withColumn("nth", F.row_number().over(order)).where((F.col("nth") > n_top) & opens_quote(F.col("value")))
    return found.where("beside").select("file").unionByName(late.select("file").distinct())


def _marked_lines(csv: DataFrame) -> DataFrame:
    """Lines of CSV files, with the texts down to the header and whether a line is like one of them."""
    paths = [p for found in _paths(csv).values() for p in found]
    if not paths:
        empty = csv.sparkSession.createDataFrame([], "file string, source_block long, source_row long, value string")
        return empty.withColumns({"top_texts": F.array().cast("array<string>"), MAYBE_TOP: F.lit(False)})
    files, layouts = _layouts(csv, "top_texts")
    lines = _csv_lines(csv, paths).join(files.select("file", "layout"), "file").join(layouts, "layout")
    return lines.drop("layout").withColumn(MAYBE_TOP, F.array_contains("top_texts", F.col("value")))


def quoted_charges(catalog: DataFrame) -> DataFrame:
    """Raw charge lines of CSV files that have line breaks inside cells."""
    parts = [
        _csv_charges(whole_records(_csv_lines(catalog, paths), catalog), catalog, width)
        for (_, width), paths in _paths(catalog).items()
    ]
    return _union(catalog, parts)


def _paths(catalog: DataFrame) -> dict[tuple, list[str]]:
    """Paths by format and how they are read: CSV by width class, JSON by its root."""
    groups = defaultdict(list)
    for r in catalog.select("path", "format", "width", "is_object").toLocalIterator():
        variant = width_class(r.width or 1) if r.format == "csv" else bool(r.is_object)
        groups[r.format, variant].append(glob_safe(r.path))
    return dict(sorted(groups.items()))


def _union(catalog: DataFrame, parts: list[DataFrame]) -> DataFrame:
    if not parts:
        empty = catalog.sparkSession.createDataFrame([], RAW_CHARGES)
        return empty.withColumns({MAYBE_TOP: F.lit(False), FAULT: F.lit(None).cast("string")})
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _csv_lines(catalog: DataFrame, paths: list[str]) -> DataFrame:
    """Lines that are not blank; files are split freely."""
    return (
        catalog.sparkSession.read.text(paths)
        .where(F.trim("value") != "")
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("source_block"),
            F.monotonically_increasing_id().alias("source_row"),
            without(F.col("value"), "\ufeff\ufffd").alias("value"),
        )
    )


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for the small side of a join: sent to all tasks if it is known to have few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _layouts(catalog: DataFrame, *layout: str) -> tuple[DataFrame, DataFrame]:
    """(file, facility_id, layout) of CSV files, and what there is to know of each distinct layout."""
    keyed = catalog.where(F.col("format") == "csv").withColumn("layout", F.xxhash64(F.to_json(F.struct(*layout))))
    files = _sent(keyed.select("file", "facility_id", "layout"), SENT_FILES)
    return files, _sent(keyed.select("layout", *layout).dropDuplicates(["layout"]), SENT_LAYOUTS)


def _csv_charges(lines: DataFrame, catalog: DataFrame, width: int) -> DataFrame:
    """CSV records to raw charge lines, cells picked by the mapping of their file.

    Lines meet two small tables, one row per file and one per distinct layout;
    the text of the lines is not shuffled.
    """
    names = [f"c{i}" for i in range(width)]
    files, layouts = _layouts(catalog, "width", "top_texts", "code_columns", *[f"{f}_pos" for f in M.FIELDS])
    # Rows are filled up to the width of their class: a row of the expected
    # length is then never malformed to the parser.
    filled = F.concat("value", F.repeat(F.lit(","), F.lit(width) - F.col("width")))
    parsed = F.from_csv(
        filled,
        ", ".join(f"{n} string" for n in names),
        {"escape": '"', "maxColumns": str(max(20480, 4 * width)), "maxCharsPerColumn": "-1"},
    )
    rows = (
        lines.join(files, "file")
        .join(layouts, "layout")
        .withColumn("row", parsed)
        .withColumn("cells", F.array(*[F.col(f"row.{n}") for n in names]))
    )

    def cell(position: Column) -> Column:
        return F.get("cells", position)

    pairs = F.transform(
        F.col("code_columns"),
        lambda c: F.struct(
            F.coalesce(c["implied_type"], cell(c["type_pos"])).alias("type"),
            cell(c["code_pos"]).alias("code"),
        ),
    )
    return rows.select(
        "facility_id",
        F.col("file").alias("source_file"),
        "source_block",
        "source_row",
        *[cell(F.col(f"{f}_pos")).alias(f) for f in RAW_FIELDS],
        F.coalesce(pairs, F.array().cast(RAW_CHARGES["code_pairs"].dataType)).alias("code_pairs"),
        F.array_contains("top_texts", F.col("value")).alias(MAYBE_TOP),
        F.when(F.col("unclosed"), F.lit(UNCLOSED_QUOTE)).alias(FAULT),
    )


def item_fields(item: Column) -> dict[str, Column]:
    """Raw charge fields of a JSON item; only its first charge counts."""
    charge = F.get(item["standard_charges"], F.lit(0))
    return {
        "description": item["description"],
        "setting": charge["setting"],
        "cash_price": charge["discounted_cash"],
        "gross_charge": charge["gross_charge"],
        "negotiated_min": charge["minimum"],
        "negotiated_max": charge["maximum"],
        "code_pairs": F.transform(
            F.coalesce(
                item["code_information"],
                F.array().cast(JSON_ITEM["code_information"].dataType),
            ),
            lambda c: F.struct(c["type"].alias("type"), c["code"].alias("code")),
        ),
    }


def _charges(items: DataFrame, catalog: DataFrame, fault: Column | None = None) -> DataFrame:
    """(file, source_block, source_row, item) to raw charge lines."""
    files = _sent(catalog.where(F.col("format") != "csv").select("file", "facility_id"), SENT_FILES)
    return (
        items.join(files, "file")
        .withColumnRenamed("file", "source_file")
        .select(
            "facility_id",
            "source_file",
            F.col("source_block").cast("long"),
            F.col("source_row").cast("long"),
            *[c.alias(n) for n, c in item_fields(F.col("item")).items()],
            F.lit(False).alias(MAYBE_TOP),
            (F.lit(None).cast("string") if fault is None else fault).alias(FAULT),
        )
    )


def _document_items(catalog: DataFrame, paths: list[str], in_object: bool) -> DataFrame:
    """Items of documents, which are split at closing braces whatever their size.

    A document that breaks off gives its complete items and a faulty line for
    the one it breaks off in.
    """
    pieces = document_pieces(catalog.sparkSession, paths)
    items = document_items(pieces, in_object, catalog)
    fault = F.when(F.col("incomplete"), F.lit(INCOMPLETE_ITEM))
    return _charges(items.withColumn("item", F.from_json("item", JSON_ITEM)), catalog, fault)


def _ndjson_items(catalog: DataFrame, paths: list[str]) -> DataFrame:
    """Items of files with one item per line; files are split freely."""
    lines = catalog.sparkSession.read.schema(JSON_ITEM).json(paths)
    return _charges(
        lines.select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("source_block"),
            F.monotonically_increasing_id().alias("source_row"),
            F.struct(*JSON_ITEM.names).alias("item"),
        ),
        catalog,
    )
