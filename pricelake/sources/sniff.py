"""What the head of each file tells: format, header row, facility metadata.

Only file heads pass through Python, one row per file; all decisions are
Column expressions over that row.
"""

from __future__ import annotations

import csv
import re
import sys
import time
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricelake.schemas import JSON_HEADER, JSON_ITEMS_KEY

# Executors need not have this package installed: what they run is sent along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAD_BYTES = 64 * 1024
# A header that is longer is an error of its file; it comes from a quote that is never closed.
HEADER_BYTES = 32 * 1024 * 1024
# Heads go back to Spark in frames of about this size.
FRAME_BYTES = 4 * 1024 * 1024
HEADER_ROWS = 5

# Words that mark a header cell.
HEADER_WORDS = (
    "description",
    "code",
    "charge",
    "price",
    "procedure",
    "service",
    "billing",
    "standard_charge",
    "setting",
    "gross",
    "discounted",
)

# Keys of the facility header.
FACILITY_KEYS = (
    "hospital_name",
    "last_updated_on",
    "version",
    "hospital_location",
    "hospital_address",
)

_FILE_SCHEMA = (
    "file string, path string, size_bytes bigint, size_mb double, modified_at timestamp"
)
_HEAD_SCHEMA = (
    "head string, tail string, line_1 string, line_2 string, rows array<array<string>>,"
    " row_texts array<string>, error string, head_seconds double"
)
_HEAD_COLUMNS = ["head", "tail", "line_1", "line_2", "rows", "row_texts"]
# Names that Hadoop has for file systems which the reader of heads knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files directly in ``folder`` whose names match ``pattern``; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return file_info(found)


def file_info(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("_metadata.file_path").alias("file"),
        F.regexp_replace("path", "^file:/+", "/").alias("path"),
        F.col("length").alias("size_bytes"),
        (F.col("length") / F.lit(1024.0 * 1024.0)).alias("size_mb"),
        F.col("modificationTime").alias("modified_at"),
    )


def arrow_uri(path: str) -> str:
    """``path`` with the scheme under which the reader of heads knows its file system."""
    scheme, _, rest = path.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}://{rest}" if rest else path


def _open(path: str):
    from pyarrow import fs

    if "://" in path:
        system, inner = fs.FileSystem.from_uri(arrow_uri(path))
    else:
        system, inner = fs.LocalFileSystem(), path
    return system.open_input_file(inner)


def _text(data: bytes) -> str:
    return data.decode("utf-8-sig", errors="ignore").replace("\r\n", "\n").replace("\r", "\n")


def _read_head(path: str) -> tuple:
    with _open(path) as stream:
        data = stream.read(HEAD_BYTES)
        head = _text(data)
        if head.lstrip()[:1] in ("{", "[") and not path.lower().endswith(".csv"):
            stream.seek(0)
            first = _json_line(stream)
            second = _json_line(stream) if first else ""
            size = stream.size()
            stream.seek(max(0, size - HEAD_BYTES))
            return head, _text(stream.read(HEAD_BYTES)), first, second, None, None
        while True:
            # Enough once a row follows the ones looked at: quotes may hide line ends.
            rows, _ = _first_rows(_text(data[: max(data.rfind(b"\n"), data.rfind(b"\r")) + 1]))
            if len(rows) > HEADER_ROWS:
                break
            if len(data) > HEADER_BYTES:
                raise ValueError(f"no end of the header in {HEADER_BYTES} bytes")
            more = stream.read(len(data) or HEAD_BYTES)
            if not more:
                break
            data += more
        rows, texts = _first_rows(_text(data))
        return head, None, None, None, rows[:HEADER_ROWS], texts[:HEADER_ROWS]


def _json_line(stream) -> str:
    """The next line; of one longer than a head only '{}' if it is a JSON text of its own, else '{'.

    A long line is followed in pieces: whether it starts and ends on the
    outermost level needs no memory of what is between.
    """
    kept, depth, inside, size = [], 0, False, 0
    while True:
        start = stream.tell()
        data = stream.read(HEAD_BYTES)
        cut = data.find(b"\n")
        part = data if cut < 0 else data[:cut]
        if size < HEAD_BYTES:
            kept.append(part)
        size += len(part)
        for sign in re.findall(rb'\\.|["{}\[\]]', part, re.S):
            if sign == b'"':
                inside = not inside
            elif not inside and sign in b"{[":
                depth += 1
            elif not inside and sign in b"}]":
                depth -= 1
        if cut >= 0:
            stream.seek(start + cut + 1)
        if cut >= 0 or not data:
            break
    if size <= HEAD_BYTES:
        return _text(b"".join(kept)).strip()
    return "{}" if depth == 0 and not inside else "{"


def _first_rows(text: str) -> tuple[list[list[str]], list[str]]:
    """First rows as cells and as they are written."""
    csv.field_size_limit(HEADER_BYTES * 4)
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    reader = csv.reader(line + "\n" for line in lines)
    rows, texts, done = [], [], 0
    for row in reader:
        rows.append(row)
        texts.append("\n".join(lines[done : reader.line_num]))
        done = reader.line_num
        if len(rows) > HEADER_ROWS:
            break
    return rows, texts


def _described(path: str) -> tuple:
    """Head of a file, or what went wrong, and the seconds that took."""
    start = time.perf_counter()
    try:
        found, error = _read_head(path), None
    except Exception as problem:  # one file must not end the run of all others
        found, error = (None,) * len(_HEAD_COLUMNS), f"{type(problem).__name__}: {problem}"[:500]
    return *found, error, time.perf_counter() - start


def _read_heads(batches: Iterator) -> Iterator:
    import pandas as pd

    columns = [*_HEAD_COLUMNS, "error", "head_seconds"]
    for batch in batches:
        heads, size, start = [], 0, 0
        for i, path in enumerate(batch["path"]):
            heads.append(_described(path))
            size += sum(len(x) for x in heads[-1] if isinstance(x, str)) * 2
            if size > FRAME_BYTES or i == len(batch) - 1:
                part = batch.iloc[start : i + 1]
                yield part.join(pd.DataFrame(heads, columns=columns, index=part.index))
                heads, size, start = [], 0, i + 1


def read_heads(files: DataFrame) -> DataFrame:
    """Files with their head, first lines and first CSV rows, read on the executors."""
    tasks = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(tasks, "file").mapInPandas(
        _read_heads, f"{_FILE_SCHEMA}, {_HEAD_SCHEMA}"
    )


def json_kind(line_1: Column, line_2: Column) -> Column:
    """'ndjson' when the first two lines are JSON texts of their own, else 'json'."""
    is_json = lambda line: (line != "") & F.try_parse_json(line).isNotNull()
    return F.when(is_json(line_1) & is_json(line_2), F.lit("ndjson")).otherwise(F.lit("json"))


def detect_format(extension: Column, head: Column, line_1: Column, line_2: Column) -> Column:
    """Format from the extension, else from the first 1024 characters."""
    sample = F.left(head, F.lit(1024))
    counts = F.transform(
        F.slice(F.split(sample, "\n"), 1, 3),
        lambda line: F.length(line) - F.length(F.translate(line, ",", "")),
    )
    looks_csv = (
        F.contains(sample, F.lit("\n"))
        & (F.size(F.array_distinct(counts)) == 1)
        & (F.get(counts, F.lit(0)) > 3)
    )
    kind = json_kind(line_1, line_2)
    return (
        F.when(extension == ".csv", F.lit("csv"))
        .when(extension.isin(".ndjson", ".jsonl"), F.lit("ndjson"))
        .when(extension == ".json", kind)
        .when(looks_csv, F.lit("csv"))
        .when(F.ltrim(F.translate(sample, "\n\r\t", "   ")).rlike(r"^[{\[]"), kind)
        .otherwise(F.lit("unknown"))
    )


def header_row(rows: Column) -> Column:
    """Index of the header among the first rows of a CSV file; 0 when none stands out."""
    marked = "|".join(HEADER_WORDS)

    def is_header(row: Column) -> Column:
        cells = F.transform(row, lambda c: F.lower(c))
        n_marked = F.size(F.filter(cells, lambda c: c.rlike(marked)))
        titled = (F.trim(F.get(cells, F.lit(0))) == "description") & F.exists(
            cells, lambda c: F.contains(c, F.lit("setting"))
        )
        return (F.size(row) > 0) & (titled | (n_marked / F.size(row) > F.lit(0.3)))

    hits = F.filter(
        F.transform(rows, lambda row, i: F.when(is_header(row), i)), lambda i: i.isNotNull()
    )
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(0))


def csv_header(rows: Column, header: Column) -> Column:
    """Facility header told by the two rows above the column names."""
    keys, values = F.get(rows, F.lit(0)), F.get(rows, F.lit(1))
    usable = (header >= 2) & F.exists(
        keys, lambda k: F.contains(F.lower(k), F.lit("hospital"))
    )
    named = F.transform(
        F.arrays_zip(keys.alias("k"), values.alias("v")),
        lambda c: F.struct(F.lower(F.trim(c["k"])).alias("k"), F.trim(c["v"]).alias("v")),
    )
    filled = F.filter(
        named, lambda c: (c["k"] != "") & (c["v"] != "") & c["k"].isin(*FACILITY_KEYS)
    )
    # A key given twice counts with its last value.
    return F.when(
        usable, F.aggregate(filled, _no_facility(), lambda told, c: _with_key(told, c))
    )


def _no_facility() -> Column:
    return F.struct(*[F.lit(None).cast("string").alias(k) for k in FACILITY_KEYS])


def _with_key(told: Column, cell: Column) -> Column:
    return F.struct(
        *[F.when(cell["k"] == k, cell["v"]).otherwise(told[k]).alias(k) for k in FACILITY_KEYS]
    )


def json_header(head: Column) -> Column:
    """Facility header of a wrapped document, from the part before its items."""
    before = F.split_part(head, F.lit(f'"{JSON_ITEMS_KEY}"'), F.lit(1))
    closed = F.concat(F.regexp_replace(before, r",\s*$", ""), F.lit("}"))
    whole = F.contains(head, F.lit(f'"{JSON_ITEMS_KEY}"'))
    return F.from_json(F.when(whole, closed).otherwise(head), JSON_HEADER)


def json_facility(header: Column) -> Column:
    """JSON header in the shape of a CSV one; it has no location of its own."""
    return F.struct(
        header["hospital_name"].alias("hospital_name"),
        header["last_updated_on"].alias("last_updated_on"),
        header["version"].alias("version"),
        F.lit(None).cast("string").alias("hospital_location"),
        F.get(header["hospital_address"], F.lit(0)).alias("hospital_address"),
    )


def late_json_header(tail: Column) -> Column:
    """Facility header of a wrapped document that tells it after its items: what follows the last object inside it."""
    after = F.regexp_extract(tail, r"(?s)\}\s*\]\s*,([^{}]*)\}\s*$", 1)
    return F.from_json(F.concat(F.lit("{"), after, F.lit("}")), JSON_HEADER)
