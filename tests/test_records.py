"""Stitched CSV records against a whole-file CSV reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from pricelake.sources.records import whole_records


def random_rows(seed, n):
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice('ab,"\n ') for _ in range(rng.randint(0, 9)))
    return [["r%d" % i, cell(), cell()] for i in range(n)]


def read(spark, path):
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("source_block"),
        F.monotonically_increasing_id().alias("source_row"),
        "value",
    )
    return lines


@pytest.mark.parametrize("block", ["64", "1000", "134217728"])
def test_records_cross_lines_and_blocks(spark, tmp_path, block):
    rows = random_rows(int(block), 300)
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(rows)
    (tmp_path / "x.csv").write_text(text.getvalue())
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = read(spark, str(tmp_path))
        if block == "64":
            assert lines.select("source_block").distinct().count() > 50
        records = whole_records(lines).orderBy("source_block", "source_row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = [next(csv.reader(io.StringIO(r.value, newline=""))) for r in records]
    assert got == rows


def test_a_quote_never_closed_does_not_swallow_the_file(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,1\nb,"2\n' + "c,3\n" * 50)
    records = whole_records(read(spark, str(tmp_path))).orderBy("source_block", "source_row").collect()
    assert [r.value for r in records] == ["a,1", 'b,"2'] + ["c,3"] * 50
    assert [r.unclosed for r in records] == [False, True] + [False] * 50


@pytest.mark.parametrize("seed", range(4))
def test_stray_quotes_are_read_as_a_csv_reader_does(spark, tmp_path, seed):
    """A quote opens a cell only at its start, and closes it only before a comma or line end."""
    rng = random.Random(seed)
    lines = []
    for i in range(200):
        cells = [
            rng.choice(['CATH 5" LONG', '6"', 'a""b', '"q"', '"x, y"', '"two\nlines"', '"d""q"', 'plain', '', ' "s"', '"a"b'])
            for _ in range(4)
        ]
        lines.append(",".join([f"r{i}", *cells]).replace("\\n", "\n"))
    text = "\n".join(lines) + "\n"
    (tmp_path / "x.csv").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100" if seed % 2 else "1000000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = whole_records(read(spark, str(tmp_path))).orderBy("source_block", "source_row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = list(csv.reader(io.StringIO(text, newline="")))
    assert [next(csv.reader(io.StringIO(r.value, newline=""))) for r in records] == want
    assert not any(r.unclosed for r in records)


def test_only_records_at_the_edges_of_blocks_are_shuffled(spark, tmp_path):
    """A task holds no block: the text of records inside a block is neither sorted, windowed nor shuffled."""
    (tmp_path / "x.csv").write_text("".join(f'r{i},"two\nlines {i}",x\n' for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = whole_records(read(spark, str(tmp_path)))
        plan = records._jdf.queryExecution().optimizedPlan().toString()
        rows = records.orderBy("source_block", "source_row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert "Window" not in plan
    assert len({r.source_block for r in rows}) > 3
    assert [r.value for r in rows] == [f'r{i},"two\nlines {i}",x' for i in range(2000)]
