"""How the test files are written."""

import glob

from pyspark.sql import functions as F

import fixtures as X
import registry as Q


def test_no_task_writes_two_files_while_another_has_none(spark):
    files = [(n, p, n * 2 + p) for n in range(25) for p in range(2)]
    lines = spark.createDataFrame(files, "n_nationkey int, part int, file_no int").withColumns(
        {"order_1": F.lit(1), "order_2": F.lit(1), "order_3": F.lit(1)}
    )
    dealt = X._in_order(lines).select("file_no", F.spark_partition_id().alias("task"))
    most = dealt.groupBy("task").agg(F.count_distinct("file_no").alias("n")).agg(F.max("n")).first()[0]
    assert most == 1


def _tables(spark, folder):
    made = {
        "nation": spark.createDataFrame([(n, f"N{n}", n % 5) for n in range(3)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": spark.createDataFrame([(s, f"S{s}", s % 3) for s in range(6)], "s_suppkey long, s_name string, s_nationkey int"),
        "part": spark.createDataFrame([(p, f"part {p}", p) for p in range(7)], "p_partkey long, p_name string, p_size int"),
        # orders of all sizes, some without a key
        "lineitem": spark.range(400).selectExpr(
            "if(id % 50 = 0, null, id * id % 97) as l_orderkey", "id % 7 as l_partkey", "id % 6 as l_suppkey", "cast(1 + id % 5 as int) as l_linenumber",
            "cast(id % 9 as double) as l_quantity", "cast(100 + id % 40 as double) as l_extendedprice", "if(id % 3 = 0, 'R', 'N') as l_returnflag",
        ),
    }
    for name, df in made.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_files_that_land_some_at_a_time_give_the_operations_of_all(spark, tmp_path, monkeypatch):
    kind = "json"
    folder = _tables(spark, tmp_path / "tables")
    expected = sorted(map(str, Q.op_rows(Q.ingested(spark, folder, kind).operations).collect()))
    monkeypatch.setattr(X, "FILE_LINES", 3)
    monkeypatch.setattr(X, "LANDED_BYTES", 25 * 3 * X.JSON_LINE_BYTES * 2)
    there, patterns = [], []
    for pattern in X.landing_files(spark, folder, kind):
        patterns.append(pattern)
        there.append([len(glob.glob(p.removeprefix("file:") + "/*")) for p in patterns])
    parts = X.file_parts(spark, folder)
    assert parts == 6 and len(patterns) == 3
    # three nations, two parts each, and those before are gone
    assert all(t[-1] <= 6 and sum(t[:-1]) == 0 for t in there) and sum(t[-1] for t in there) > 12
    assert patterns == sorted(patterns)
    monkeypatch.setattr(Q, "_ingested", {})
    found = sorted(map(str, Q.op_rows(Q.ingested(spark, folder, kind).operations).collect()))
    assert found == expected and len(found) > 20


def test_files_named_in_order_have_their_lines_in_order(spark, tmp_path, monkeypatch):
    folder = _tables(spark, tmp_path / "tables")
    monkeypatch.setattr(X, "FILE_LINES", 1)
    lines = X.file_charges(spark, folder).where("l_orderkey is not null")
    parts = lines.groupBy("part").agg(F.min("l_orderkey").alias("a"), F.max("l_orderkey").alias("b")).orderBy("part").collect()
    assert len(parts) > 10 and len({len(p.part) for p in parts}) == 1
    assert all(p.b < q.a for p, q in zip(parts, parts[1:]))
    assert X.file_charges(spark, folder).count() == 400
