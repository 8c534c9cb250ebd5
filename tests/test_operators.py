"""Properties of de-duplication, rules, serving, similarity and sinks on small tables."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

import registry
from pricelake.operators import dedup as D, quality as Q, serving as V, similarity as Y
from pricelake.plans import ingest as I
from pricelake.runtime import new_folder
from pricelake.schemas import OPERATIONS
from pricelake.sinks import cache as KC, tables as W
from pricelake.sources import sniff as S
from pricelake.streaming import directory as L

LINES = (
    "facility_id string, source_file string, source_block long, source_row long,"
    " description string, codes_key string, cash_price double, gross_charge double,"
    " negotiated_min double, negotiated_max double"
)
DAY_1, DAY_2 = datetime(2025, 1, 1), datetime(2025, 1, 2)


def random_lines(n, seed=1):
    """A third of all lines in one group."""
    rng = random.Random(seed)
    price = lambda p: rng.choice([None, float(rng.randint(1, 5))]) if rng.random() < p else 3.0
    rows = []
    for i in range(n):
        hot = rng.random() < 0.33
        key = ("f0", "hot", '{"RC":["1"]}') if hot else (
            f"f{rng.randint(0, 3)}", f"d{rng.randint(0, 9)}", '{"RC":["%d"]}' % rng.randint(0, 3)
        )
        rows.append((key[0], "x", 0, i, key[1], key[2], price(0.9), price(0.9), price(0.8), price(0.8)))
    return rows


def brute_force(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[0], r[4], r[5]), []).append(r)
    best = set()
    for key, members in groups.items():
        rank = lambda r: (
            1000 + r[6] if r[6] is not None else 500 + 0.1 * r[7] if r[7] is not None else 0.0
        )
        winner = max(members, key=rank)  # the first of equals
        lows = [r[8] for r in members if r[8] is not None]
        highs = [r[9] for r in members if r[9] is not None]
        best.add((*key, winner[6], winner[7], min(lows, default=None), max(highs, default=None), winner[3]))
    return best


def as_set(best):
    return {
        (r.facility_id, r.description, r.codes_key, r.cash_price, r.gross_charge,
         r.negotiated_min, r.negotiated_max, r.source_row)
        for r in best.collect()
    }


def test_best_records(spark):
    rows = random_lines(2000)
    lines = spark.createDataFrame(rows, LINES).repartition(7)
    best = D.best_records(lines)
    assert as_set(best) == brute_force(rows)
    again = D.best_records(best.select(*lines.columns))
    assert as_set(again) == as_set(best)
    parts = [spark.createDataFrame(rows[i::3], LINES) for i in range(3)]
    merged = [D.best_records(p).select(*lines.columns) for p in parts]
    assert as_set(D.best_records(merged[0].union(merged[1]).union(merged[2]))) == as_set(best)


def test_best_records_combine_before_the_shuffle(spark):
    plan = D.best_records(spark.createDataFrame(random_lines(10), LINES))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "partial_min_by" in text


def operations(spark, rows):
    """Operations of (facility_id, description, cash, gross, low, high) rows."""
    df = spark.createDataFrame(
        rows, "facility_id string, description string, cash_price double, gross_charge double,"
        " negotiated_min double, negotiated_max double"
    )
    return df.withColumns(
        {
            "codes": F.expr("map('RC', array('0450'))"),
            "rc_code": F.lit("0450"),
            "hcpcs_code": F.lit(None).cast("string"),
            "currency": F.lit("USD"),
            "ingested_at": F.lit(DAY_1),
        }
    ).select(*OPERATIONS.names)


def hospitals(spark, ids, version="1"):
    fields = (
        "facility_id string, facility_name string, city string, state string, address string,"
        " source_url string, file_version string, last_updated string"
    )
    rows = [(i, f"Hospital {i}", "Austin", "TX", "1 Main St", "/x", version, "2025-01-01") for i in ids]
    return spark.createDataFrame(rows, fields).withColumn("ingested_at", F.lit(DAY_1))


def test_pricing_summary_keeps_hospitals_without_operations(spark):
    ops = W.to_table_types(operations(spark, [("a", "x", 1.0, None, None, None), ("a", "y", 2.0, 4.0, None, None)]))
    got = {r.facility_id: r for r in V.pricing_summary(hospitals(spark, ["a", "b"]), ops).collect()}
    assert (got["a"].total_operations, got["a"].avg_cash_price, got["a"].avg_gross_charge) == (2, 1.5, 4.0)
    assert (got["b"].total_operations, got["b"].avg_cash_price, got["b"].min_cash_price) == (0, None, None)


def test_price_filter_reaches_the_scan(spark):
    path = new_folder(spark, "t")
    W.write_operations(operations(spark, [("a", "x", 1.0, 2.0, None, None)]), path)
    stored = W.read_table(spark, path, W.STORED_OPERATIONS)
    found = V.operations_matching(stored, facility_id="a", min_price=5.0, description="MRI")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(cash_price" in plan and "PartitionFilters: [isnotnull(facility_id" in plan


@pytest.mark.parametrize("block_bytes", [1, 200, 1 << 20])
def test_search_many(spark, block_bytes):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 8)).astype("float32")
    vectors[5] = 0
    cache = spark.createDataFrame(
        [(i, f"q{i}", 0.8 + 0.01 * (i % 20), v.tolist()) for i, v in enumerate(vectors)],
        "id long, user_query string, confidence_score double, query_embedding array<float>",
    ).withColumn("confidence_score", F.col("confidence_score").cast("decimal(3,2)"))
    queries = spark.createDataFrame(
        [(i, vectors[i].tolist()) for i in (5, 7, 11, 13)], "query_id long, query_vector array<float>"
    )
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)
    expected = {}
    for q in (5, 7, 11, 13):
        sims = unit.astype("float64") @ unit[q].astype("float64")
        hits = [(round(float(s), 5), i) for i, s in enumerate(sims) if i % 20 >= 10 and s > 0.3]
        for rank, (s, i) in enumerate(sorted(hits, key=lambda h: (-h[0], h[1]))[:4], 1):
            expected[q, rank] = (i, s)
    got = Y.search_many(cache, queries, threshold=0.3, limit=4, block_bytes=block_bytes)
    assert {(r.query_id, r.rank): (r.id, round(r.similarity, 5)) for r in got.collect()} == expected
    one = Y.search(cache, vectors[7].tolist(), threshold=0.3, limit=4).collect()
    assert [r.id for r in one] == [expected[7, k][0] for k in range(1, 5) if (7, k) in expected]
    assert Y.search(cache, [0.0] * 8, threshold=-1.0).count() == 0


def test_store_is_idempotent_and_keeps_other_facilities(spark):
    target = new_folder(spark, "tables")
    rows = [("007", "x", 1.0, 2.0, None, None), ("b", "y", 1.0, 2.0, 5.0, 4.0), ("b", "z", 1.0, 3.0, 1.0, 4.0)]

    class Result:
        """What a run read: one file per facility, and its accepted lines."""

        options = I.Options(ingested_at=DAY_1)

        def __init__(self, rows, ids, version):
            told = hospitals(spark, ids, version).drop("ingested_at", "source_url")
            self.catalog = told.withColumns(
                {"file": F.col("facility_id"), "path": F.col("facility_id"), "status": F.lit("ok")}
            )
            lines = [(r[0], r[0], 0, i, r[1], '{"RC":["1"]}', *r[2:]) for i, r in enumerate(rows)]
            self.lines = spark.createDataFrame(lines, LINES).withColumns(
                {"setting": F.lit(""), "accepted": F.lit(True), "reasons": F.array().cast("array<string>")}
            )

    W.store(Result(rows, ["007", "b"], "1"), target, F.lit(DAY_1))
    W.store(Result(rows[1:], ["b"], "2"), target, F.lit(DAY_2))
    W.store(Result(rows[1:], ["b"], "2"), target, F.lit(DAY_2))
    ops = W.read_operations(spark, target)
    assert sorted((r.facility_id, r.description) for r in ops.collect()) == [("007", "x"), ("b", "z")]
    assert str(ops.schema["cash_price"].dataType) == "DecimalType(10,2)"
    got = {r.facility_id: r for r in W.read_hospitals(spark, target).collect()}
    assert (got["007"].file_version, got["007"].updated_at) == ("1", DAY_1)
    assert (got["b"].file_version, got["b"].created_at, got["b"].updated_at) == ("2", DAY_1, DAY_2)
    set_aside = W.read_quarantine(spark, target).collect()
    assert [(r.description, r.broken_rules) for r in set_aside] == [("y", ["negotiated_range"])]

    assert W.purge_tables(spark, target, ["b"]) == {"medical_operations": 1, "hospitals": 1}
    assert [r.facility_id for r in W.read_operations(spark, target).collect()] == ["007"]
    assert W.purge_tables(spark, target) == {"medical_operations": 1, "hospitals": 1}


def test_ndjson_sink_counts(spark):
    ops = operations(spark, [("a", "x", 1.0, 2.0, None, None), ("a", "y", 1.0, 2.0, None, None)])
    assert W.write_ndjson(ops, new_folder(spark, "nd")) == 2


def test_cache_append_sets_invalid_entries_aside(spark):
    path = new_folder(spark, "cache")
    entries = spark.createDataFrame(
        [(1, "a", 0.95, [1.0, 2.0]), (2, "b", 1.5, [1.0, 2.0]), (3, "c", 0.5, [1.0])],
        "id long, user_query string, confidence_score double, query_embedding array<float>",
    )
    bad = KC.append(entries, path, 2, F.lit(DAY_1))
    assert {r.id: r.broken_rules for r in bad.collect()} == {
        2: ["confidence_range"], 3: ["embedding_dimension"]
    }
    stored = spark.read.parquet(path).first()
    assert (stored.id, stored.hcpcs_codes, stored.reasoning) == (1, [], "")


def test_unique_ids(spark):
    twice = hospitals(spark, ["a", "b"]).union(hospitals(spark, ["a"]))
    assert [(r.facility_id, r.n_rows) for r in Q.id_collisions(twice).collect()] == [("a", 2)]


def test_stream_equals_batch_and_survives_repeats(spark, tmp_path):
    meta = (
        "hospital_name,last_updated_on,version,hospital_location,hospital_address\n"
        'Stream Hospital,2025-07-23,2.0.0,"Austin, TX","1 Main St, Austin, TX 73301"\n'
    )
    header = "description,code,code_type,gross,cash,min,max\n"
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    options = I.Options(ingested_at=DAY_1)
    for i, line in enumerate(["X,1,CPT,9,5,2,3\n", "X,1,CPT,8,7,1,2\nY,2,RC,9,1,,\n", "X,1,CPT,7,6,3,9\n"]):
        (source / f"{i}.csv").write_text(meta + header + line)
        L.watch(spark, str(source), target, str(tmp_path / "ck"), options=options).awaitTermination()
    stored = W.read_operations(spark, target)
    rows = sorted((r.description, float(r.cash_price), float(r.gross_charge), r.negotiated_min, r.negotiated_max) for r in stored.collect())
    assert rows == [("X", 7.0, 8.0, 1, 9), ("Y", 1.0, 9.0, None, None)]
    batch = I.ingest_directory(spark, str(source), options=options)
    assert stored.count() == batch.operations.count() == 2
    L.merge_batch(S.manifest(spark, str(source)), target, options)
    again = W.read_operations(spark, target)
    assert sorted((r.description, float(r.cash_price)) for r in again.collect()) == [("X", 7.0), ("Y", 1.0)]


def test_display_texts_are_made_before_names_repeat_an_operation(spark, monkeypatch):
    one = (["f", {"RC": ["1"]}, "1", None, "d", 1.0, None, 2.0, None, "USD", DAY_1],)
    hospitals = spark.createDataFrame([("f", "A"), ("f", "B")], "facility_id string, facility_name string")
    monkeypatch.setattr(registry, "table_operations", lambda *_: spark.createDataFrame(one, OPERATIONS))
    monkeypatch.setattr(registry.X, "hospitals", lambda *_: hospitals)
    shown = registry.price_display(spark, "")
    assert sorted((r.facility_name, r.cash_text, r.negotiated_text) for r in shown.collect()) == [
        ("A", "$1.00", "$2.00 - N/A"), ("B", "$1.00", "$2.00 - N/A")
    ]
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("format_string")
