"""Files as they come: stray quotes, broken documents, colliding names; loading again and again."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pricelake.operators import similarity as Y
from pricelake.plans import ingest as I, report as R
from pricelake.runtime import shared_folder
from pricelake.sinks import cache as KC, tables as W
from pricelake.sources import sniff as S
from pricelake.streaming import directory as L

NOW = datetime(2025, 1, 1)
OPTIONS = I.Options(ingested_at=NOW)
HEADER = "description,code|1,code|1|type,setting,standard_charge|gross,standard_charge|discounted_cash\n"


def meta(name, updated="2025-07-23", version="2.0.0"):
    return (
        "hospital_name,last_updated_on,version,hospital_location,hospital_address\n"
        f'{name},{updated},{version},"Austin, TX","1 East St, Austin, TX 78613"\n'
    )


def line(description, code, cash=5):
    return f"{description},{code},CPT,outpatient,9,{cash}\n"


def item(description, code="1"):
    return {
        "description": description,
        "code_information": [{"code": code, "type": "CPT"}],
        "standard_charges": [{"setting": "outpatient", "discounted_cash": 5, "gross_charge": 6}],
    }


def wrapped(name, items):
    return {
        "hospital_name": name, "hospital_address": ["1 Main St, Austin, TX 73301"], "version": "2.0.0",
        "last_updated_on": "2025-01-02", "standard_charge_information": items,
    }


def ingest(spark, folder, pattern="*", **more):
    return I.ingest_directory(spark, str(folder), pattern, OPTIONS, **more)


def descriptions(done):
    return sorted(r.description for r in done.operations.select("description").collect())


def report_of(done):
    return {os.path.basename(r.path): r for r in done.report.collect()}


@pytest.fixture(params=["64", "134217728"])
def splits(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_inch_marks_and_unclosed_quotes(spark, tmp_path, splits):
    body = (
        HEADER + line('CATH 5" LONG', 1) + line('TUBE 6" X', 2) + line('"say ""hi"""', 3) + line('"two\nlines"', 4)
        + HEADER + line("plain", 5) + line('"never closed', 6) + line("after", 7) + line("end", 8)
    )
    (tmp_path / "a.csv").write_text(meta("Inch Clinic") + body)
    done = ingest(spark, tmp_path)
    assert descriptions(done) == sorted(['CATH 5" LONG', 'TUBE 6" X', 'say "hi"', "two\nlines", "plain", "after", "end"])
    r = report_of(done)["a.csv"]
    assert (r.status, r.read_records, r.failed_records, r.broken_records) == ("malformed", 9, 2, 1)


def test_bare_carriage_returns(spark, tmp_path):
    (tmp_path / "cr.csv").write_bytes((meta("Old Mac Clinic") + HEADER + line("a", 1) + line("b", 2)).replace("\n", "\r").encode())
    assert descriptions(ingest(spark, tmp_path)) == ["a", "b"]


def test_mixed_and_truncated_documents(spark, tmp_path, splits):
    items = [item(f"i{k}", str(k)) for k in range(5)]
    mixed = [items[0], [items[1], items[2]], items[3], [[items[4]]]]
    (tmp_path / "mixed.json").write_text(json.dumps(wrapped("Mixed Place", mixed), indent=1))
    whole = json.dumps(wrapped("Short Place", items))
    (tmp_path / "cut.json").write_text(whole[: whole.index('"i3"') + 12])
    (tmp_path / "cutinside.json").write_text(json.dumps(wrapped("Third Home", items))[:-60])
    done = ingest(spark, tmp_path)
    per = {}
    for r in done.lines.where("accepted").select("source_file", "description").collect():
        per.setdefault(os.path.basename(r.source_file), []).append(r.description)
    assert {k: sorted(v) for k, v in per.items()} == {
        "mixed.json": ["i0", "i1", "i2", "i3", "i4"], "cut.json": ["i0", "i1", "i2"], "cutinside.json": ["i0", "i1", "i2", "i3"],
    }
    report = report_of(done)
    assert {k: (r.status, r.broken_records) for k, r in report.items()} == {
        "mixed.json": ("ok", 0), "cut.json": ("malformed", 1), "cutinside.json": ("malformed", 1),
    }


def test_long_first_line_of_ndjson(spark, tmp_path):
    long = {**item("long"), "note": "x" * 5_000_000}
    (tmp_path / "rows.json").write_text("\n".join(map(json.dumps, [long, item("b", "2"), item("c", "3")])))
    given = spark.createDataFrame([(str(tmp_path / "rows.json"), "Given", "Austin", "TX", "x")], "path string, facility_name string, city string, state string, address string")
    done = ingest(spark, tmp_path, metadata=given)
    assert descriptions(done) == ["b", "c", "long"] and report_of(done)["rows.json"].format == "ndjson"


def test_header_behind_the_items(spark, tmp_path):
    doc = wrapped("Late Clinic", [item("pad" + "x" * 100_000)])
    late = {"standard_charge_information": doc.pop("standard_charge_information"), **doc}
    (tmp_path / "late.json").write_text(json.dumps(late))
    assert ingest(spark, tmp_path).hospitals.first().facility_name == "Late Clinic"


def test_one_bad_file_does_not_end_the_run(spark, tmp_path):
    (tmp_path / "good.csv").write_text(meta("Good Clinic") + HEADER + line("a", 1))
    (tmp_path / "huge.csv").write_text(meta("Huge Clinic") + HEADER + ('"' + "x" * 33_000_000))
    done = ingest(spark, tmp_path)
    report = report_of(done)
    assert report["good.csv"].status == "ok" and report["good.csv"].processing_seconds > 0
    assert report["huge.csv"].status in ("unreadable", "malformed")
    total = R.totals(done.report).first()
    assert total.files == 2 and total.processing_seconds == pytest.approx(sum(r.processing_seconds for r in report.values()))
    assert total.file_errors == sum(r.error is not None for r in report.values())


def test_files_that_cannot_be_opened(spark, tmp_path):
    (tmp_path / "x.csv").write_text(meta("X Clinic") + HEADER + line("a", 1))
    (tmp_path / "y.csv").write_text(meta("Y House") + HEADER + line("b", 1))
    files = S.manifest(spark, str(tmp_path)).withColumn(
        "path", F.when(F.col("path").endswith("y.csv"), F.concat("path", F.lit(".gone"))).otherwise(F.col("path"))
    )
    done = I.ingest_files(files, OPTIONS)
    assert descriptions(done) == ["a"]
    status = {os.path.basename(r.path): (r.status, bool(r.error)) for r in done.report.collect()}
    assert status == {"x.csv": ("ok", False), "y.csv.gone": ("unreadable", True)}


def test_names_that_share_an_id_are_not_merged(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i, name in enumerate(("Northside Hospital", "Northern Hospital", "Other Place")):
        (inbox / f"{i}.csv").write_text(meta(name) + HEADER + line("a", 1))
    done = ingest(spark, inbox)
    assert sorted(r.status for r in done.report.collect()) == ["id_collision", "id_collision", "ok"]
    assert done.hospitals.count() == 1 and done.operations.count() == 1
    # against what an earlier run stored
    first = ingest(spark, inbox, "0.csv")
    W.store(first, str(tmp_path / "lake"))
    again = ingest(spark, inbox, "[01].csv", stored=W.read_hospitals(spark, str(tmp_path / "lake")))
    assert {r.status for r in again.report.collect()} == {"id_collision"}


def stored(spark, lake):
    operations = W.read_operations(spark, lake).select("facility_id", "description").collect()
    return sorted((r.facility_id, r.description) for r in operations)


def test_a_second_file_adds_and_a_reload_replaces(spark, tmp_path):
    lake = str(tmp_path / "lake")
    inbox = tmp_path / "in"
    inbox.mkdir()
    write = lambda name, text: (inbox / name).write_text(text)
    write("a.csv", meta("Home Clinic") + HEADER + line("a", 1) + line("both", 2, 5))
    W.store(ingest(spark, inbox, "a.csv"), lake)
    write("b.csv", meta("Home Clinic", "2025-08-01") + HEADER + line("b", 3) + line("both", 2, 7))
    W.store(ingest(spark, inbox, "b.csv"), lake)
    assert [d for _, d in stored(spark, lake)] == ["a", "b", "both"]
    best = W.read_operations(spark, lake).where("description = 'both'").first()
    assert float(best.cash_price) == 7
    # an older file that comes later does not decide the hospital row
    write("c.csv", meta("Home Clinic", "06/30/2025") + HEADER + line("c", 4))
    W.store(ingest(spark, inbox, "c.csv"), lake)
    assert W.read_hospitals(spark, lake).first().last_updated == "2025-08-01"
    # a reload without acceptable rows takes its rows away
    write("b.csv", meta("Home Clinic", "2025-08-01") + HEADER + line("b", 3, ""))
    W.store(ingest(spark, inbox, "b.csv"), lake)
    assert [d for _, d in stored(spark, lake)] == ["a", "both", "c"]
    write("a.csv", meta("Home Clinic") + HEADER)
    write("c.csv", meta("Home Clinic") + HEADER)
    W.store(ingest(spark, inbox), lake)
    assert stored(spark, lake) == []


def test_corrected_rows_leave_the_quarantine(spark, tmp_path):
    lake, inbox = str(tmp_path / "lake"), tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.csv").write_text(meta("Home Clinic") + HEADER + line("a", 1) + line("huge", 2, 10**12))
    W.store(ingest(spark, inbox), lake)
    assert [d for _, d in stored(spark, lake)] == ["a"]
    assert W.read_quarantine(spark, lake).count() == 1
    (inbox / "a.csv").write_text(meta("Home Clinic") + HEADER + line("a", 1) + line("huge", 2, 10))
    W.store(ingest(spark, inbox), lake)
    assert [d for _, d in stored(spark, lake)] == ["a", "huge"]
    assert W.read_quarantine(spark, lake).count() == 0


def test_operations_of_a_quarantined_hospital_are_set_aside(spark, tmp_path):
    lake, inbox = str(tmp_path / "lake"), tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.csv").write_text(meta("Home Clinic", version="") + HEADER + line("a", 1))
    (inbox / "b.csv").write_text(meta("Other House") + HEADER + line("b", 1))
    W.store(ingest(spark, inbox), lake)
    assert [d for _, d in stored(spark, lake)] == ["b"] and W.read_hospitals(spark, lake).count() == 1
    aside = W.read_quarantine(spark, lake).first()
    assert aside.description == "a" and W.ORPHANED in aside.broken_rules


def test_codes_of_any_type_are_looked_up_in_the_scan(spark, tmp_path):
    lake, inbox = str(tmp_path / "lake"), tmp_path / "in"
    inbox.mkdir()
    both = "description,code|1,code|1|type,code|2,code|2|type,setting,standard_charge|gross,standard_charge|discounted_cash\n"
    (inbox / "a.csv").write_text(meta("Home Clinic") + both + "x,1,CPT,1,RC,,9,5\ny,2,CPT,3,RC,,9,5\nz,4,CPT,1,RC,,9,5\n")
    W.store(ingest(spark, inbox), lake)
    assert [r for r in W.read_by_code(spark, lake, "9").collect()] == []
    names = lambda *a: sorted(r.description for r in W.read_by_code(spark, lake, *a).collect())
    assert (names("1"), names("1", "HCPCS"), names("3")) == (["x", "z"], ["x"], ["y"])
    plan = W.read_by_code(spark, lake, "1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(code,1)" in plan


def test_purged_rows_stay_away(spark, tmp_path):
    lake, inbox = str(tmp_path / "lake"), tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.csv").write_text(meta("Home Clinic") + HEADER + line("a", 1))
    (inbox / "b.csv").write_text(meta("Other House") + HEADER + line("b", 1))
    W.store(ingest(spark, inbox), lake)
    gone = [r.facility_id for r in W.read_hospitals(spark, lake).where("facility_name = 'Home Clinic'").collect()]
    assert W.purge_tables(spark, lake, gone) == {"medical_operations": 1, "hospitals": 1}
    (inbox / "c.csv").write_text(meta("Home Clinic") + HEADER + line("c", 1))
    W.store(ingest(spark, inbox, "c.csv"), lake)
    assert sorted(d for _, d in stored(spark, lake)) == ["b", "c"]
    assert W.purge_tables(spark, lake) == {"medical_operations": 2, "hospitals": 2}
    W.store(ingest(spark, inbox, "b.csv"), lake)
    assert [d for _, d in stored(spark, lake)] == ["b"]


@pytest.mark.parametrize("order", [("2025-01-01", "2025-06-01"), ("2025-06-01", "2025-01-01")])
def test_stream_equals_batch_in_any_order(spark, tmp_path, order):
    lake, inbox = str(tmp_path / "lake"), tmp_path / "in"
    inbox.mkdir()
    for i, updated in enumerate(order):
        (inbox / f"{i}.csv").write_text(meta("Home Clinic", updated) + HEADER + line(f"d{i}", i))
        query = L.watch(spark, str(inbox), lake, str(tmp_path / "checkpoint"), options=OPTIONS)
        query.awaitTermination()
    assert sorted(d for _, d in stored(spark, lake)) == ["d0", "d1"]
    assert W.read_hospitals(spark, lake).first().last_updated == "2025-06-01"


def test_exports_of_different_facilities_stay_side_by_side(spark, tmp_path):
    done = spark.createDataFrame([("a", "x", {"RC": ["1"]}), ("b", "y", {"RC": ["2"]})], "facility_id string, description string, codes map<string,array<string>>")
    for kind, write, read in (("json", W.write_json, spark.read.json), ("csv", W.write_csv, spark.read.option("header", True).csv)):
        path = str(tmp_path / kind)
        for facility in ("a", "b", "b"):
            write(done.where(F.col("facility_id") == facility), path)
        assert sorted(r.facility_id for r in read(path).collect()) == ["a", "b"]


def test_scratch_folders_are_removed(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.csv").write_text(meta("Home Clinic") + HEADER + line("a", 1))
    query = L.watch(spark, str(inbox), str(tmp_path / "lake"), str(tmp_path / "checkpoint"), options=OPTIONS)
    before = set(os.listdir(shared_folder(spark)))
    query.awaitTermination()
    assert not {f for f in os.listdir(shared_folder(spark)) if f.startswith(("batch", "lines", "records"))} - before


def test_schemes_of_file_heads():
    assert S.arrow_uri("s3a://b/k.csv") == "s3://b/k.csv" and S.arrow_uri("hdfs://n/k") == "hdfs://n/k"
    assert S.arrow_uri("/local/x") == "/local/x"


def test_vectors_that_cannot_be_compared_are_skipped(spark):
    cache = spark.createDataFrame(
        [(1, 0.95, [1.0, 0.0]), (2, 0.95, None), (3, 0.95, [1.0]), (4, 0.95, [None, 1.0]), (5, 0.95, [0.0, 1.0])],
        "id long, confidence_score double, query_embedding array<double>",
    )
    queries = spark.createDataFrame([(7, [1.0, 0.1]), (8, None), (9, [1.0])], "query_id long, query_vector array<double>")
    found = {(r.query_id, r.id) for r in Y.search_many(cache, queries, threshold=0.5).collect()}
    assert found == {(7, 1), (9, 3)}
    assert [r.id for r in Y.search(cache, [1.0, 0.1], 0.5).collect()] == [1]


def test_cache_append_sets_odd_scores_aside(spark, tmp_path):
    entries = spark.createDataFrame([(1, "a", 0.5, [1.0]), (2, "b", 5000.0, [1.0])], "id long, user_query string, confidence_score double, query_embedding array<float>")
    aside = KC.append(entries, str(tmp_path / "cache"), 1).collect()
    assert [(r.id, r.broken_rules) for r in aside] == [(2, ["confidence_range"])]
    assert [r.id for r in spark.read.parquet(str(tmp_path / "cache")).collect()] == [1]
