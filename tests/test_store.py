"""The stored tables: one commit for all, generations that follow the batch, merging, lookups that open few files, summaries."""

import os

import pytest
from pyspark.sql import functions as F

from pricelake.operators import serving as V
from pricelake.sinks import generations as G, tables as W
from test_rough_files import HEADER, ingest, line, meta


def rows_of(df, *columns):
    return sorted(tuple(str(v) for v in r) for r in (df.select(*columns) if columns else df).collect())


def everything(spark, lake):
    """What readers see of all tables."""
    return (
        rows_of(W.read_operations(spark, lake), "facility_id", "description", "cash_price"),
        rows_of(W.read_hospitals(spark, lake).drop("updated_at", "ingested_at")),
        rows_of(W.read_by_code(spark, lake, "1"), "facility_id", "description", "cash_price"),
        rows_of(W.read_quarantine(spark, lake), "description", "broken_rules"),
        rows_of(W.read_summary(spark, lake).drop("ingested_at")),
    )


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    return folder


def test_a_run_that_stops_anywhere_changes_nothing(spark, tmp_path, inbox, monkeypatch):
    lake = str(tmp_path / "lake")
    (inbox / "a.csv").write_text(meta("Home Clinic") + HEADER + line("a", 1) + line("huge", 2, 10**12))
    W.store(ingest(spark, inbox), lake)
    before = everything(spark, lake)
    assert before[0] and before[3]
    (inbox / "a.csv").write_text(meta("Home Clinic", "2025-09-09") + HEADER + line("a", 1, 9) + line("b", 1, 4))
    (inbox / "b.csv").write_text(meta("Other House") + HEADER + line("c", 1))
    result = ingest(spark, inbox)
    write, publish, count = G.write, G.publish, [0]

    class Stopped(Exception):
        pass

    def stopping(at):
        count[0] = 0

        def stop(*args):
            count[0] += 1
            if count[0] == at:
                raise Stopped
            write(*args)

        return stop

    at = 0
    while True:
        at += 1
        monkeypatch.setattr(G, "write", stopping(at))
        monkeypatch.setattr(G, "publish", lambda new: (_ for _ in ()).throw(Stopped))
        with pytest.raises(Stopped):
            W.store(result, lake)
        assert rows_of(W.read_operations(spark, lake), "facility_id", "description", "cash_price") == before[0]
        assert rows_of(W.read_hospitals(spark, lake).drop("updated_at", "ingested_at")) == before[1]
        if count[0] < at:  # every write was made, the commit was not
            break
    assert everything(spark, lake) == before
    assert at > 10
    monkeypatch.setattr(G, "write", write)
    monkeypatch.setattr(G, "publish", publish)
    W.store(result, lake)
    after = everything(spark, lake)
    assert [r[1:] for r in after[0]] == [("a", "9.00"), ("b", "4.00"), ("c", "5.00")] and not after[3]
    # what broke off has been deleted
    assert len(os.listdir(f"{lake}/state")) == 2


def test_two_runs_at_once_do_not_overwrite_each_other(spark, tmp_path, inbox):
    lake = str(tmp_path / "lake")
    (inbox / "a.csv").write_text(meta("Home Clinic") + HEADER + line("a", 1))
    W.store(ingest(spark, inbox), lake)
    found = G.snapshot(spark, lake)
    (inbox / "a.csv").write_text(meta("Home Clinic") + HEADER + line("b", 1))
    W.store(ingest(spark, inbox), lake)
    before = everything(spark, lake)
    with pytest.raises(G.Outrun):
        G.publish(found.with_generation(found.generations[0]))
    assert everything(spark, lake) == before


def test_a_batch_writes_what_it_changes(spark, tmp_path, inbox):
    """A file of two lines for a facility of thousands of rows writes a handful of rows."""
    lake = str(tmp_path / "lake")
    many = "".join(line(f"op {i}", i) for i in range(3000))
    (inbox / "a.csv").write_text(meta("Home Clinic") + HEADER + many)
    W.store(ingest(spark, inbox, "a.csv"), lake)
    (inbox / "b.csv").write_text(meta("Home Clinic") + HEADER + line("op 7", 7, 99) + line("new", 1))
    W.store(ingest(spark, inbox, "b.csv"), lake)
    found = G.snapshot(spark, lake)
    size = lambda name: sum(
        os.path.getsize(os.path.join(d, f)) for t in os.listdir(lake) for d, _, fs in os.walk(f"{lake}/{t}/generation={name}") for f in fs
    )
    first, second = (g.name for g in found.generations)
    written = {t: spark.read.parquet(f"{lake}/{t}/generation={second}").count() for t in ("state", "medical_operations", "operations_by_code", "groups")}
    assert written == {"state": 2, "medical_operations": 2, "operations_by_code": 2, "groups": 2}
    assert size(second) < 0.5 * size(first)
    prices = {r.description: float(r.cash_price) for r in W.read_operations(spark, lake).collect()}
    assert len(prices) == 3001 and prices["op 7"] == 99 and prices["op 8"] == 5
    # the second file is taken back: the group falls to the first again
    (inbox / "b.csv").write_text(meta("Home Clinic") + HEADER + line("new", 1, 3))
    W.store(ingest(spark, inbox, "b.csv"), lake)
    prices = {r.description: float(r.cash_price) for r in W.read_operations(spark, lake).collect()}
    assert len(prices) == 3001 and prices["op 7"] == 5 and prices["new"] == 3


def test_many_batches_stay_few_generations(spark, tmp_path, inbox, monkeypatch):
    """Batches of one file each, some of them again: merged on the way, with the rows of one run over all files."""
    monkeypatch.setattr(G, "MOST_GENERATIONS", 3)
    lake = str(tmp_path / "lake")
    files = set()
    for i in range(6):
        name = f"{i % 5}.csv"
        files.add(name)
        (inbox / name).write_text(meta("Home Clinic" if i % 2 else "Other House") + HEADER + line("same", 1, 5 + i) + line(f"own {i}", i + 1))
        W.store(ingest(spark, inbox, name), lake)
        found = G.snapshot(spark, lake)
        assert len(found.generations) <= 3
        assert found.files() <= 3 * sum(t.buckets for t in G.TABLES.values())
    whole = str(tmp_path / "whole")
    W.store(ingest(spark, inbox), whole)
    assert everything(spark, lake)[:1] == everything(spark, whole)[:1]
    assert everything(spark, lake)[2:] == everything(spark, whole)[2:]


def test_a_hospital_that_comes_to_break_the_rules_takes_its_operations_along(spark, tmp_path, inbox):
    lake = str(tmp_path / "lake")
    (inbox / "a.csv").write_text(meta("Home Clinic", "2025-01-01") + HEADER + line("a", 1) + line("b", 2))
    W.store(ingest(spark, inbox, "a.csv"), lake)
    (inbox / "b.csv").write_text(meta("Home Clinic", "2025-02-01", version="") + HEADER + line("c", 1))
    W.store(ingest(spark, inbox, "b.csv"), lake)
    assert everything(spark, lake)[0] == [] and W.read_hospitals(spark, lake).count() == 0
    assert [r[0] for r in everything(spark, lake)[3]] == ["a", "b", "c"]
    (inbox / "b.csv").write_text(meta("Home Clinic", "2025-02-01") + HEADER + line("c", 1))
    W.store(ingest(spark, inbox, "b.csv"), lake)
    assert [r[1] for r in everything(spark, lake)[0]] == ["a", "b", "c"] and not everything(spark, lake)[3]


def test_a_code_opens_few_files_of_many_facilities(spark, tmp_path):
    """A thousand facilities: a lookup opens the files of one bucket, none per facility."""
    lake = str(tmp_path / "lake")
    rows = spark.range(20_000).select(
        F.concat(F.lit("f-"), F.col("id") % 1000).alias("facility_id"),
        F.concat(F.lit("op "), "id").alias("description"),
        F.create_map(F.lit("HCPCS"), F.array((F.col("id") % 500).cast("string"))).alias("codes"),
        F.lit(1.0).alias("cash_price"), F.lit(2.0).alias("gross_charge"), F.lit("USD").alias("currency"),
    )
    missing = [f for f in (*W.STORED_OPERATIONS.names, "group_hash") if f not in rows.columns]
    rows = rows.withColumns({c: F.lit(None) for c in missing})
    found = G.snapshot(spark, lake)
    name = G.new_name(found)
    G.write(W.by_code(rows), lake, "operations_by_code", name)
    G.commit(found, name)
    got = W.read_by_code(spark, lake, "77")
    assert got.count() == 40 and got.select("facility_id").distinct().count() == 2
    every = G.snapshot(spark, lake).files()
    assert len(got.inputFiles()) == 1 and every > 50
    assert "EqualTo(code,77)" in got._jdf.queryExecution().executedPlan().toString()


def test_one_facility_opens_its_bucket(spark, tmp_path, inbox):
    lake = str(tmp_path / "lake")
    for i in range(12):
        (inbox / f"{i}.csv").write_text(meta(f"Clinic{'abcdefghijkl'[i]} {i}") + HEADER + line("a", 1))
    W.store(ingest(spark, inbox), lake)
    ids = [r.facility_id for r in W.read_hospitals(spark, lake).collect()]
    assert len(ids) == 12
    for one in ids[:3]:
        rows = W.read_operations(spark, lake, one)
        assert [r.facility_id for r in rows.collect()] == [one]
        assert len(rows.inputFiles()) == 1


def test_the_kept_summary_is_the_computed_one(spark, tmp_path, inbox):
    lake = str(tmp_path / "lake")

    def same():
        kept = W.read_summary(spark, lake)
        computed = V.pricing_summary(W.read_hospitals(spark, lake), W.read_operations(spark, lake))
        assert rows_of(kept) == rows_of(computed)
        assert not [f for f in kept.inputFiles() if "operations" in f]
        return kept.count()

    (inbox / "a.csv").write_text(meta("Home Clinic") + HEADER + line("a", 1, 3) + line("b", 2, 8))
    (inbox / "b.csv").write_text(meta("Other House") + HEADER + line("c", 1))
    W.store(ingest(spark, inbox), lake)
    assert same() == 2
    (inbox / "a.csv").write_text(meta("Home Clinic") + HEADER + line("a", 1, 4))
    W.store(ingest(spark, inbox, "a.csv"), lake)
    assert same() == 2
    W.purge_tables(spark, lake, [W.read_operations(spark, lake).where("description = 'c'").first().facility_id])
    assert same() == 1
    assert W.purge_tables(spark, lake) == {"medical_operations": 1, "hospitals": 1} and same() == 0
