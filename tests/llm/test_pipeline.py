"""The pipeline's stages against brute force, each on what its predecessor kept."""

import collections
import os

import pytest

import corpus_pipeline
from test_dedup import shingle_set
from pricelake.llm import decontaminate, quality, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def near_groups(rows, size, share):
    """Rows that brute force links, as sets of positions."""
    sets = [shingle_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, s in enumerate(sets):
        groups[find(i) if s else ("empty", i)].append(rows[i][0])
    return list(groups.values())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "decontamination", "packing"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    benchmark = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = dict(rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, FOLDER)
        found.write.parquet(str(tmp_path / str(k)))
        found = spark.read.parquet(str(tmp_path / str(k)))
        if name == "packing":
            assert {r.doc_id for r in found.select("doc_id").collect()} == set(kept)
            sizes = found.groupBy("sequence_id").sum("length").collect()
            assert max(r[1] for r in sizes) <= 1024
            whole = found.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
            assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in whole)
            break
        assert found.columns == docs.columns
        if name == "quality classifier":
            bad = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 0").collect()}
            assert bad
        elif name == "exact dedup":
            last = {}
            for d, t in kept.items():
                last[t] = max(d, last.get(t, d))
            bad = set(kept) - set(last.values())
        elif name == "near dedup":
            bad = {d for g in near_groups(sorted(kept.items()), 5, 80) for d in g if d != min(g)}
        else:
            words = lambda t: decontaminate.A.words(
                *decontaminate.A.text_bytes(decontaminate.pa.array([t.lower()])), decontaminate.A.LETTERS
            ).hashes.tolist()
            items = [words(t) for t in benchmark]
            bad = {
                d for d, t in kept.items()
                if any(decontaminate.best_match(i, words(t))[0] <= decontaminate.edits_allowed(len(i)) for i in items if i)
            }
        kept = {d: t for d, t in kept.items() if d not in bad}
        assert {r.doc_id: r.text for r in found.collect()} == kept, name
        docs = found


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows and none at all go through."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id here", "en", "a", 1), (3, "a b c", "en", None, 2), (3, "a b c", "en", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = stage(spark, docs, FOLDER)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.where("doc_id IS NULL").count() == 1
    assert corpus_pipeline.STAGES[4][1](spark, docs, FOLDER).count() == docs.count()
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), FOLDER).count() == 0


def test_run_is_registered(spark):
    assert queries.QUERIES["pipeline"] and corpus_pipeline.ORACLE_SQL is None
