"""Exact and near duplicates, components, shards: against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from pricelake import runtime
from pricelake.llm import exact_dedup, graph, near_dedup, ranks, shards
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, source string, key long, node string, id string, n int, cell int, rank int, band long"


def frame(spark, rows):
    """Documents with extra columns named like those the operators use inside."""
    return spark.createDataFrame([(i, t, s, 1, "x", "y", 2, 3, 4, 5) for i, t, s in rows], DOCS)


def odd_rows():
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "b"), (5, "one", "b"), (5, "one", "b"), (None, "one", "b"),
            (6, "two words", "a"), (7, "TWO words", "a"), (8, long, "a"), (9, long + " end", "a"), (None, None, None), (10, "É é", "c"), (11, "é é", "c")]


def near_rows(seed, n=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.6:
            w = rnd.choice(rows)[1].split()
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
        else:
            w = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 5, 30, 80, 200]))]
        rows.append((i, " ".join(w), "s"))
    rnd.shuffle(rows)
    return rows


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def brute_components(rows, size, share, whole):
    sets = [shingle_set(t, size) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and whole * both >= share * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter(
        (d, len(sets[i]), d if not sets[i] else least.get(find(i)), (d if not sets[i] else least.get(find(i))) == d)
        for i, (d, _, _) in enumerate(rows)
    )


@pytest.mark.parametrize("rows,size,share", [(odd_rows(), 3, 85), (near_rows(1), 3, 85), (near_rows(2), 5, 80)])
def test_near_duplicates(spark, rows, size, share):
    found = near_dedup.near_duplicates(frame(spark, rows), words=size, share=share)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert collections.Counter(map(tuple, found.collect())) == brute_components(rows, size, share, 100)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Groups that exceed a block are compared block by block, with the same result."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    rnd = random.Random(5)
    base = [f"v{i}" for i in range(100)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(i % 5):
            w[rnd.randrange(100)] = f"x{rnd.randrange(1000)}"
        rows.append((i, " ".join(w), "s"))
    found = near_dedup.near_duplicates(frame(spark, rows), words=3, share=85)
    assert collections.Counter(map(tuple, found.collect())) == brute_components(rows, 3, 85, 100)


def test_near_duplicates_write_few_files(spark, monkeypatch, tmp_path):
    """Small intermediate tables are not spread over a file for every shuffle partition."""
    folders = (f"file://{tmp_path}/{i}" for i in range(1000))
    monkeypatch.setattr(runtime, "new_folder", lambda *_: next(folders))
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    rows = near_rows(6, 120)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = frame(spark, rows).coalesce(2)
        found = collections.Counter(map(tuple, near_dedup.near_duplicates(docs, words=3, share=85).collect()))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert found == brute_components(rows, 3, 85, 100)
    files = {p.name: len(list(p.glob("part-*"))) for p in tmp_path.iterdir()}
    assert len(files) > 5 and max(files.values()) <= 2 * spark.sparkContext.defaultParallelism


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(frame(spark, []), words=3, share=85).count() == 0


def test_estimates_are_close():
    rnd = np.random.default_rng(0)
    pool = rnd.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    a, b = np.unique(pool[:2400]), np.unique(pool[400:2800])
    true = 2000 / 2800
    found = near_dedup.registers([a, b], 256)
    near, used = near_dedup.estimate(found[0], found)
    assert near[0] == pytest.approx(1) and abs(near[1] - true) < 4 * np.sqrt(true * (1 - true) / used[1])


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in root if find(x) != x}


def test_spanning_compares_all_that_matters():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 30):
        linked = rnd.random((n, n)) < 0.06
        linked |= linked.T
        label = graph.spanning(n, lambda i: linked[i])
        reach = np.linalg.matrix_power((linked | np.eye(n, dtype=bool)).astype(float), n) > 0
        assert ((label[:, None] == label[None, :]) == reach).all()


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for d, t, _ in rows:
        groups[t or ""].append(d)
    out = collections.Counter()
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        for d in ids:
            out[(d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("capacity", [1, 5, 50_000])
def test_exact_duplicates(spark, capacity):
    rows = [*odd_rows(), *near_rows(3)]
    found = exact_dedup.exact_duplicates(frame(spark, rows), capacity=capacity)
    assert collections.Counter(map(tuple, found.collect())) == brute_exact(rows)
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


def test_exact_duplicates_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", 0)
    rows = odd_rows()
    found = exact_dedup.exact_duplicates(frame(spark, rows))
    assert collections.Counter(map(tuple, found.collect())) == brute_exact(rows)


def test_equal_keys_of_different_texts_are_chained(spark, monkeypatch):
    """With a hash that always collides only the bytes tell texts apart."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    rows = near_rows(4, 30)
    found = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    monkeypatch.undo()
    assert collections.Counter(map(tuple, found)) == brute_exact(rows)


def test_a_wrong_directory_gives_a_wrong_result(spark, monkeypatch):
    """Documents find their texts through the directory: without one of its cells some are lost, none is with a whole one."""
    rows = [(i, f"text {i % 150}", "s") for i in range(300)]
    whole = exact_dedup.directory
    count = lambda: exact_dedup.exact_duplicates(frame(spark, rows), capacity=10).count()
    assert count() == 300
    monkeypatch.setattr(exact_dedup, "directory", lambda keys, capacity: whole(keys, capacity).where("cell % 4 != 1"))
    assert 0 < count() < 300


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("key"))
    found = exact_dedup.directory(keys, 100)
    placed = keys.withColumn("cell", exact_dedup.cell(found.first().global_depth)).join(found, "cell")
    sizes = {r.bucket: r["count"] for r in placed.groupBy("bucket").count().collect()}
    assert sum(sizes.values()) == 4000 and max(sizes.values()) <= 100 and len(sizes) >= 40
    # a bucket's parent was too full
    parents = collections.Counter()
    for bucket, n in sizes.items():
        parents[bucket >> 1] += n
    assert all(parents[b >> 1] > 100 or (b ^ 1) not in sizes for b in sizes)


@pytest.mark.parametrize("count", [1, 3, 16])
def test_shards(spark, count, monkeypatch):
    monkeypatch.setattr(shards, "CELL", 7)
    rnd = random.Random(1)
    rows = [(100 + i, f"t{rnd.randrange(50)}é", rnd.choice(["a"] * 6 + ["b", "c", None])) for i in range(300)] + odd_rows()
    found = shards.stratified_shards(frame(spark, rows), count).collect()
    texts = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == texts
    slots = collections.defaultdict(list)
    for r in found:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    sizes = [len(s) for s in slots.values()]
    assert len(slots) == min(count, len(rows)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    source = {d: s for d, _, s in rows[:300]}
    per = collections.Counter((r.shard, source[r.doc_id]) for r in found if r.doc_id in source)
    for s in ("a", "b"):
        seen = [per[(k, s)] for k in slots]
        assert max(seen) - min(seen) <= 4
    again = shards.stratified_shards(frame(spark, rows[::-1]), count).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, found))


def test_shards_of_nothing(spark):
    assert shards.stratified_shards(frame(spark, [])).count() == 0


def test_positions(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") < 400, "x"))
    found = ranks.positions(df, F.floor(F.col("id") / 13), [F.col("id")], "at", ["g"]).collect()
    assert all(r["at"] == (r.id if r.id < 400 else r.id - 400) for r in found) and len(found) == 500
