"""Merkle manifest: against a tree built plainly, its layout, broken proofs, odd rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelake.llm import manifest as M

DOCS = "doc_id long, source string, lang string, n_chars int, text string, id string, run int, place long, block string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([sha(*row[i : i + 2]) for i in range(0, len(row), 2)])
    return levels


def plain_steps(levels, i):
    steps = []
    for row in levels[:-1]:
        other = i ^ 1
        steps.append(("", None) if other >= len(row) else ("L" if other < i else "R", row[other]))
        i >>= 1
    return steps


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    runs = {}
    for doc, source, lang, n, text in rows:
        leaf = sha(*map(told, (doc, source, lang, n, text)))
        changed = doc is not None and doc % 3 == 0
        other = sha(*map(told, (doc, source, lang, None if n is None else n + 1, text))) if changed else leaf
        runs.setdefault(lang, []).append((doc is not None, doc or 0, leaf, doc, other))
    names = sorted(runs, key=lambda n: (n is not None, (n or "").encode()))
    trees = {}
    for name in names:
        runs[name].sort()
        trees[name] = plain_levels([r[2] for r in runs[name]])
    top = plain_levels([trees[n][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for i, (_, _, leaf, doc, other) in enumerate(runs[name]):
            steps = plain_steps(trees[name], i) + plain_steps(top, k)
            folded = other
            for side, h in steps:
                folded = sha(folded) if h is None else sha(h, folded) if side == "L" else sha(folded, h)
            proof = sha(*[h for _, h in steps if h is not None])
            out.append((doc, leaf, trees[name][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOCS)
    df = M.manifest(docs, changed=F.col("doc_id") % 3 == 0, changes={"n_chars": F.col("n_chars") + 1})
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, df.collect()), key=str)


def test_addresses_are_a_van_emde_boas_order():
    assert [a.tolist() for a in M.addresses(0)] == [[0]]
    # four levels: two on top (0-2), then four trees of two levels
    assert [a.tolist() for a in M.addresses(3)] == [[4, 5, 7, 8, 10, 11, 13, 14], [3, 6, 9, 12], [1, 2], [0]]
    for height in range(11):
        assert sorted(np.concatenate(M.addresses(height)).tolist()) == list(range(2 ** (height + 1) - 1))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 31])
def test_block_gives_the_plain_tree(n):
    leaves = [sha(str(i)) for i in range(n)]
    levels = plain_levels(leaves)
    block = M.build([h.encode() for h in leaves], False)
    height = M.block_height(n, False)
    for level, row in enumerate(levels):
        assert [M.node(block, height, level, i).hex() for i in range(len(row))] == row
    for i in range(n):
        assert M.fold(leaves[i].encode(), M.siblings(block, n, False, i)).decode() == levels[-1][0]


@pytest.mark.parametrize("height", [1, 2, 3])
def test_layers_of_blocks_give_the_plain_tree(monkeypatch, height):
    monkeypatch.setattr(M, "HEIGHT", height)
    for n in (1, 2, 5, 8, 9, 30):
        row = [sha(str(i)) for i in range(n)]
        root = plain_levels(row)[-1][0]
        while len(row) > 1:
            size, parts = 2**height, range(0, len(row), 2**height)
            blocks = [[h.encode() for h in row[i : i + size]] for i in parts]
            heights = [M.block_height(len(b), len(blocks) > 1) for b in blocks]
            row = [M.node(M.build(b, len(blocks) > 1), h, h, 0).hex() for b, h in zip(blocks, heights)]
        assert row == [root]


def test_manifest(spark):
    rnd = random.Random(5)
    rows = [(i, f"s{i % 3}", "en" if i % 5 else rnd.choice(["de", None, "fr", "", "é"]), i, f"text {i}") for i in range(2500)]
    rnd.shuffle(rows)
    assert found(spark, rows) == plain_manifest(rows)


def test_manifest_of_odd_rows(spark):
    long = "word " * 300_000
    rows = [
        (1, None, None, None, None),
        (2, "a", None, 3, ""),
        (2, "a", None, 3, ""),
        (2, "b", None, 3, ""),
        (3, "a", "en", None, long),
        (None, "a", "en", 1, "no id"),
        (None, None, None, None, None),
        (6, "a", "", 1, "empty run"),
        (9, "é", "日本", 1, "日本語"),
        (-9, "é", "日本", 2**31 - 2, "-"),
        (12, "1:a", "zz", 1, "alone"),
    ]
    assert found(spark, rows) == plain_manifest(rows)


def test_manifest_of_one_and_of_no_rows(spark):
    assert found(spark, []) == []
    (row,) = found(spark, [(1, "s", "en", 4, "text")])
    assert row[1] == row[2] == row[3] == row[5] and row[6] and row[4] == sha("")


def test_any_partitioning_gives_one_manifest(spark):
    rows = [(i, "s", "en" if i % 7 else "de", i, f"text {i}", "x", 1, 2, "y") for i in range(1500)]
    docs = spark.createDataFrame(rows, DOCS)
    one, many = (sorted(map(tuple, M.manifest(docs.repartition(n)).collect()), key=str) for n in (1, 20))
    assert one == many and all(r[-1] for r in one)
