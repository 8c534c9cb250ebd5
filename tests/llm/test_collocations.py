"""Phrase collocations: against counts of all phrases, for small groups and filters too."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pricelake.llm import collocations as C

DOCS = "doc_id long, text string, lang string, phrase string, n int, size int, h long, score string, k int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", 1, 2, 3, "y", 4) for i, (t, g) in enumerate(rows)], DOCS)


def plain_collocations(rows, least, share, best):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    frequent = {p: n for p, n in counts.items() if n >= least}
    found = {}
    for (lang, p), a in frequent.items():
        if len(p) < 2:
            continue
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(g == lang and len(q) > len(p) and inside(q) and 100 * n >= share * a for (g, q), n in frequent.items()):
            continue
        cuts = []
        for k in range(1, len(p)):
            l, r = frequent[lang, p[:k]], frequent[lang, p[k:]]
            cuts.append((1000 * a * totals[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    out = []
    for lang, all_ in found.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(all_)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def check(spark, rows, least=3, share=100, best=2000):
    df = C.collocations(frame(spark, rows), least=least, share=share, best=best)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(map(tuple, df.collect()))
    assert got == plain_collocations(rows, least, share, best if best is not None else 10**9)
    return got


def mixed(seed, n=120):
    rnd = random.Random(seed)
    words = ["the", "of", "New", "YORK", "city", "a", "b", "é", "x\x01", "x", "日本", "don't", "(of"]
    common = "in new york city the end of"
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randrange(8)):
            parts.append(common if rnd.random() < 0.3 else " ".join(rnd.choices(words, k=rnd.randrange(1, 7))))
        rows.append((rnd.choice([" ", "  ", "\t", ". ", "\n", ", "]).join(parts), rnd.choice(["en", "en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations(spark, seed):
    assert check(spark, mixed(seed))


def test_best_and_share(spark):
    rows = mixed(3)
    assert len(check(spark, rows, best=3)) <= 12
    check(spark, rows, share=80, best=None)


def test_long_prefixes_and_full_filters(spark, monkeypatch):
    rows = mixed(4)
    docs = frame(spark, rows).selectExpr("coalesce(lang, 'und') as lang", "text").where("text is not null")
    one = np.uint64((1 << 64) - 1)
    every = C.Filter(16, [(i, int(one)) for i in range(1 << 10)])
    words = C.word_counts(docs)
    pairs = C.pair_counts(docs, spark.sparkContext.broadcast(every))
    heavy = lambda df, n: np.array([r.h for r in df.where(f"n > {n}").collect()], np.int64).view(np.uint64)
    plain = {}
    for sent in [
        (every, every, heavy(words, 10**9), heavy(pairs, 10**9)),
        (every, every, heavy(words, 5), heavy(pairs, 10**9)),
        (every, every, heavy(words, 5), heavy(pairs, 5)),
    ]:
        found = C.phrase_counts(C.suffixes(docs, spark.sparkContext.broadcast(sent)), 7, 2)
        got = {(r.lang, r.phrase): (r.size, r.n) for r in found.collect()}
        plain = plain or got
        assert got == plain
    counts = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.replace("New", "new").replace("YORK", "york")):
            w = re.findall(r"[^\x20\x09]+", piece)
            counts.update((lang or "und", " ".join(w[i : i + k])) for k in range(2, 6) for i in range(len(w) - k + 1))
    assert plain == {(g, p): (p.count(" ") + 1, n) for (g, p), n in counts.items() if n >= 2}


def test_subtree_over_parts_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "ROWS", 3)
    import pyarrow as pa

    rows = sorted([("en", "a b "), ("en", "a b c "), ("en", "a b c d "), ("en", "a b\x01 c "), ("en", "a c "), ("fr", "a b ")])
    total = Counter()
    for i in range(0, 6, 2):
        part = rows[i : i + 2]
        table = pa.table({"lang": [r[0] for r in part], "suffix": [r[1] for r in part], "prefix": pa.array([1, 1], pa.int32()), "n": [1, 2]})
        for row in C._subtree(table, 10).to_pylist():
            total[row["lang"], row["phrase"]] += row["n"]
    assert total["en", "a b"] == sum([1, 2, 1, 2][i] for i, r in enumerate(rows[:4]) if r[1].startswith("a b "))


def test_odd_rows(spark):
    long = "so it goes " * 30_000
    rows = [(None, "en"), ("", "en"), (" \t\n.,;", None), (long, "zz"), ("one two", None), ("one two", None), ("one two", "und"), ("word", "en")]
    got = check(spark, rows, least=3)
    assert ("und", 1, "one two", 3, 3, 3, 6, 2000) in got
    assert check(spark, []) == []


def test_numbers_beyond_64_bits(spark):
    spark_div = spark.sql(
        "select (cast(1000 as decimal(4,0)) * cast(9000000000000 as decimal(19,0))) as above, cast(9000000000000000 as decimal(16,0)) as total, "
        "cast(9000000000000 as decimal(19,0)) * cast(9999999999999 as decimal(19,0)) as under"
    ).selectExpr("cast(cast(above as decimal(22,0)) * total as decimal(38,0)) div under as q")
    assert spark_div.first().q == 1000 * 9000000000000 * 9000000000000000 // (9000000000000 * 9999999999999)
