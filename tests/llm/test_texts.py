"""Packing, decontamination, language-model scores, quality, lists, quotes, pages."""

import collections
import datetime
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pricelake.llm import arrays, decontaminate, packing, ppm, quality, queries, quotes, url_filter, wrappers
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

DOCS = "doc_id long, text string, id string, row long, key int, class int, item string, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "y", 4) for i, t in rows], DOCS)


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "no id"), (5, "x" * 5000), (6, "It's  a test,\n\n  isn't it?  "),
    (7, "日本語 テキスト   emoji 😀 ok"), (8, "<|endoftext|> mid"), (9, "Ünḯcödé \u0085 next\r\nline"), (10, "the cat " * 3000), (11, "a\x00b"),
]


# packing

def packed(spark, rows):
    return queries.packed(frame(spark, rows))


def test_pieces_are_the_tokenizers_ids_and_sequences_are_whole(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(0)
    rows = ODD + [(100 + i, " ".join(rnd.choice(["alpha", "Beta,", "gamma.\nDelta", "1234", "x"]) for _ in range(rnd.randrange(900)))) for i in range(80)]
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows += [(200 + i, t) for i, t in enumerate(["a  <|endoftext|>  b<|endoftext|><|endoftext|>c", "<|endoftext|>", "x\n\n<|endoftext|>\n y", "<|endoftext|", "été<|endoftext|> 日本"])]
    found = packed(spark, rows).collect()
    got = collections.defaultdict(list)
    for r in found:
        got[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        times = sum(1 for e, _ in rows if e == d)
        pieces, at = sorted(set(got[d])), 0
        assert len(got[d]) == times * len(pieces)
        for start, length, crc, total in pieces:
            assert (start, total, crc) == (at, len(ids), zlib.crc32(ids[at : at + length].tobytes()))
            at += length
        assert at == len(ids)
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_packing_nothing(spark):
    assert packed(spark, []).count() == 0


def test_cuts_fill_bins():
    for n, parts in enumerate(packing.cuts(1024)):
        assert sum(parts) == n
        assert all(1024 - (1024 // p) * p <= packing.SLACK * 1024 + 1024 // p for p in parts)


# decontamination

def edit_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        last, row[0] = row[0], i + 1
        for j, b in enumerate(text):
            last, row[j + 1] = row[j + 1], min(last + (a != b), row[j] + 1, row[j + 1] + 1)
    return min(row)


def test_best_match_is_the_edit_distance():
    rnd = random.Random(2)
    for _ in range(200):
        item = [rnd.randrange(5) for _ in range(rnd.randrange(1, 80))]
        text = [rnd.randrange(5) for _ in range(rnd.randrange(0, 120))]
        assert decontaminate.best_match(item, text)[0] == edit_distance(item, text)


def test_leaks_against_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, words(rnd.choice([3, 8, 14, 30, 60]))) for i in range(30)]
    rows, edited = [], 0
    for d in range(300):
        w = words(rnd.randrange(0, 120))
        if d % 3:
            own = list(rnd.choice(items)[1])
            for _ in range(rnd.randrange(0, max(1, len(own) // 4))):
                edited += 1
                k = rnd.randrange(len(own))
                own[k : k + 1] = rnd.choice([[], [rnd.choice(vocabulary)], [own[k], rnd.choice(vocabulary)]])
                own = own or ["w0"]
            w[len(w) // 2 : len(w) // 2] = own
        rows.append((d, " ".join(w)))
    benchmark = spark.createDataFrame([(i, " ".join(w).upper() + ".", 0) for i, w in items] + [(99, None, 0), (98, "", 0)], "item_id long, text string, id int")
    found = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(frame(spark, rows), benchmark).collect()}
    want = {}
    for d, t in rows:
        for i, w in items:
            distance = edit_distance(w, t.split())
            if distance <= decontaminate.edits_allowed(len(w)):
                want[(d, i)] = distance
    assert set(found) <= set(want) and all(found[k] == want[k] for k in found)
    assert len(found) >= 0.98 * len(want) and len(want) > 100 and edited > 100


def test_leaks_in_odd_rows(spark):
    benchmark = spark.createDataFrame([(1, "the cat the cat the cat the cat"), (2, "no id")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, ODD), benchmark).collect()}
    assert found == {(10, 1), (None, 2)}
    assert decontaminate.leaks(frame(spark, ODD), benchmark.where("false")).count() == 0
    assert decontaminate.leaks(frame(spark, []), benchmark).count() == 0


def test_leaks_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 1)
    benchmark = spark.createDataFrame([(i, f"one two three four five six seven eight nine {i}") for i in range(5)], "item_id long, text string")
    rows = [(i, f"start one two three four five six seven eight nine {i} stop") for i in range(5)]
    found = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.leaks(frame(spark, rows), benchmark).collect()}
    assert found == {(i, j, int(i != j)) for i in range(5) for j in range(5)}


# language model

@pytest.mark.parametrize("words", [6, 10, 15, 25, 40, 60, 100, 150, 200, 300, 400])
def test_recall_at_the_limit_of_edits(words):
    """Changes, deletions, insertions and all of them apart, spread evenly and at random, by the exact matcher."""
    rnd = random.Random(words)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = lambda n: rnd.choices(vocabulary, [1 / (i + 1) for i in range(400)], k=n)
    edits = decontaminate.edits_allowed(words)

    def edited(found, kind, even):
        found = list(found)
        for at in reversed([int((j + 0.5) * words / edits) for j in range(edits)] if even else sorted(rnd.sample(range(words), edits))):
            do, new = rnd.choice("cdi") if kind == "all" else kind, f"n{rnd.randrange(10**9)}"
            found[at : at + (do != "i")] = [] if do == "d" else [new]
        return found

    count = 40 if words <= 100 else 20
    items = [passage(words) for _ in range(count)]
    search = decontaminate.Items(list(range(count)), [" ".join(w) for w in items], decontaminate.EDITS)
    for kind in ("c", "d", "i", "all"):
        for even in (True, False):
            texts = [" ".join(passage(40) + edited(w, kind, even) + passage(40)) for w in items]
            found = arrays.words(*arrays.text_bytes(decontaminate.lowered(pa.array(texts))), arrays.LETTERS)
            hits = {h[:2] for h in search.search(found)}
            text = lambda j: found.hashes[found.of[j] : found.of[j + 1]].tolist()
            there = [j for j in range(count) if decontaminate.best_match(search.words[j].tolist(), text(j))[0] <= edits]
            assert len(there) >= 0.9 * count
            assert sum((j, j) in hits for j in there) >= 0.95 * len(there), (kind, even)


def test_items_of_ten_thousand_words_in_bounded_memory():
    import tracemalloc

    rnd = random.Random(2)
    words = [f"w{rnd.randrange(3000)}" for _ in range(10_000)]
    changed = [w if rnd.random() > 0.15 else "x" for w in words]
    tracemalloc.start()
    search = decontaminate.Items([1], [" ".join(words)], decontaminate.EDITS)
    texts = pa.array(["a b c " * 5 + " ".join(changed) + " d" * 9, "w1 w2 " * 5000])
    found = search.search(arrays.words(*arrays.text_bytes(decontaminate.lowered(texts)), arrays.LETTERS))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [h[:2] for h in found] == [(0, 0)] and found[0][2] <= 2000 and most < 200e6


def test_common_runs_are_not_expanded():
    """A run in every item and thousands of places names no items by itself."""
    rnd = random.Random(4)
    items = [f"the end of {' '.join(f'a{rnd.randrange(10**6)}' for _ in range(30))}" for _ in range(500)]
    search = decontaminate.Items(list(range(500)), items, decontaminate.EDITS)
    text = " ".join(f"the end of b{i} c{i}" for i in range(20_000)) + " " + items[7]
    found = arrays.words(*arrays.text_bytes(decontaminate.lowered(pa.array([text]))), arrays.LETTERS)
    assert len(search.candidates(found)[0]) < 2_000 and [h[:3] for h in search.search(found)] == [(0, 7, 0)]


def test_probabilities_sum_to_one():
    rnd = np.random.default_rng(0)
    texts = pa.array([" ".join(rnd.choice(["ab", "abc", "b", "ca", "cab"], 20)) for _ in range(50)])
    _, (stream, starts, size) = ppm._read(texts)
    run = ppm.runs(stream, starts, size)
    rows = []
    for k in range(ppm.ORDER + 1):
        keys, n = np.unique(run & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
        context = collections.Counter()
        for key, c in zip(keys.tolist(), n.tolist()):
            context[key >> 8] += c
        rows += [(k, key, c) for key, c in zip(keys.tolist(), n.tolist()) if context[key >> 8] >= 5]
    rows = np.array(rows, np.uint64)
    model = ppm.Model(rows[:, 0].astype(int), rows[:, 1], rows[:, 2].astype(np.int64))
    for context in [*np.unique(run >> np.uint64(8))[:60].tolist(), 0x7A7A7A7A7A, 0x7A61626361]:
        every = np.uint64(context << 8) + np.arange(256, dtype=np.uint64)
        assert np.exp(model.log_probability(every)).sum() == pytest.approx(1)
        assert np.allclose(model.scores(every), model.log_probability(every))


def test_canonical_text():
    data, offsets = arrays.text_bytes(pa.array(["  A bc\n\td ", None, "", "x"]))
    data = arrays.LOWER[data]
    stream, starts, size = ppm.canonical(data, arrays.words(data, offsets), offsets)
    assert [bytes(stream[s : s + n]) for s, n in zip(starts, size)] == [b"a bc d\n", b"\n", b"\n", b"x\n"]
    assert all(bytes(stream[s - ppm.ORDER : s]) == b"\n" * ppm.ORDER for s in starts)


def test_base_scores(spark):
    rows = ODD + [(50 + i, f"the quick fox number {i} jumps The fox") for i in range(60)]
    found = ppm.score(frame(spark, rows)).collect()
    words = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    counts = collections.Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for d, t in rows:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t))
        want[(d, held(d), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(base, 6))] += 1
    assert collections.Counter((*tuple(r)[:5], round(r.base_score, 6)) for r in found) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    better = [(r.score, r.base_score) for r in found if r.doc_id and r.doc_id >= 50]
    assert sum(s for s, _ in better) > sum(b for _, b in better)


@pytest.mark.parametrize("hot", [None, 50])
def test_scores_use_every_context(spark, monkeypatch, hot):
    """Contexts seen once count in a corpus of any size, and it makes no difference which scores are sent to all tasks."""
    if hot:
        monkeypatch.setattr(ppm, "HOT", hot, raising=False)
    rows = [(3, "the cat sat " * 200_000)] + [(i, f"zebra{i} quiz {i * i} jolly vixen été") for i in range(4, 80)]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    read = lambda texts: ppm.runs(*ppm._read(pa.array(texts))[1])
    run, pairs = read([t for d, t in rows if not held(d)]), []
    assert len(run) * ppm.SHARE > 1.5
    for k in range(ppm.ORDER + 1):
        keys, n = np.unique(run & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
        pairs.append((np.full(len(keys), k), keys, n))
    model = ppm.Model(*map(np.concatenate, zip(*pairs)))
    found = ppm.score(frame(spark, rows)).collect()
    texts = dict(rows)
    assert len(found) == len(rows) and any(r.held_out for r in found)
    for r in found:
        assert r.score == pytest.approx(model.log_probability(read([texts[r.doc_id]])).sum() / math.log(10), rel=1e-7)


def test_scores_without_training_or_rows(spark):
    assert ppm.score(frame(spark, [])).count() == 0
    lone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = ppm.score(frame(spark, [(lone, "ab")])).first()
    assert row.score == pytest.approx(-3 * math.log10(256)) and row.n_known == 0 and row.train_tokens == 0


# quality

def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, None, 0), (10, 0, 0), (77, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = quality.classify(frame(spark, ODD), labels).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in found)
    assert {r.score for r in quality.classify(frame(spark, ODD), labels.where("false")).collect()} == {0.5}
    assert quality.classify(frame(spark, []), labels).count() == 0


@data
def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else FOLDER
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in found) / len(found)
    assert len(found) > 20 and right >= 0.97
    assert all(r.predicted == 1 for r in found if r.quality == 1)


def test_scores_are_the_softmax_of_averaged_vectors():
    rows = [(np.array([1, 2, 3]), np.array([1, 2, 1]), 1), (np.array([3, 4]), np.array([5, 1]), 0)] * 5
    weights, bias = quality.train(rows)
    odds = [float((weights[b] * n).sum() / n.sum() + bias) for b, n, _ in rows[:2]]
    assert odds[0] > 0 > odds[1]


# URL lists

def test_lists_are_judged_as_of_the_fetch(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    entries = spark.createDataFrame(
        [("bad.example", "block", day(10), 1), ("bad.example", "remove", day(20), 1), ("good.bad.example", "allow", day(12), 1),
         ("bad.example", "block", day(30), 1), ("same.example", "block", day(5), 1), ("same.example", "allow", day(5), 1),
         (None, "block", day(1), 1), ("x.example", None, day(1), 1), ("y.example", "block", None, 1)],
        "pattern string, action string, changed_at date, host int",
    )
    rows = [
        (1, "http://bad.example/a", day(9)), (2, "http://bad.example/a", day(10)), (3, "https://www.BAD.example:80/", day(19)),
        (4, "http://bad.example/", day(20)), (5, "http://sub.bad.example/", day(40)), (6, "http://good.bad.example/", day(15)),
        (7, "http://good.bad.example", day(11)), (8, "http://notbad.example/", day(15)), (9, "http://same.example/", day(6)),
        (10, None, day(15)), (11, "nonsense", day(15)), (12, "http://bad.example/", None), (2, "http://bad.example/a", day(10)),
        (13, "http://user@bad.example./?q", day(31)), (14, "http://x.example/", day(9)), (15, "http://y.example/", day(9)),
    ]
    captures = spark.createDataFrame([(*r, "c", True) for r in rows], "id int, url string, fetched_at date, host string, kept boolean")
    found = url_filter.judge(captures, entries)
    assert found.columns == ["id", "url", "fetched_at", "host", "matched_pattern", "listed_since", "action", "kept"]
    got = sorted((r.id, r.action, r.listed_since) for r in found.collect())
    b, d = "bad.example", day
    want = {2: ("block", d(10)), 3: ("block", d(10)), 5: ("block", d(30)), 6: ("allow", d(12)), 7: ("block", d(10)), 9: ("allow", d(5)), 13: ("block", d(30))}
    assert got == sorted((i, *want.get(i, ("none", None))) for i, _, _ in rows)
    assert all(r.kept == (r.action != "block") for r in found.collect())
    assert {r.action for r in url_filter.judge(captures, entries.where("false")).collect()} == {"none"}
    assert url_filter.judge(captures.where("false"), entries).count() == 0


# quotes

def test_nested_quotes_are_parsed():
    text = "> > deep\n> near\n>near two\nown line\n\n>> again\nlast"
    own, passages = quotes.parse(text)
    assert own == "own line\n\nlast" and passages == [(2, " deep"), (1, " near\nnear two"), (2, " again")]
    assert quotes.parse(None) == ("", []) and quotes.parse("a > b")[1] == []


def test_conversations_in_reply_order(spark, monkeypatch):
    monkeypatch.setattr(quotes, "SPAN", 2)
    rows = [
        (1, 0, "a", "How does it work?\nTell me."), (1, 1, "b", "Other topic entirely"),
        (1, 2, "c", "> how  does it WORK?\n> tell me.\n\nLike this."), (1, 3, "d", ">> How does it work?\n>> Tell me.\n> Like this.\nThanks"),
        (1, 4, "e", "> other topic\n> entirely\nYes"), (1, 5, "f", "> nobody said that\nHm"), (1, 6, "g", "plain"),
        (2, 0, None, None), (2, 5, "b", ""), (None, 1, "x", "loose"), (3, None, "x", "> so\nloose"), (4, 1, "r", "b"), (4, 1, "r", "a"),
        (4, 1, "r", "a"), (4, 2, "q", "> b\nto b"),
        (5, 0, "a", "later words"), (5, 1, "b", "> future\nnow"), (5, 2, "c", "future"),
    ]
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], "conv_id long, turn long, role string, text string, n int, hash string")
    every = quotes.reply_order(df).collect()
    assert len(every) == len(rows)
    # messages of one turn follow each other, those without a conversation or a turn stand alone
    same = sorted((r.position, r.parent_turn, r.root_turn, r.text) for r in every if (r.conv_id, r.turn) == (4, 1))
    assert [p[:3] for p in same] == [(0, None, 1), (1, 1, 1), (2, 1, 1)] and sorted(p[3] for p in same) == ["a", "a", "b"]
    loose = {(r.conv_id, r.position, r.parent_turn, r.root_turn, r.quotes, r.text) for r in every if r.conv_id is None or r.turn is None}
    assert loose == {(None, 0, None, 1, 0, "loose"), (3, 0, None, None, 1, "loose")}
    (reply,) = [r for r in every if (r.conv_id, r.turn) == (4, 2)]
    assert (reply.position, reply.parent_turn, reply.text) == (3, 1, "to b")
    found = {(r.conv_id, r.turn): r for r in every if r.conv_id in (1, 2, 5) and r.turn is not None}
    parents = {k: r.parent_turn for k, r in found.items()}
    assert parents == {(1, 0): None, (1, 1): 0, (1, 2): 0, (1, 3): 2, (1, 4): 1, (1, 5): None, (1, 6): 5, (2, 0): None, (2, 5): 0,
                       (5, 0): None, (5, 1): None, (5, 2): 1}
    assert [found[(1, t)].position for t in range(7)] == list(range(7)) and found[(1, 6)].root_turn == 5
    assert found[(1, 2)].text == "Like this." and found[(1, 3)].text == "Thanks" and found[(2, 0)].text == ""
    for c in (1, 2, 5):
        own = sorted((r.position, r.turn, r.parent_turn) for k, r in found.items() if k[0] == c)
        assert [p for p, _, _ in own] == list(range(len(own)))
        place = {t: p for p, t, _ in own}
        assert all(p is None or place[p] < at for at, _, p in own)
    assert quotes.reply_order(df.where("false")).count() == 0


def test_repeated_lines_do_not_move_a_quote(spark):
    """The whole passage comes before its lines, and most of the lines before the latest of them."""
    rows = [
        (1, 0, "Hi\nplease send it\nThanks"), (1, 1, "Sure\nThanks"), (1, 2, "> Hi\n> please send it\n> Thanks\n\nDone"),
        (1, 3, "> Thanks\n> please send it\nAgain"), (1, 4, ">> Sure\n>> Thanks\n> Done\n> unknown\nOk"),
        (2, 0, "A\nB\nC"), (2, 1, "A"), (2, 2, "C\nx"), (2, 3, "> C\n> B\n> A\ny"),
    ]
    df = spark.createDataFrame([(c, n, "r", t) for c, n, t in rows], "conv_id long, turn long, role string, text string")
    found = {(r.conv_id, r.turn): r.parent_turn for r in quotes.reply_order(df).collect()}
    assert [found[(1, n)] for n in range(5)] == [None, 0, 0, 0, 2] and found[(2, 3)] == 0


# pages

def test_main_text_of_a_host(spark):
    def page(title, paragraphs, extra=""):
        return (
            f"<html><head><title>{title}</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li>Home<li>News</ul></nav>"
            f"<div class='cookie-notice'>We use cookies</div><article class=post><header><h1>{title}</h1></header>"
            + "".join(f"<p>{p}</p>" for p in paragraphs)
            + f"{extra}</article><aside>Side</aside><section id=comments><p>Nice!</p></section><form>Mail <input></form><footer>&copy; x</footer></body></html>"
        )

    rows = [
        (1, "http://h.example/1", page("One", ["a &amp; b<br>c", "d  <b>e"])),
        (2, "http://h.example/2", page("Two", ["x"], "<div class='ad'>Buy</div><ul><li>i<li>j</ul><script>var s='<p>no</p>';</script>")),
        (3, "http://h.example/3", page("Three", [])[:-60]),
        (4, "http://h.example/4", None), (5, "http://h.example/5", ""), (6, None, "<p>alone &lt;tag&gt; &eacute;&#233;"), (6, None, "<p>alone &lt;tag&gt; &eacute;&#233;"),
    ]
    df = spark.createDataFrame([(*r, "q", "w") for r in rows], "page_id long, url string, html string, host string, wrapper string")
    found = wrappers.main_text(df).collect()
    want = {1: "One\n\na & b c\n\nd e", 2: "Two\n\nx\n\ni\n\nj", 3: "Three", 4: "", 5: "", 6: "alone <tag> éé"}
    assert len(found) == len(rows)
    assert all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in found)
    assert wrappers.main_text(df.where("false")).count() == 0


def test_template_without_article(spark):
    """Without an article element, what never changes is the template and the part with most free text is main."""
    rows = [
        (i, f"http://t.example/{i}", f"<body><div class=top>Welcome to our site, dear reader of it</div><div class=c>"
         f"<p>Story {i} {'word ' * (20 + i)}</p>" + (f"<p>more {i}</p>" if i % 2 else "") + "<p>All rights reserved</p></div></body>")
        for i in range(12)
    ]
    found = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert found[i].startswith(f"Story {i} word") and "Welcome" not in found[i] and ("more" in found[i]) == bool(i % 2)


def main_texts(spark, pages):
    rows = [(i, "http://m.example/", p) for i, p in enumerate(pages)]
    found = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(found, key=lambda r: r.page_id)]


def test_host_of_mixed_templates(spark):
    """A page without an article keeps its text where others of its host have one, and a card beside the text is not all of it."""
    card = "<div class=content><p>" + "long text " * 30 + "</p></div><article><p>Read on</p></article>"
    found = main_texts(spark, [
        "<body><article><p>first</p></article><div>beside</div></body>", "<body><div class=content><p>second</p></div></body>",
        "<body><main><p>third</p></main></body>", card])
    assert found[:3] == ["first", "second", "third"] and found[3].startswith("long text long")


def test_copies_of_a_page_and_texts_beside_the_body(spark):
    """Copies of a page and equal neighbours in it make no template, and a title beside the body stays."""
    page = "<body><h1>Title</h1><div>" + "<p>again</p>" * 6 + "<p>" + "body " * 40 + "</p></div></body>"
    found = main_texts(spark, [page] * 7)
    assert found == ["Title\n\n" + "again\n\n" * 6 + ("body " * 40).strip()] * 7


def test_names_of_layouts_hide_nothing(spark):
    """Names of the page, of layouts and of containers of an article hide no text; numbered names of parts around it do."""
    text, rest = "<p>main text of the page</p>", "<div class='sidebar-1'>side</div><div id=ad-300>buy</div><div class=related-posts>more</div>"
    found = main_texts(spark, [
        f"<body class='single has-sidebar comments-open no-sidebar'><article>{text}</article>{rest}</body>",
        f"<body class='form-page sidebar'><div class='content with-sidebar'>{text}</div>{rest}</body>",
        f"<body><div class='form-page'>{text}</div>{rest}</body>",
        f"<body><div class='sidebar social'><article class='post category-social'>{text}</article></div>{rest}</body>",
        f"<body><div class=content>{text}</div><div class=related><article><p>more</p></article></div>{rest}</body>",
        f"<body><article>{text}</article><section id=comments><article class=comment><p>Nice</p></article></section>{rest}</body>",
    ])
    assert found == ["main text of the page"] * 6


def test_wrappers_are_aligned():
    label = lambda node: (node.label, node.many, node.maybe, [label(c) for c in node.children])
    one = wrappers.wrapper_of(wrappers.parse("<ul><li>a<li>b</ul><p>x</p>"))
    two = wrappers.wrapper_of(wrappers.parse("<h2>t</h2><ul><li>c</ul><p>y</p><hr>"))
    slot = ("#", False, False, [])
    assert label(wrappers.merged(one, two)) == ("", False, False, [
        ("h2", False, True, [slot]), ("ul", False, False, [("li", True, False, [slot])]), ("p", False, False, [slot]), ("hr", False, True, [])])
    again = wrappers.unpacked(one.shape(), one.stats())
    assert label(again) == label(one)


def test_common_is_a_longest_common_subsequence():
    rnd = random.Random(6)
    for _ in range(300):
        a, b = ([rnd.choice("abcde"[: rnd.randrange(1, 6)]) for _ in range(rnd.randrange(14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        found = wrappers.common(a, b)
        assert len(found) == table[-1][-1] and all(a[i] == b[j] for i, j in found)
        assert all(x < y and i < j for (x, i), (y, j) in zip(found, found[1:]))


def test_deep_and_wide_pages(spark):
    """Thousands of open elements, and of alternating ones side by side, on two pages that differ."""
    import time

    deep = lambda t: "<div>" * 5000 + f"<p>{t}</p>"
    wide = lambda n, t: "<body>" + "".join(f"<h2>{t}{i}</h2><p>p{i}</p>" + ("<hr>" if i % n == 0 else "") for i in range(10_000))
    start = time.perf_counter()
    found = main_texts(spark, [deep("one"), deep("two"), "<form>" * 3000 + "in forms", "</x>" * 100_000 + "ends"])
    assert found == ["one", "two", "in forms", "ends"]
    found = main_texts(spark, [wide(7, "a"), wide(11, "b")])
    assert [len(t.split("\n\n")) for t in found] == [20_000, 20_000] and found[1].startswith("b0\n\np0\n\nb1")
    assert time.perf_counter() - start < 120


def test_marks_and_quotes_hide_no_text(spark):
    found = main_texts(spark, [
        "<article><p title=Bob's>Hello it's fine</p><p>second</p></article>",
        '<article><p class="a"b" >y</p></article>',
        "<body><form id=aspnet><div class=content><p>the whole page in a form</p></div><input></form></body>",
        "<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><noscript>plain</noscript><object><p>inside</p></object></article>",
        "<article><div class='share-price'>12.50</div><section class='social-policy'>policy</section><div class='share-buttons'>tweet</div></article>",
        "<article><p data-x='a > b' title=\"c > d\">kept</p><p title=>also</p></article>",
    ])
    assert found == ["Hello it's fine\n\nsecond", "y", "the whole page in a form", "so x=2 holds\n\nplain\n\ninside", "12.50\n\npolicy", "kept\n\nalso"]


def neutral_pages(n):
    """Pages of a host whose parts have neutral names: a menu and a notice that never change around a text that does."""
    return [
        f"<body><div class=a><ul><li>Home<li>News<li>About</ul></div><div class=b>We care about your privacy</div><div class=c><div class=d>"
        f"<h1>Story {i}</h1><p>text of it {i} {'word ' * (i % 5)}</p><p>Our usual closing line</p></div></div><div class=e>All rights are ours</div></body>"
        for i in range(n)
    ]


def test_host_with_neutral_names(spark):
    found = main_texts(spark, neutral_pages(14))
    for i, text in enumerate(found):
        assert text == f"Story {i}\n\ntext of it {i} {'word ' * (i % 5)}".strip() + "\n\nOur usual closing line"
    # two pages tell nothing of a template
    assert all("Home" in t for t in main_texts(spark, neutral_pages(2)))


def test_any_partitioning_gives_one_wrapper(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(120):
        blocks = "".join(rnd.choice(["<p>x</p>", f"<p>t{i}</p>", "<h2>h</h2>", "<ul><li>1<li>2</ul>", "<div class=q>q</div>"]) for _ in range(rnd.randrange(9)))
        rows.append((i, f"http://h{i % 3}.example/", f"<body><div class=top>Same</div><div>{blocks}</div></body>" if i % 2 else f"<article>{blocks}</article>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = lambda n: df.repartition(n).selectExpr("regexp_extract(url, '//([^/]*)', 1) as host", "html")
    one, many = (sorted(map(tuple, wrappers.infer(plain(n)).collect())) for n in (1, 20))
    assert one == many and len(one) == 6
    assert sorted(map(tuple, wrappers.main_text(df.repartition(1)).collect())) == sorted(map(tuple, wrappers.main_text(df.repartition(20)).collect()))
