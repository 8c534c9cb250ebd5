"""Items of split JSON documents against a whole-document parser."""

import contextlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelake.sources import documents as J
from pricelake.sources.documents import document_headers, document_items, document_pieces

KEY = "standard_charge_information"


def random_items(seed, n):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice('ab{}[]",:\\\n ') for _ in range(rng.randint(0, 8)))
    return [
        {
            "description": text(),
            "n": i,
            "code_information": [{"code": text(), "type": "RC"} for _ in range(rng.randint(0, 2))],
            "deep": {"a": {"b": [{"c": text()}]}},
        }
        for i in range(n)
    ]


def split(spark, path, in_object):
    items = document_items(document_pieces(spark, [path]), in_object)
    assert items.where("incomplete").count() == 0
    return [json.loads(r.item) for r in items.orderBy("source_block", "source_row").collect()]


@pytest.mark.parametrize("block, indent", [("100", None), ("2000", 2)])
def test_items(spark, tmp_path, block, indent):
    items = random_items(int(block), 30)
    key = KEY
    odd = {"name": 'x "} {', "affirmation": {"text": "}{", "ok": {"yes": True}}}
    documents = {
        "list": (items, False),
        "nested": ([items[:10], [], [items[10:15]], *items[15:]], False),
        "first": ({key: items, **odd, "modifier_information": random_items(9, 3)}, True),
        "last": ({**odd, "modifier_information": random_items(9, 3), key: items}, True),
    }
    with blocks_of(spark, block):
        for name, (document, in_object) in documents.items():
            place = tmp_path / name
            place.mkdir()
            (place / "x.json").write_text(json.dumps(document, indent=indent))
            assert split(spark, str(place), in_object) == items, name


@contextlib.contextmanager
def blocks_of(spark, size):
    """Files are read in blocks of ``size`` bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_escaped_quotes():
    place = lambda t: J.quotes_of(np.frombuffer(t, np.uint8)).tolist()
    assert place(rb'"\""') == [0, 3] and place(rb'"\\"x') == [0, 3] and place(b'""') == [0, 1] and place(b"") == []
    assert place(rb'\"') == [] and place(b'"') == [0]


@pytest.mark.parametrize("block", [3000, 10**7])
def test_header_fields_wherever_they_stand(spark, tmp_path, block):
    """The header in the middle, with 64 KB and more on both sides, in two parts, behind values that look like it."""
    items = random_items(1, 700)
    filler = [{"description": "x" * 900, "hospital_name": "no"} for _ in range(80)]
    document = {
        "modifier_information": filler,
        "hospital_name": 'Home } "Clinic" {',
        "version": 2.5,
        KEY: items,
        "affirmation": {"version": "9", "hospital_address": ["no"]},
        "hospital_address": ["1 Main St, Town, TX", "other {"],
        "last_updated_on": "2025-01-01",
        "more": filler,
    }
    for indent in (None, 1):
        path = tmp_path / f"{indent}.json"
        path.write_text(json.dumps(document, indent=indent))
    with blocks_of(spark, block):
        rows = document_headers(document_pieces(spark, [str(tmp_path)])).collect()
        assert len(rows) == 2
        for r in rows:
            h = r.header
            assert (h.hospital_name, h.version, h.last_updated_on) == ('Home } "Clinic" {', "2.5", "2025-01-01")
            assert list(h.hospital_address) == ["1 Main St, Town, TX", "other {"]
        assert split(spark, str(tmp_path / "1.json"), True) == items


@pytest.mark.parametrize("block", [300, 10**7])
def test_documents_that_break_off(spark, tmp_path, block):
    items = random_items(4, 12)
    whole = json.dumps({"hospital_name": "x", KEY: items})
    rng = random.Random(8)
    with blocks_of(spark, block):
        for cut in sorted(rng.sample(range(30, len(whole)), 6)):
            path = tmp_path / f"{cut}.json"
            path.write_text(whole[:cut])
            rows = document_items(document_pieces(spark, [str(path)]), True).orderBy("source_block", "source_row").collect()
            found = [json.loads(r.item) for r in rows if not r.incomplete]
            assert found == items[: len(found)] and sum(r.incomplete for r in rows) <= 1
            left = whole[:cut].count('"deep"')
            assert len(found) >= left - 1


def test_only_edges_of_blocks_travel(spark, tmp_path):
    items = random_items(5, 400)
    path = tmp_path / "x.json"
    path.write_text(json.dumps({KEY: items}))
    size = path.stat().st_size
    with blocks_of(spark, 4000):
        pieces = document_pieces(spark, [str(path)])
        states = J.block_states(pieces).collect()
        assert len(states) == -(-size // 4000)
        assert all(0 <= r.depth <= 6 for r in states) and sum(r.first for r in states) == sum(r.last for r in states) == 1
        assert split(spark, str(path), True) == items


def test_items_of_split_documents_are_not_written(spark, tmp_path, monkeypatch):
    items = random_items(6, 200)
    (tmp_path / "x.json").write_text(json.dumps({"hospital_name": "x", KEY: items}))
    tables = []

    def kept(df, *more):
        tables.append(J_written(df, *more))
        return tables[-1]

    J_written = J.written
    monkeypatch.setattr(J, "written", kept)
    with blocks_of(spark, 4000):
        assert split(spark, str(tmp_path), True) == items
    # one item at the edge of two blocks, where it does not end with the first
    blocks = tables[0].count()
    assert blocks > 3 and sum(t.where("item is not null").count() for t in tables if "item" in t.columns) <= blocks + 1
