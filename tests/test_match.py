"""Header variants and their mapping, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from pricelake.operators import match as M

HEADERS = {
    "pipe": [
        "description", "code|1", "code|1|type", "code|2", "code|2|type", "code|10", "code|10|type",
        "setting", "standard_charge|gross", "standard_charge|discounted_cash",
        "standard_charge|min", "standard_charge|max",
    ],
    "underscore": ["Service Description", "code_1", "code_1_type", "Gross Charge", "Cash Price"],
    "billing": ["procedure", "billing_code_1", "billing_code_type_1", "billing_code", "billing_code_type"],
    "typed": ["item_description", "cpt_code", "rev_code", "ndc_code_2", "self_pay"],
    "simple": ["code_type", "code", "description", "Description"],
    "fuzzy": ["charge_gross", "standard_charge_discounted_cash_price", "negotiated_min_rate", "minimum_price"],
    "none": ["a", "b"],
}


@pytest.fixture(scope="module")
def mapping(spark):
    headers = spark.createDataFrame(list(HEADERS.items()), "file string, columns array<string>")
    return {r.file: r for r in M.column_mapping(headers).collect()}


def positions(row):
    return {f: row[f"{f}_pos"] for f in M.FIELDS if row[f"{f}_pos"] is not None}


def code_columns(row):
    return [tuple(c) for c in row.code_columns or []]


def test_fields(mapping):
    assert positions(mapping["pipe"]) == {
        "description": 0, "setting": 7, "gross_charge": 8, "cash_price": 9,
        "negotiated_min": 10, "negotiated_max": 11,
    }
    assert positions(mapping["underscore"]) == {"description": 0, "gross_charge": 3, "cash_price": 4}
    assert positions(mapping["billing"]) == {"description": 0}
    assert positions(mapping["typed"]) == {"description": 0, "cash_price": 4}
    assert positions(mapping["simple"]) == {"description": 3}
    assert positions(mapping["fuzzy"]) == {"gross_charge": 0, "cash_price": 1}
    assert positions(mapping["none"]) == {}


def test_code_columns(mapping):
    assert code_columns(mapping["pipe"]) == [("1", 1, 2, None), ("10", 5, 6, None), ("2", 3, 4, None)]
    assert code_columns(mapping["billing"]) == [(None, 3, 4, None), ("_1", 1, 2, None)]
    assert code_columns(mapping["typed"]) == [
        ("cpt", 1, None, "CPT"), ("ndc_2", 3, None, "NDC"), ("rev", 2, None, "REV"),
    ]
    assert code_columns(mapping["simple"]) == [("0", 1, 0, None)]
    assert code_columns(mapping["none"]) == []


@pytest.mark.parametrize(
    "pattern, column, score",
    [
        ("gross_charge", "charge_gross", 100),
        ("standard_charge_discounted_cash", "standard_charge_discounted_cash_price", 85),
        ("standard_charge_gross", "standard_charge_|_gross", 82),
        ("negotiated_min", "negotiated_min_rate", 76),
        ("minimum", "minimum_price", 64),
    ],
)
def test_similarity(spark, pattern, column, score):
    words = lambda t: F.array_distinct(F.split(F.lit(t), "_"))
    assert spark.range(1).select(M.similarity(words(pattern), words(column))).first()[0] == score


def test_missing_fields(spark):
    headers = spark.createDataFrame(list(HEADERS.items()), "file string, columns array<string>")
    flags = {r.file: r for r in M.mapping_flags(M.column_mapping(headers)).collect()}
    assert flags["pipe"].missing_fields == []
    assert flags["billing"].missing_fields == ["pricing information"]
    assert flags["fuzzy"].missing_fields == ["description", "code columns"]
    assert flags["none"].missing_fields == ["description", "code columns", "pricing information"]
    assert flags["underscore"].has_price and not flags["underscore"].negotiated_min
