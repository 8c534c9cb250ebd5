"""Values of the column functions, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from pricelake.functions import codes as C, names as N, prices as P

PRICES = {
    "$1,234.50": 1234.5,
    " 12 ": 12.0,
    "\t$ 7\n": 7.0,
    "1e3": 1000.0,
    ".5": 0.5,
    "5.": 5.0,
    "+5": 5.0,
    "N/A": None,
    "null": None,
    "None": None,
    "-": None,
    "": None,
    None: None,
    "0": None,
    "0.00": None,
    "-5": None,
    "(100)": None,
    "abc": None,
    "1d": None,
    "1f": None,
    "NaN": None,
    "Infinity": None,
    "1e999": None,
    "1_000": None,
    "1 000": None,
}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_clean_price(spark):
    df = spark.createDataFrame([(k,) for k in PRICES], "t string")
    got = {r.t: r.p for r in df.select("t", P.clean_price(F.col("t")).alias("p")).collect()}
    assert got == PRICES


def test_table_price(spark):
    df = spark.createDataFrame([(1.005,), (99999999.99,), (1e8,), (None,)], "x double")
    got = [
        (str(r.d) if r.d is not None else None, r.f)
        for r in df.select(
            P.to_table_price(F.col("x")).alias("d"), P.fits_table_price(F.col("x")).alias("f")
        ).collect()
    ]
    assert got[1:] == [("99999999.99", True), (None, False), (None, True)]


def test_price_range(spark):
    df = spark.createDataFrame([(1.0, 2.5), (None, 2.0), (1.0, None), (None, None)], "a double, b double")
    got = [r.x for r in df.select(P.money_range(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == ["$1.00 - $2.50", "N/A - $2.00", "$1.00 - N/A", "N/A - N/A"]


@pytest.mark.parametrize(
    "name, expected",
    [
        (" cpt ", "HCPCS"),
        ("hcpcs", "HCPCS"),
        ("Rev", "RC"),
        ("icd10", "ICD-10"),
        ("ICD10CM", "ICD-10-CM"),
        ("icd10pcs", "ICD-10-PCS"),
        ("ndc", "NDC"),
        ("", "unknown"),
        (None, "unknown"),
    ],
)
def test_code_type(spark, name, expected):
    assert one(spark, C.normalize_code_type(F.lit(name).cast("string"))) == expected


def test_codes_map(spark):
    pairs = [
        ("RC", "0450"),
        ("cpt", " 99281 "),
        ("CDM", "1"),
        ("HCPCS", "99281"),
        ("rev", "N/A"),
        (None, "5"),
        ("REV", "0451"),
        ("RC", None),
    ]
    df = spark.createDataFrame([(pairs,)], "p array<struct<type:string,code:string>>")
    codes = C.codes_map(C.standard_codes(F.col("p")))
    row = df.select(
        codes.alias("m"),
        C.codes_text(codes).alias("t"),
        C.first_code(codes, "RC").alias("rc"),
        C.first_code(codes, "ICD-10").alias("icd"),
        C.has_code(codes, "0451").alias("has"),
        C.has_code(codes, "1").alias("has_not"),
    ).first()
    assert row.m == {"RC": ["0450", "0451"], "HCPCS": ["99281", "99281"]}
    assert row.t == '{"HCPCS":["99281","99281"],"RC":["0450","0451"]}'
    assert (row.rc, row.icd, row["has"], row.has_not) == ("0450", None, True, False)


@pytest.mark.parametrize(
    "name, expected",
    [
        ("Baylor Scott  White Emergency Medical Center  Cedar Park", "bsw-er-med-ctr-cp"),
        ("St. David's - Round Rock", "st-davi-roun-rock"),
        ("Ascension Seton Hospital", "asc-hosp"),
        ("-- Park --", "cp"),
        ("", ""),
    ],
)
def test_facility_id(spark, name, expected):
    got = one(spark, N.facility_id(F.lit(name)))
    assert got == expected


def test_title_case_is_pythons(spark):
    texts = ["st. david's hospital", "1st place", "ÉCOLE d'été", "a-b c_d", "", "  x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(N.title_case(F.col("t"))).collect()]
    assert got == [t.title() for t in texts]


@pytest.mark.parametrize(
    "path, name, json_name",
    [
        ("/in/74_ST-MARY-CENTER_standardcharges.csv", "St Mary Center", "St Mary Center"),
        ("/in/74_A-B_C_standardcharges.json", "A B_C", "A B"),
        ("/in/some-hospital_file.v2.csv", "Some Hospital File.V2", "File.V2"),
        ("/in/plain.csv", "Plain", "Plain"),
    ],
)
def test_names_from_files(spark, path, name, json_name):
    assert one(spark, N.name_from_file(F.lit(path))) == name
    assert one(spark, N.name_from_json_file(F.lit(path))) == json_name


@pytest.mark.parametrize(
    "location, address, expected",
    [
        ("Cedar Park, TX", "900 East St, Cedar Park, TX 78613", ("Cedar Park", "TX")),
        (None, "900 East St, Cedar Park, TX 78613", ("Cedar Park", "TX")),
        (None, "Cedar Park, TX 78613", ("Cedar Park", "TX")),
        (None, "900 East St Austin TX 78613", ("Austin", "TX")),
        ("Austin", "nowhere", (None, None)),
        ("Austin, Texas", "1 St, Dallas, OK 73301", ("Austin", None)),
    ],
)
def test_places(spark, location, address, expected):
    place = N.city_state_of_location(F.lit(location).cast("string"), F.lit(address))
    assert tuple(one(spark, place)) == expected


def test_without_takes_apart_only_texts_that_have_the_letters(spark):
    texts = spark.createDataFrame(
        [(b"plain",), ("\ufeffhead".encode(),), ("a\ufffdb".encode(),), (b"a\xffb",), (b"",), (None,)], "b binary"
    ).select(F.col("b").cast("string").alias("t"))
    told = texts.select(N.without(F.col("t"), "\ufeff\ufffd").alias("x"), F.translate("t", "\ufeff\ufffd", "").alias("y"))
    rows = [tuple(r) for r in told.collect()]
    assert [x for x, _ in rows] == ["plain", "head", "ab", "ab", "", None]
    assert all(x == y for x, y in rows)


def test_prices_are_not_taken_apart_letter_by_letter(spark):
    price = spark.createDataFrame([("$1,2",)], "t string").select(P.clean_price(F.col("t")).alias("x"))
    assert price.first().x == 12.0
    assert "translate(" not in price._jdf.queryExecution().optimizedPlan().toString()
