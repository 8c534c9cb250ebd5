"""Hand-written files through the whole ingest plan."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pricelake.plans import ingest as I, report as R
from pricelake.sources import charges as X

META = (
    "hospital_name,last_updated_on,version,hospital_location,hospital_address\n"
    'Test Hospital,2025-07-23,2.0.0,"Cedar Park, TX","900 East St, Cedar Park, TX 78613"\n'
)
HEADER = (
    "description,code|1,code|1|type,code|2,code|2|type,setting,standard_charge|gross,"
    "standard_charge|discounted_cash,standard_charge|min,standard_charge|max\n"
)
OPTIONS = I.Options(ingested_at=datetime(2025, 1, 1))


# A header, data rows and the operations they give, per facility.
CSV_CASES = {
    "Everything Clinic": (
        HEADER
        # quotes, commas, a line break, padding, an alias of a type
        + '" MRI ""head"", big\nscan ",70551,CPT,0611,rev,Outpatient,"$2,000.00", 900 ,10,20\n'
        # the better price of the same group comes later; ranges are merged
        "X-Ray,71045,HCPCS,,,outpatient,100,50,5,9\n"
        "X-Ray,71045,cpt,N/A,RC,,110,60,7,30\n"
        # short and long rows, an empty description, a blank line
        ",0450,RC,,,,,77\n"
        "\n"
        "Long,99281,CPT,,,outpatient,1,2,3,4,surplus,more\n"
        # rejected: setting, code type, price
        "Stay,99221,CPT,,,inpatient,1,2,3,4\n"
        "Both,99222,CPT,,,both,1,2,3,4\n"
        "Local,1,CDM,,,outpatient,1,2,3,4\n"
        "Free,99283,CPT,,,outpatient,1,0,3,4\n"
        "B\ufffdad,99284,CPT,,,outpatient,1,2,,\n",
        [
            ("Bad", {"HCPCS": ["99284"]}, 2.0, 1.0, None, None),
            ("Long", {"HCPCS": ["99281"]}, 2.0, 1.0, 3.0, 4.0),
            ('MRI "head", big\nscan', {"HCPCS": ["70551"], "RC": ["0611"]}, 900.0, 2000.0, 10.0, 20.0),
            ("Unknown", {"RC": ["0450"]}, 77.0, None, None, None),
            ("X-Ray", {"HCPCS": ["71045"]}, 60.0, 110.0, 5.0, 30.0),
        ],
    ),
    "Equal Prices": (
        HEADER + "A,1,CPT,,,,7,5,,\nA,1,CPT,,,,8,5,,\nA,1,CPT,,,,9,5,,\n",
        [("A", {"HCPCS": ["1"]}, 5.0, 7.0, None, None)],
    ),
    "Same Name Twice": (
        "description,code,code_type,note,cash_price,description\nfirst,1,CPT,x,5,last\n",
        [("last", {"HCPCS": ["1"]}, 5.0, None, None, None)],
    ),
    "Typed Codes": (
        "setting,procedure,cpt_code,rev_code,drg_code,self_pay\n,P,99213,0510,470,12\n",
        [("P", {"HCPCS": ["99213"], "RC": ["0510"]}, 12.0, None, None, None)],
    ),
    "Many Codes": (
        "description,code|1,code|1|type,code|2,code|2|type,code|10,code|10|type,cash_price\n"
        "P,a,RC,b,RC,c,RC,12\n",
        [("P", {"RC": ["a", "c", "b"]}, 12.0, None, None, None)],
    ),
    **{
        f"Wide Layout {i}": (
            ",".join(["description", *[f"extra {i} {j}" for j in range(i)], "setting,code,type,cash"])
            + "\n"
            + ",".join([f"D{i}", *[""] * i, f",1,CPT,{i}"])
            + "\n",
            [(f"D{i}", {"HCPCS": ["1"]}, float(i), None, None, None)],
        )
        for i in (1, 5, 9)
    },
}


def item(description, codes, **charge):
    return {
        "description": description,
        "code_information": [{"code": c, "type": t} for t, c in codes],
        "standard_charges": [charge] if charge else [],
    }


ITEMS = [
    item("A", [("CPT", 123), ("rc", "0450")], setting="outpatient", discounted_cash=5, gross_charge="$6"),
    item("B", [("REV", "0451")], setting="INPATIENT", discounted_cash=5),
    item("C", [("ICD10", "Z00")], setting=" ", discounted_cash="$1,000", gross_charge=0, minimum=1.5),
    item("D", [("CPT", "1")]),
    item(None, [("CPT", "2"), ("NDC", "3")], discounted_cash=7, gross_charge=None),
]
ITEMS[0]["standard_charges"].append({"setting": "inpatient", "discounted_cash": 99})
EXPECTED = [
    ("A", {"HCPCS": ["123"], "RC": ["0450"]}, 5.0, 6.0, None, None),
    ("C", {"ICD-10": ["Z00"]}, 1000.0, None, 1.5, None),
    ("Unknown", {"HCPCS": ["2"]}, 7.0, None, None, None),
]


def wrapped(name, items=ITEMS, indent=None, last=False, **more):
    header = {
        "hospital_name": f'{name} "Q"',
        "hospital_address": ["1 Main St, Austin, TX 73301", "elsewhere"],
        "version": "2.0.0",
        "last_updated_on": "2025-01-02",
        **more,
    }
    body = {"standard_charge_information": items}
    return json.dumps({**body, **header} if last else {**header, **body}, indent=indent)


LINES = "\n".join(map(json.dumps, ITEMS))
WRAPPED = {
    "one": wrapped("one"),
    "nice": wrapped("nice", indent=2),
    "last": wrapped("last", indent=2, last=True),
    "nest": wrapped("nest", [ITEMS[:2], *ITEMS[2:]]),
    "long": wrapped("long", padding="x" * 70000),
    "far": wrapped("far", [*ITEMS, item("pad", [("CDM", "x" * 70000)])], last=True),
}
BARE = {
    "root.json": json.dumps(ITEMS),
    "wide.json": json.dumps(ITEMS, indent=1),
    "deep.json": json.dumps([ITEMS[:3], ITEMS[3:]]),
    "rows.json": LINES,
    "nd.ndjson": LINES,
    "jl.jsonl": LINES + "\n",
}
UNLOADABLE = {
    "no-metadata.csv": HEADER + "A,1,CPT,,,,7,5,,\n",
    "notes.txt": "nothing to see\nhere\n",
    "bad-state.csv": META.replace(", TX", ", Texas") + HEADER + "A,1,CPT,,,,7,5,,\n",
}


def rows(operations):
    got = operations.orderBy("description", "cash_price").collect()
    return [
        (r.description, r.codes, r.cash_price, r.gross_charge, r.negotiated_min, r.negotiated_max)
        for r in got
    ]


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    path = tmp_path_factory.mktemp("price files")
    for name, (body, _) in CSV_CASES.items():
        data = (META.replace("Test Hospital", name) + body).encode()
        if name == "Everything Clinic":
            data = b"\xef\xbb\xbf" + data.replace("\ufffd".encode(), b"\xff")
        (path / f"{name}.csv").write_bytes(data)
    for name, text in [
        *((f"{n} [x].json", t) for n, t in WRAPPED.items()),
        *BARE.items(),
        *UNLOADABLE.items(),
    ]:
        (path / name).write_text(text)
    (path / "sub").mkdir()
    (path / "sub" / "deeper.csv").write_text(META + HEADER)
    return str(path)


@pytest.fixture(scope="module")
def result(spark, place):
    fields = "path string, facility_name string, city string, state string, address string"
    metadata = spark.createDataFrame(
        [(f"{place}/{n}", f"Given {n.replace('.', ' ')}", "Austin", "TX", "1 Main St") for n in BARE],
        fields,
    )
    done = I.ingest_directory(spark, place, metadata=metadata, options=OPTIONS)
    done.operations.cache()
    return done


@pytest.fixture(scope="module")
def ids(result):
    found = result.catalog.select("path", "facility_id").collect()
    return {r.path.rsplit("/", 1)[1]: r.facility_id for r in found}


def of_file(result, ids, name):
    return rows(result.operations.where(F.col("facility_id") == ids[name]))


def test_files_found(result, ids):
    assert set(ids) == {
        *(f"{n}.csv" for n in CSV_CASES),
        *(f"{n} [x].json" for n in WRAPPED),
        *BARE,
        *UNLOADABLE,
    }
    assert len(set(ids.values())) == len(ids)


@pytest.mark.parametrize("name", CSV_CASES)
def test_csv(result, ids, name):
    assert of_file(result, ids, f"{name}.csv") == CSV_CASES[name][1]


@pytest.mark.parametrize("name", WRAPPED)
def test_wrapped_json(result, ids, name):
    assert of_file(result, ids, f"{name} [x].json") == EXPECTED
    hospital = result.hospitals.where(F.col("facility_id") == ids[f"{name} [x].json"]).first()
    assert (hospital.facility_name, hospital.city, hospital.state) == (f'{name} "Q"', "Austin", "TX")
    assert (hospital.file_version, hospital.last_updated) == ("2.0.0", "2025-01-02")


@pytest.mark.parametrize("name", BARE)
def test_items_with_explicit_metadata(result, ids, name):
    assert of_file(result, ids, name) == EXPECTED
    assert ids[name].startswith("give-")


def test_hospital_of_csv(result, ids):
    found = result.hospitals.where(F.col("facility_id") == ids["Everything Clinic.csv"]).first()
    assert (found.facility_name, found.city, found.state) == ("Everything Clinic", "Cedar Park", "TX")
    assert (found.file_version, found.last_updated) == ("2.0.0", "2025-07-23")
    assert found.ingested_at == datetime(2025, 1, 1)


def test_report(result, ids):
    report = {r.path.rsplit("/", 1)[1]: r for r in result.report.collect()}
    r = report["Everything Clinic.csv"]
    assert (r.read_records, r.accepted_records, r.failed_records) == (10, 6, 4)
    assert (r.successful_records, r.duplicate_records) == (5, 1)
    assert (r.not_outpatient, r.no_standard_code, r.missing_cash_price) == (2, 1, 1)
    assert {n: (report[n].status, report[n].missing[:4]) for n in UNLOADABLE} == {
        "no-metadata.csv": ("missing_metadata", ["city", "state", "address"]),
        "notes.txt": ("unsupported_format", ["city", "state", "address"]),
        "bad-state.csv": ("missing_metadata", ["state"]),
    }
    assert {report[f"{n} [x].json"].read_records for n in WRAPPED if n != "far"} == {5}
    total = R.totals(result.report).first()
    assert total.files == len(ids)
    assert total.total_records == sum(r.total_records for r in report.values())


def test_all_csv_layouts_share_one_scan(result):
    plan = X.raw_charges(result.catalog.where("format = 'csv'"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1


def test_options(spark, tmp_path):
    body = "Stay,99221,CPT,,,inpatient,9,,3,4\nX,99222,CPT,,,,9,5,,\nX,99222,CPT,,,,9,5,,\n"
    (tmp_path / "a.csv").write_text(META + HEADER + body)
    options = I.Options(outpatient_only=False, require_cash_price=False, dedup=False)
    done = I.ingest_file(spark, str(tmp_path / "a.csv"), options)
    assert rows(done.operations) == [
        ("Stay", {"HCPCS": ["99221"]}, 0.0, 9.0, 3.0, 4.0),
        ("X", {"HCPCS": ["99222"]}, 5.0, 9.0, None, None),
        ("X", {"HCPCS": ["99222"]}, 5.0, 9.0, None, None),
    ]


def test_nothing_to_ingest(spark, place):
    done = I.ingest_directory(spark, place, "*.xml")
    assert (done.report.count(), done.operations.count(), done.hospitals.count()) == (0, 0, 0)


def test_files_with_line_breaks_in_cells_are_parsed_once(spark, tmp_path, monkeypatch):
    body = "".join(f'"line {i}\nbroken",{i},CPT,,,,9,5,,\n' for i in range(20))
    (tmp_path / "a.csv").write_text(META + HEADER + body)
    (tmp_path / "b.csv").write_text(META.replace("Test Hospital", "Other Clinic") + HEADER + "X,1,CPT,,,,9,5,,\n")
    parsed = []

    def counted(df, purpose, *more):
        table = I_written(df, purpose, *more)
        parsed.append(table.count() if purpose == "lines" else 0)
        return table

    I_written = I.written
    monkeypatch.setattr(I, "written", counted)
    done = I.ingest_directory(spark, str(tmp_path), options=OPTIONS)
    assert done.operations.count() == 21
    # beside the records there are three rows of either file down to the header
    assert sum(parsed) == 21 + 6


def test_a_repeated_header_that_opens_a_quote(spark, tmp_path):
    """Its last cell is open at the end of its line: the header itself is left alone, the same line further down is not."""
    lines = spark.createDataFrame(
        [("f", 0, i, v) for i, v in enumerate(["a,\"b", "1,2", "a,\"b", "3\",4"])] + [("g", 0, 9, "a,\"b")],
        "file string, source_block long, source_row long, value string",
    ).withColumns({"top_texts": F.array(F.lit('a,"b')), X.MAYBE_TOP: F.col("value") == 'a,"b'})
    catalog = spark.createDataFrame([(n, n, "ok", "csv", 2) for n in "fg"], "file string, path string, status string, format string, width int")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(X, "_marked_lines", lambda csv: lines.join(csv.select("file"), "file", "left_semi"))
        assert [r.file for r in X.quoted_files(catalog).collect()] == ["f"]


def test_runs_over_some_files_each_are_one_run(spark, tmp_path):
    """Files that share an id or a facility with one of another run count as in one run."""
    row = "X,{},CPT,,,,9,{},,\n".format
    for name, hospital, body in [
        ("a", "Northside Hospital", row(1, 5)),
        ("b", "Test Hospital", row(1, 5) + row(2, 5)),
        ("c", "Northern Hospital", row(1, 5)),
        ("d", "Test Hospital", row(1, 7) + "Stay,1,CPT,,,inpatient,9,5,,\n"),
    ]:
        (tmp_path / f"{name}.csv").write_text(META.replace("Test Hospital", hospital) + HEADER + body)
    one = I.ingest_directory(spark, str(tmp_path), options=OPTIONS)
    two = I.merged(I.ingest_directory(spark, str(tmp_path), f"[{p}]*", options=OPTIONS) for p in ("ab", "cd"))
    status = lambda done: sorted(tuple(r) for r in done.report.drop("processing_seconds").collect())
    assert [r.status for r in two.report.orderBy("path").collect()] == ["id_collision", "ok", "id_collision", "ok"]
    assert status(one) == status(two)
    assert rows(two.operations) == rows(one.operations) == [
        ("X", {"HCPCS": ["2"]}, 5.0, 9.0, None, None),
        ("X", {"HCPCS": ["1"]}, 7.0, 9.0, None, None),
    ]
    assert two.hospitals.collect() == one.hospitals.collect()
