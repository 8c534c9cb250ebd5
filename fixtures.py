"""Price data derived from the test tables, in Spark and as SQL text.

The two derivations give the same rows: each text is written once, with the
names that differ between the engines filled in.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pricelake.functions import names as N
from pricelake.runtime import delete_folder, new_folder, written

SPARK = {"STR": "string", "G1": "$1", "G2": "$2", "LIST": "array", "SLICE": "slice"}
DUCKDB = {
    "STR": "varchar",
    "G1": r"\1",
    "G2": r"\2",
    "LIST": "list_value",
    "SLICE": "list_slice",
}

FACILITIES = """
select s_suppkey,
  concat('Baylor S', cast(s_suppkey as {STR}), ' Medical Center') as facility_name,
  concat(cast(s_suppkey as {STR}), ' Main St, City', cast(s_nationkey as {STR}), ', ',
    case n_regionkey when 0 then 'TX' when 1 then 'CA' when 2 then 'NY' when 3 then 'FL'
      else 'WA' end, ' 78701') as address
from supplier join nation on s_nationkey = n_nationkey
"""

RAW_CHARGES = """
select l_orderkey, l_linenumber, l_suppkey as s_suppkey, p_name as description,
  cast(l_linenumber as bigint) * 1000000000
    + cast(cast(l_extendedprice as decimal(12,2)) * 100 as bigint) as line_position,
  cast(p_size as {STR}) as code_1,
  case p_partkey % 6 when 0 then 'CPT' when 1 then 'hcpcs' when 2 then 'RC' when 3 then 'REV'
    when 4 then 'ICD10' else 'CDM' end as code_1_type,
  case when l_linenumber % 2 = 0 then concat('0', cast(450 + p_size as {STR}))
    else 'N/A' end as code_2,
  'RC' as code_2_type,
  case l_returnflag when 'N' then 'Outpatient' when 'R' then 'inpatient' else '' end as setting,
  concat('$', regexp_replace(cast(cast(l_extendedprice as decimal(12,2)) as {STR}),
    '^([0-9]+)([0-9]{{3}}[.])', '{G1},{G2}')) as gross,
  case when l_linenumber = 7 then 'N/A' when l_linenumber = 6 then '-5.00'
    else concat(' ', cast(cast(l_extendedprice as decimal(12,2))
      - cast(l_quantity as decimal(12,2)) as {STR}), ' ') end as cash,
  case when l_linenumber = 3 then ''
    else cast(cast(l_linenumber * 100 as decimal(12,2)) as {STR}) end as neg_min,
  cast(cast(l_quantity as decimal(12,2)) * 100 as {STR}) as neg_max
from lineitem join part on l_partkey = p_partkey
"""

QUERY_CACHE = """
select vec_id as id, concat('q', cast(vec_id as {STR})) as user_query,
  cast(cast(80 + vec_id % 20 as decimal(5,2)) / 100 as decimal(3,2)) as confidence_score,
  embedding as query_embedding
from embeddings
"""

PRICES = ("cash_price", "gross_charge", "negotiated_min", "negotiated_max")

# Header rows: a layout per supplier and customer, each with a column of its own.
HEADERS = """
select concat('s', cast(s_suppkey as {STR})) as file,
  case s_suppkey % 3
    when 0 then {LIST}('description', 'code|1', 'code|1|type', 'code|10', 'code|10|type', 'code|2',
      'setting', 'standard_charge|gross', 'standard_charge|discounted_cash',
      'standard_charge|min', 'standard_charge|max', concat(lower(s_name), ' rate'))
    when 1 then {LIST}('Service Description', 'code_1', 'code_1_type', 'code_2', 'code_2_type',
      concat(s_name, ' Setting'), 'Patient Setting', 'Gross Charge', 'Cash Price',
      'negotiated_min_rate', 'negotiated_max')
    else {LIST}('procedure_description', 'billing_code_1', 'billing_code_type_1', 'billing_code',
      'billing_code_type', 'charge_gross', 'standard_charge_discounted_cash_price',
      'minimum_price', 'max', concat('max_', lower(s_name))) end as columns
from supplier
union all
select concat('c', cast(c_custkey as {STR})) as file,
  case c_custkey % 4
    when 0 then {LIST}('Description', 'cpt_code', 'rev_code', 'ndc_code_2', 'icd10_code',
      concat(c_name, ' note'), 'self_pay', 'list_price', 'description')
    when 1 then {LIST}('code', 'type', 'standard_charge_|_gross', concat('fee_', lower(c_name)),
      'place_of_service', 'item_description')
    when 2 then {LIST}('code_information', 'code_type', 'cash', 'gross_price_total',
      'facility_service_setting', concat('service ', c_mktsegment))
    else {LIST}('account', 'name', c_mktsegment) end as columns
from customer
"""

NAMES = """
select concat('Baylor S', cast(s_suppkey as {STR}), ' Medical Center') as name from supplier
union all select c_name as name from customer
union all select concat(c_name, ' - Seton Health ', c_mktsegment) as name from customer
union all select concat(p_name, ' Regional  Hospital') as name from part
union all select concat('St. ', p_brand, chr(39), 's ', p_type) as name from part
"""

FILE_PATHS = """
select concat('/in/', cast(c_custkey as {STR}), '_', replace(lower(c_name), '#', '-'), '-',
  lower(c_mktsegment), '_standardcharges.csv') as path from customer
union all
select concat('/in/', replace(lower(s_name), '#', '_'), '.JSON') as path from supplier
union all
select concat('/in/', replace(p_name, ' ', '-'), '-', cast(p_partkey as {STR}), '.ndjson') as path
  from part
"""

ADDRESSES = """
select c_custkey as id,
  case c_custkey % 5 when 0 then concat('City', cast(c_nationkey as {STR}), ', TX')
    when 1 then 'Austin' when 2 then concat('City', cast(c_nationkey as {STR}), ', Texas') end
    as location,
  case c_custkey % 4
    when 0 then concat(cast(c_custkey as {STR}), ' Main St, City', cast(c_nationkey as {STR}),
      ', CA 90001')
    when 1 then concat('Town', cast(c_nationkey as {STR}), ', NY 10001')
    when 2 then concat('5 Side Road Place', cast(c_nationkey as {STR}), ' FL 33101')
    else c_name end as address
from customer
"""

HOSPITAL_TEXTS = (
    "facility_id",
    "facility_name",
    "city",
    "state",
    "address",
    "source_url",
    "file_version",
    "last_updated",
)
HOSPITAL_CANDIDATES = """
select c_custkey as id,
  case when c_custkey % 5 = 0 then c_name else concat('c-', cast(c_custkey as {STR})) end
    as facility_id,
  case when c_custkey % 13 = 0 then repeat(c_name, 40) else c_name end as facility_name,
  case when c_custkey % 11 = 0 then cast(null as {STR}) else c_mktsegment end as city,
  case when c_custkey % 3 = 0 then 'tx' when c_custkey % 7 = 0 then 'TEX' else 'TX' end as state,
  concat(c_name, ' street') as address, 'customer' as source_url,
  case when c_custkey % 2 = 0 then '2.0.0' when c_custkey % 17 = 0 then repeat('9.', 30) end
    as file_version,
  '2025-01-01' as last_updated
from customer
"""

OPERATION_CANDIDATES = """
select o_orderkey as id,
  case when o_orderkey % 8 = 0 then o_orderpriority else concat('f-', cast(o_custkey as {STR})) end
    as facility_id,
  case when o_orderkey % 17 <> 0 then '{{"RC":["0450"]}}' end as codes_key,
  case when o_orderkey % 19 <> 0 then o_orderstatus end as description,
  case when o_orderkey % 5 = 0 then -o_totalprice when o_orderkey % 7 = 0 then o_totalprice * 100000
    else o_totalprice end as cash_price,
  case when o_orderkey % 3 <> 0 then o_totalprice * 2 end as gross_charge,
  case when o_orderkey % 4 <> 0 then o_totalprice / 2 end as negotiated_min,
  case when o_orderkey % 6 <> 0 then cast(o_custkey as double) end as negotiated_max,
  case when o_orderkey % 9 = 0 then 'usd' when o_orderkey % 10 = 0 then 'USDX' else 'USD' end
    as currency
from orders
"""

CACHE_CANDIDATES = """
select vec_id as id,
  case when vec_id % 10 <> 0 then concat('q', cast(vec_id as {STR})) end as user_query,
  cast(cast(50 + vec_id % 70 as decimal(5,2)) / 100 as decimal(5,2)) as confidence_score,
  case when vec_id % 6 = 0 then {SLICE}(embedding, 1, 32) else embedding end as query_embedding
from embeddings
"""

# Texts of the tables as file heads.
HEADS = """
select concat('d', cast(doc_id as {STR})) as id, '.txt' as extension, text as head from documents
union all
select concat('p', cast(page_id as {STR})) as id, '.html' as extension, html as head from pages
union all
select concat('e', cast(event_id as {STR})) as id,
  case event_id % 3 when 0 then '.json' when 1 then '.jsonl' else '' end as extension,
  case event_id % 2 when 0 then concat(props, chr(10), ' ', props) else props end as head
from events
union all
select concat('o', cast(o_orderkey as {STR})) as id,
  case o_orderkey % 3 when 0 then '.csv' else '' end as extension,
  concat(cast(o_orderkey as {STR}), ',', cast(o_custkey as {STR}), ',', o_orderstatus, ',',
    o_orderpriority, ',x', chr(10), 'a,b,c,d,', cast(o_custkey as {STR}),
    case when o_orderkey % 2 = 0 then concat(chr(10), '1,2') else '' end) as head
from orders
"""

TABLE_TEXTS = """
select doc_id, text from documents
union all
select -1 - s_suppkey as doc_id, concat('hospital_name,version', chr(10), s_name, ',2.0', chr(10),
  'Description ,nothing,anything,place,Care Setting', chr(10), 'x,1,2,3,outpatient') as text
from supplier
"""

FILE_HEADERS_EXPECTED = """
select kind, s_suppkey as id, facility_name as hospital_name, '2025-01-01' as last_updated_on,
  case when s_suppkey % 5 = 0 then cast(null as {STR}) else '2.0.0' end as version,
  case when kind = 'csv' then 'Somewhere, TX' end as hospital_location, address as hospital_address
from (""" + FACILITIES + """), (select 'csv' as kind union all select 'json' as kind)
"""

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# A table smaller than one split per core is spread over the cores.
SPLIT_BYTES = 128 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


_written: dict[tuple[str, str, str], DataFrame] = {}


def derived(spark: SparkSession, folder: str, name: str, build) -> DataFrame:
    """Derived relation as a table of text lines, written once per application.

    The test tables come as single row groups; the written table has a file
    per core at least, as landed price data would.
    """
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _written:
        _written[key] = written(build(spark, folder), name)
    return _written[key]


def _run(spark: SparkSession, folder: str, sql: str, *names: str) -> DataFrame:
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
    return spark.sql(sql.format(**SPARK))


def run(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Relation of one of the texts above."""
    words = sql.replace(",", " ").replace(")", " ").split()
    return _run(spark, folder, sql, *[t for t in TABLES if t in words])


def facilities(spark: SparkSession, folder: str) -> DataFrame:
    return _run(spark, folder, FACILITIES, "supplier", "nation")


def charges(spark: SparkSession, folder: str) -> DataFrame:
    """Charge lines with the column names of a price file."""
    return derived(spark, folder, "charges", _charges)


def _charges(spark: SparkSession, folder: str) -> DataFrame:
    used = (
        "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_returnflag"
    ).split()
    lines = table(spark, folder, "lineitem").select(*used)
    cores = spark.sparkContext.defaultParallelism
    if estimated_bytes(lines) < cores * SPLIT_BYTES:
        lines = lines.repartition(cores)
    lines.createOrReplaceTempView("lineitem")
    table(spark, folder, "part").createOrReplaceTempView("part")
    return spark.sql(RAW_CHARGES.format(**SPARK))


def raw_charges(spark: SparkSession, folder: str) -> DataFrame:
    """The same lines in the common raw shape."""
    return derived(spark, folder, "raw_charges", _raw_charges)


def _raw_charges(spark: SparkSession, folder: str) -> DataFrame:
    """Charge lines with the facility they belong to."""
    name = F.concat(F.lit("Baylor S"), F.col("s_suppkey").cast("string"), F.lit(" Medical Center"))
    named = table(spark, folder, "supplier").select(
        "s_suppkey", N.facility_id(name).alias("facility_id")
    )
    return charges(spark, folder).join(named, "s_suppkey").select(
        "facility_id",
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".csv")).alias("source_file"),
        F.col("l_orderkey").alias("source_block"),
        F.col("line_position").alias("source_row"),
        "description",
        "setting",
        F.col("cash").alias("cash_price"),
        F.col("gross").alias("gross_charge"),
        F.col("neg_min").alias("negotiated_min"),
        F.col("neg_max").alias("negotiated_max"),
        F.array(
            F.struct(F.col("code_1_type").alias("type"), F.col("code_1").alias("code")),
            F.struct(F.col("code_2_type").alias("type"), F.col("code_2").alias("code")),
        ).alias("code_pairs"),
    )


def hospitals(spark: SparkSession, folder: str) -> DataFrame:
    """Hospital rows of the derived facilities; ``ingested_at`` differs by supplier."""
    place = N.city_state_of_address(F.col("address"))
    ingested = F.timestamp_seconds(F.lit(1735689600) + F.col("s_suppkey") * 60)
    return (
        facilities(spark, folder)
        .withColumn("place", place)
        .select(
            N.facility_id(F.col("facility_name")).alias("facility_id"),
            "facility_name",
            "place.city",
            "place.state",
            "address",
            F.concat(F.lit("supplier/"), F.col("s_suppkey")).alias("source_url"),
            F.lit("2.0.0").alias("file_version"),
            F.lit("2025-01-01").alias("last_updated"),
            ingested.alias("ingested_at"),
        )
    )


def header_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(s_suppkey, rows): heads of CSV files, with keys in different order and spelling."""
    cells = lambda *values: F.array(*[F.lit(v) if isinstance(v, str) else v for v in values])
    version = F.when(F.col("s_suppkey") % 5 == 0, "").otherwise("2.0.0")
    plain = F.array(
        cells("hospital_name", "last_updated_on", "version", "hospital_location", "hospital_address"),
        cells(F.col("facility_name"), "2025-01-01", version, "Somewhere, TX", F.col("address")),
        cells("description", "code|1", "setting"),
    )
    mixed = F.array(
        cells(
            " Version",
            "note",
            "HOSPITAL_ADDRESS ",
            "Hospital_Location",
            "last_updated_on",
            "hospital_name",
        ),
        cells(version, "", F.col("address"), "Somewhere, TX", "2025-01-01 ", F.col("facility_name")),
        cells("description", "code|1", "setting"),
    )
    return facilities(spark, folder).select(
        "s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, plain).otherwise(mixed).alias("rows")
    )


def json_heads(spark: SparkSession, folder: str) -> DataFrame:
    """(s_suppkey, head): JSON documents cut off inside their items."""
    header = F.to_json(
        F.struct(
            F.col("facility_name").alias("hospital_name"),
            F.lit("2025-01-01").alias("last_updated_on"),
            F.when(F.col("s_suppkey") % 5 != 0, "2.0.0").alias("version"),
            F.array("address", F.lit("elsewhere")).alias("hospital_address"),
        )
    )
    open_header = F.regexp_replace(header, r"\}$", "")
    return facilities(spark, folder).select(
        "s_suppkey",
        F.concat(
            open_header, F.lit(',\n "standard_charge_information": [ {"description": "cut')
        ).alias("head"),
    )


def query_cache(spark: SparkSession, folder: str) -> DataFrame:
    return _run(spark, folder, QUERY_CACHE, "embeddings")


# Price files: one facility per nation, cut into files of bounded size.

FILE_FACILITIES = """
select n_nationkey, concat('Baylor N', cast(n_nationkey as {STR}), ' Medical Center') as facility_name,
  concat('City', cast(n_nationkey as {STR})) as city,
  case n_regionkey when 0 then 'TX' when 1 then 'CA' when 2 then 'NY' when 3 then 'FL'
    else 'WA' end as state
from nation
"""

# Header rows by layout; a facility uses the layout n_nationkey % 4.
LAYOUTS = (
    (
        "description",
        "code|1",
        "code|1|type",
        "code|2",
        "code|2|type",
        "setting",
        "standard_charge|gross",
        "standard_charge|discounted_cash",
        "standard_charge|min",
        "standard_charge|max",
    ),
    (
        "Service Description",
        "code_1",
        "code_1_type",
        "code_2",
        "code_2_type",
        "Patient Setting",
        "Gross Charge",
        "Cash Price",
        "negotiated_min",
        "negotiated_max",
    ),
    (
        "procedure_description",
        "billing_code",
        "billing_code_type",
        "billing_code_1",
        "billing_code_type_1",
        "care_setting",
        "charge_gross",
        "standard_charge_discounted_cash_price",
        "min",
        "max",
    ),
    (
        "item_description",
        "code",
        "code_type",
        "rev_code",
        "note",
        "setting",
        "list_price",
        "self_pay",
        "minimum",
        "maximum",
    ),
)
CELLS = (
    "description",
    "code_1",
    "code_1_type",
    "code_2",
    "code_2_type",
    "setting",
    "gross",
    "cash",
    "neg_min",
    "neg_max",
)
#: Charge lines of a price file, on average over the nations: about 140 MB as JSON.
FILE_LINES = 500_000
#: Tasks that files are dealt to in turn.
FILE_TASKS = 200
#: Text of price files that lies in the shared folder at once, where files are ingested as they land.
LANDED_BYTES = 8 << 30
CSV_LINE_BYTES, JSON_LINE_BYTES = 150, 300


def file_parts(spark: SparkSession, folder: str) -> int:
    """Into how many files the lines of a nation are cut."""
    return 1 + charges(spark, folder).count() // (25 * FILE_LINES)


_cuts: dict[tuple, list] = {}


def _part(spark: SparkSession, folder: str, parts: int):
    """Part of a line: ranges of orders, so that files named in order have their lines in order."""
    key = (spark.sparkContext.applicationId, folder, parts)
    if key not in _cuts:
        shares = [i / parts for i in range(1, parts)]
        found = charges(spark, folder).agg(F.percentile_approx("l_orderkey", shares).alias("c")).first().c if shares else []
        _cuts[key] = found or []
    part = F.lit(0)
    for cut in _cuts[key]:
        part = part + F.when(F.col("l_orderkey") > cut, 1).otherwise(0)
    return part


def file_charges(spark: SparkSession, folder: str, only: range | None = None) -> DataFrame:
    """Charge lines with nation and facility, the part of its file they go to, and the number of that file; all parts, or ``only`` some."""
    lines = charges(spark, folder)
    parts = file_parts(spark, folder)
    only = only or range(parts)
    nations = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    places = _run(spark, folder, FILE_FACILITIES, "nation")
    # nations are few; their ranks number the files without gaps
    rank = F.dense_rank().over(Window.orderBy("n_nationkey")) - 1
    numbered = lines.withColumn("part_no", _part(spark, folder, parts))
    if len(only) < parts:
        numbered = numbered.where(F.col("part_no").between(only.start, only.stop - 1))
    return (
        numbered.join(nations, "s_suppkey")
        .join(places.withColumn("place", rank), F.col("s_nationkey") == F.col("n_nationkey"))
        .withColumn("file_no", (F.col("place") * len(only) + F.col("part_no") - only.start).cast("int"))
        # as long as the last one, so that paths are ordered like the parts
        .withColumn("part", F.lpad(F.col("part_no").cast("string"), len(str(parts - 1)), "0"))
        .withColumn(
            "address",
            F.concat(
                F.col("n_nationkey").cast("string"),
                F.lit(" Main St, "),
                F.col("city"),
                F.lit(", "),
                F.col("state"),
                F.lit(" 78701"),
            ),
        )
    )


def _file_rows(lines: DataFrame, first: list, last: list, line) -> DataFrame:
    """(n_nationkey, part, file_no, order_1, order_2, order_3, row): lines between fixed rows per file."""
    base = ("n_nationkey", "part", "file_no")
    heads = lines.select(*base, "facility_name", "city", "state", "address").distinct()
    edge = [(0, i, r) for i, r in enumerate(first)] + [(2, i, r) for i, r in enumerate(last)]
    if edge:
        fixed = heads.select(
            *base,
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(side).alias("order_1"),
                            F.lit(i).cast("long").alias("order_2"),
                            F.lit(0).cast("long").alias("order_3"),
                            row.alias("row"),
                        )
                        for side, i, row in edge
                    ]
                )
            ),
        )
    body = lines.select(
        *base,
        F.lit(1).alias("order_1"),
        F.col("l_orderkey").alias("order_2"),
        F.col("line_position").alias("order_3"),
        line.alias("row"),
    )
    return body.unionByName(fixed) if edge else body


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows of one file in one task, in their order; files are of bounded size, and no task has two while another has none."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, FILE_TASKS)
    return rows.repartitionById(tasks, F.col("file_no") % tasks).sortWithinPartitions(
        "n_nationkey", "part", "order_1", "order_2", "order_3"
    )


_folders: dict[tuple, str] = {}


def price_files(spark: SparkSession, folder: str, kind: str) -> str:
    """Folder pattern of price files of one kind, written once per application.

    'csv' has two metadata rows above the header and a layout per facility;
    'bare_csv' has the header only; 'quoted_csv' has line breaks inside its
    descriptions; 'json' are wrapped documents, 'array' root arrays, 'nested'
    arrays of arrays, 'ndjson' one item per line.
    """
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _folders:
        target = new_folder(spark, f"files-{kind}")
        _write_files(file_charges(spark, folder), kind, target)
        _folders[key] = target + "/n_nationkey=*/part=*"
    return _folders[key]


def landing_files(spark: SparkSession, folder: str, kind: str) -> Iterator[str]:
    """Folder patterns of the same price files, which land some at a time.

    No more than about ``LANDED_BYTES`` of them are there at once: those of a
    pattern are gone when the next one is asked for.  Where all fit, they are
    those of ``price_files``.
    """
    parts = file_parts(spark, folder)
    size = 25 * FILE_LINES * (CSV_LINE_BYTES if kind.endswith("csv") else JSON_LINE_BYTES)
    step = max(1, LANDED_BYTES // size)
    if step >= parts:
        yield price_files(spark, folder, kind)
        return
    target = new_folder(spark, f"landing-{kind}")
    for start in range(0, parts, step):
        # paths are ordered like the parts
        landed = f"{target}/{start:09}"
        _write_files(file_charges(spark, folder, range(start, min(parts, start + step))), kind, landed)
        yield landed + "/n_nationkey=*/part=*"
        delete_folder(spark, landed)


def _write_files(lines: DataFrame, kind: str, target: str) -> None:
    if kind.endswith("csv"):
        _csv_rows(lines, kind).write.partitionBy("n_nationkey", "part").csv(
            target, escape='"', emptyValue="", nullValue=""
        )
    elif kind == "ndjson":
        items = _json_rows(lines, kind)
        items.select("n_nationkey", "part", "row.*").write.partitionBy("n_nationkey", "part").json(
            target
        )
    else:
        _json_rows(lines, kind).write.partitionBy("n_nationkey", "part").text(target)


def _csv_rows(lines: DataFrame, kind: str) -> DataFrame:
    cells = lambda *values: F.array(
        *[F.lit(v) if isinstance(v, str) else v for v in values],
        *[F.lit("")] * (len(CELLS) - len(values)),
    )
    keys = cells(
        "hospital_name", "last_updated_on", "version", "hospital_location", "hospital_address"
    )
    values = cells(
        F.col("facility_name"),
        "2025-01-01",
        "2.0.0",
        F.concat("city", F.lit(", "), "state"),
        F.col("address"),
    )
    header = F.get(
        F.array(*[F.array(*[F.lit(c) for c in names]) for names in LAYOUTS]),
        F.col("n_nationkey") % len(LAYOUTS),
    )
    line = F.array(*[F.col(c) for c in CELLS])
    if kind == "quoted_csv":
        text = F.concat(F.col("description"), F.lit('\n"quoted", '), F.col("description"))
        line = F.array(text, *[F.col(c) for c in CELLS[1:]])
    first = [header] if kind == "bare_csv" else [keys, values, header]
    rows = _in_order(_file_rows(lines, first, [], line))
    return rows.select(
        "n_nationkey", "part", *[F.col("row")[i].alias(f"c{i}") for i in range(len(CELLS))]
    )


def _json_rows(lines: DataFrame, kind: str) -> DataFrame:
    pair = lambda i: F.struct(
        F.col(f"code_{i}").alias("code"), F.col(f"code_{i}_type").alias("type")
    )
    charge = (
        "setting",
        F.col("cash").alias("discounted_cash"),
        F.col("gross").alias("gross_charge"),
        F.col("neg_min").alias("minimum"),
        F.col("neg_max").alias("maximum"),
    )
    item = lambda *more: F.struct(
        "description",
        F.array(pair(1), pair(2)).alias("code_information"),
        F.array(F.struct(*charge, *more)).alias("standard_charges"),
    )
    if kind == "ndjson":
        cells = _in_order(_file_rows(lines, [], [], F.struct(*CELLS))).select("n_nationkey", "part", "row.*")
        return cells.select("n_nationkey", "part", item().alias("row"))
    payers = F.array(F.struct(F.lit("payer").alias("payer_name"))).alias("payers_information")
    header = F.substr(
        F.to_json(
            F.struct(
                F.col("facility_name").alias("hospital_name"),
                F.lit("2025-01-01").alias("last_updated_on"),
                F.lit("2.0.0").alias("version"),
                F.array("address").alias("hospital_address"),
            )
        ),
        F.lit(2),
    )
    inner = F.regexp_replace(header, r"\}$", "")
    # Every document starts with one empty item, so that all others follow a comma.
    # Facilities with an odd key tell their header after the items.
    early = F.col("n_nationkey") % 2 == 0
    edges = {
        "json": (
            F.when(early, F.concat(F.lit("{"), inner, F.lit(',"standard_charge_information":[{}')))
            .otherwise(F.lit('{"standard_charge_information":[{}')),
            F.when(early, F.lit("]}")).otherwise(F.concat(F.lit("],"), inner, F.lit("}"))),
        ),
        "array": (F.lit("[{}"), F.lit("]")),
        "nested": (F.lit("[[{}"), F.lit("],[{}]]")),
    }
    start, end = edges[kind]
    rows = _file_rows(lines, [start], [end], F.concat(F.lit(","), F.to_json(item(payers))))
    return _in_order(rows).select("n_nationkey", "part", "row")


def file_metadata(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Explicit facility fields for price files that tell none."""
    places = _run(spark, folder, FILE_FACILITIES, "nation")
    keyed = files.select(
        "path", F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey")
    )
    return keyed.join(places, "n_nationkey").select(
        "path",
        "facility_name",
        "city",
        "state",
        F.concat("city", F.lit(", "), "state").alias("address"),
        F.lit("2.0.0").alias("file_version"),
        F.lit("2025-01-01").alias("last_updated"),
    )
