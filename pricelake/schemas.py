"""Schemas shared by readers, operators and writers."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE_FIELDS = ("cash_price", "gross_charge", "negotiated_min", "negotiated_max")

HOSPITALS = T.StructType(
    [
        T.StructField("facility_id", T.StringType()),
        T.StructField("facility_name", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("file_version", T.StringType()),
        T.StructField("last_updated", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
    ]
)

OPERATIONS = T.StructType(
    [
        T.StructField("facility_id", T.StringType()),
        T.StructField("codes", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("rc_code", T.StringType()),
        T.StructField("hcpcs_code", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("cash_price", T.DoubleType()),
        T.StructField("gross_charge", T.DoubleType()),
        T.StructField("negotiated_min", T.DoubleType()),
        T.StructField("negotiated_max", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
    ]
)

# The tables as stored: prices as DECIMAL, hospitals with their history.
STORED_OPERATIONS = T.StructType(
    [
        T.StructField(f.name, T.DecimalType(10, 2)) if f.name in PRICE_FIELDS else f
        for f in OPERATIONS.fields
    ]
)
STORED_HOSPITALS = T.StructType(
    [
        *HOSPITALS.fields,
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

# One raw charge line of any source, still as text.  The (source_file,
# source_block, source_row) triple is the position used to break ties.
RAW_CHARGES = T.StructType(
    [
        T.StructField("facility_id", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_block", T.LongType()),
        T.StructField("source_row", T.LongType()),
        T.StructField("description", T.StringType()),
        T.StructField("setting", T.StringType()),
        T.StructField("cash_price", T.StringType()),
        T.StructField("gross_charge", T.StringType()),
        T.StructField("negotiated_min", T.StringType()),
        T.StructField("negotiated_max", T.StringType()),
        T.StructField(
            "code_pairs",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("type", T.StringType()),
                        T.StructField("code", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)
POSITION = ("source_file", "source_block", "source_row")

QUERY_CACHE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("user_query", T.StringType()),
        T.StructField("hcpcs_codes", T.ArrayType(T.StringType())),
        T.StructField("rc_codes", T.ArrayType(T.StringType())),
        T.StructField("reasoning", T.StringType()),
        T.StructField("confidence_score", T.DecimalType(3, 2)),
        T.StructField("query_embedding", T.ArrayType(T.FloatType())),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

# JSON layouts.  Prices and codes are read as text so that one cleaning rule
# serves every format; fields outside these schemas are never materialised.
JSON_ITEM = T.StructType(
    [
        T.StructField("description", T.StringType()),
        T.StructField(
            "code_information",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("code", T.StringType()),
                        T.StructField("type", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "standard_charges",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("setting", T.StringType()),
                        T.StructField("discounted_cash", T.StringType()),
                        T.StructField("gross_charge", T.StringType()),
                        T.StructField("minimum", T.StringType()),
                        T.StructField("maximum", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)
JSON_HEADER = T.StructType(
    [
        T.StructField("hospital_name", T.StringType()),
        T.StructField("hospital_address", T.ArrayType(T.StringType())),
        T.StructField("version", T.StringType()),
        T.StructField("last_updated_on", T.StringType()),
    ]
)
JSON_ITEMS_KEY = "standard_charge_information"
