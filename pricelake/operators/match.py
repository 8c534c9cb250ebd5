"""Matching the columns of any file layout to the canonical fields.

Headers are data: a row per file with its column names.  The result is a row
per file with the position of every canonical field, which the CSV scan uses
to pick cells, so the number of layouts never shows in the plan.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

# Known column names per field, best first.
FIELD_PATTERNS = {
    "description": (
        "description",
        "service_description",
        "procedure_description",
        "item_description",
        "charge_description",
        "cpt_description",
        "service",
        "procedure",
    ),
    "cash_price": (
        "standard_charge|discounted_cash",
        "discounted_cash",
        "cash_price",
        "self_pay",
        "selfpay",
        "cash_discount",
        "discounted_price",
        "standard_charge_discounted_cash",
        "cash",
        "de_identified_minimum",
    ),
    "gross_charge": (
        "standard_charge|gross",
        "gross",
        "gross_charge",
        "standard_charge",
        "charge_amount",
        "list_price",
        "standard_charge_gross",
        "gross_price",
    ),
    "negotiated_min": (
        "standard_charge|min",
        "min",
        "minimum",
        "negotiated_min",
        "min_negotiated",
        "deidentified_min",
        "de_identified_min",
        "standard_charge_min",
        "min_price",
    ),
    "negotiated_max": (
        "standard_charge|max",
        "max",
        "maximum",
        "negotiated_max",
        "max_negotiated",
        "deidentified_max",
        "de_identified_max",
        "standard_charge_max",
        "max_price",
    ),
    "setting": (
        "setting",
        "patient_setting",
        "care_setting",
        "service_setting",
        "location",
        "place_of_service",
    ),
}
FIELDS = tuple(FIELD_PATTERNS)
FUZZY_THRESHOLD = 80

# Code columns with a number, as in code|1 and code|1|type or code_1 and code_1_type.
NUMBERED_CODE = r"^code[|_](\d+)$"
NUMBERED_TYPE = r"^code([|_])(\d+)\1type$"
# Other code column names; the last group is the instance.
BILLING_CODE = r"^billing_code(_\d+)?$"
BILLING_TYPE = r"^billing_code_type(_\d+)?$"
TYPED_CODE = r"^(cpt|hcpcs|drg|icd10|rev|ndc)_code(_\d+)?$"
NESTED_CODE = r"^code_information"
PLAIN_CODE = r"^code$"
PLAIN_TYPE = r"^(code_type|type)$"


def normalized_name(column: Column) -> Column:
    return F.replace(F.lower(column), F.lit(" "), F.lit("_"))


def similarity(pattern_words: Column, column_words: Column) -> Column:
    """0..100 from shared words (70 %) and pattern words found inside column words (30 %)."""
    shared = F.size(F.array_intersect(pattern_words, column_words)).cast("double")
    union = F.size(F.array_union(pattern_words, column_words)).cast("double")
    inside = F.size(
        F.filter(
            pattern_words, lambda w: F.exists(column_words, lambda c: F.contains(c, w))
        )
    ).cast("double")
    share = inside / F.size(pattern_words).cast("double")
    return F.floor((shared / union * F.lit(0.7) + share * F.lit(0.3)) * F.lit(100.0)).cast("int")


def _words(name: Column) -> Column:
    return F.array_distinct(F.split(name, "_"))


def _patterns() -> Column:
    """All patterns as one literal: a session builds it in one step."""
    rows = [
        {"field": field, "priority": priority, "pattern": pattern}
        for field, patterns in FIELD_PATTERNS.items()
        for priority, pattern in enumerate(patterns)
    ]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<field: string, priority: int, pattern: string>>")


def header_columns(headers: DataFrame) -> DataFrame:
    """(file, pos, column, name) of headers (file, columns)."""
    return headers.select("file", F.posexplode("columns").alias("pos", "column")).withColumn(
        "name", normalized_name(F.col("column"))
    )


# Without a common word the score is at most this.
NO_COMMON_WORD = 30


def score_names(names: DataFrame, threshold: int = FUZZY_THRESHOLD) -> DataFrame:
    """Fields that each distinct normalised name can stand for, with score.

    Works on distinct names, which files share, and only on pairs of name and
    pattern that have a word in common, found by an equi-join; pairs without
    one score too low for any threshold above 30.
    """
    if threshold <= NO_COMMON_WORD:
        raise ValueError(f"threshold must be above {NO_COMMON_WORD}")
    distinct = names.select("name").distinct()
    patterns = distinct.sparkSession.range(1).select(F.inline(_patterns()))
    by_word = patterns.withColumn("word", F.explode(_words(F.col("pattern"))))
    sharing = (
        distinct.withColumn("word", F.explode(_words(F.col("name"))))
        .join(F.broadcast(by_word), "word")
        .drop("word")
        .distinct()
    )
    return (
        sharing.withColumn("exact", F.col("name") == F.col("pattern"))
        .withColumn("score", similarity(_words(F.col("pattern")), _words(F.col("name"))))
        .where(F.col("exact") | (F.col("score") >= threshold))
    )


def match_fields(headers: DataFrame, threshold: int = FUZZY_THRESHOLD) -> DataFrame:
    """Best column per (file, field): exact names by pattern order, else best score.

    Ties go to the earlier pattern, then to the earlier column.  Of several
    columns with one normalised name the last holds the values.
    """
    columns = header_columns(headers)
    per_file = columns.groupBy("file", "name").agg(
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("pos"),
        F.max_by("column", "pos").alias("column"),
    )
    ranked = per_file.join(score_names(columns, threshold), "name")
    best = F.min_by(
        F.struct("column", "pos", "score", "exact"),
        F.struct(
            (~F.col("exact")).alias("fuzzy"),
            F.when(F.col("exact"), F.col("priority")).otherwise(-F.col("score")).alias("rank"),
            "priority",
            "first_pos",
        ),
    )
    return ranked.groupBy("file", "field").agg(best.alias("best")).select("file", "field", "best.*")


def code_role(column: Column) -> Column:
    """(instance, is_type, implied_type) of a code column name, NULL for others.

    A name such as ``cpt_code`` is a code column that implies its type; plain
    ``code`` and ``code_type`` belong together.
    """
    name = F.lower(column)

    def role(instance: Column, is_type: Column, implied: Column | None = None) -> Column:
        return F.struct(
            instance.alias("instance"),
            is_type.alias("is_type"),
            (F.lit(None).cast("string") if implied is None else implied).alias("implied_type"),
        )

    def group(pattern: str, i: int = 1) -> Column:
        return F.regexp_extract(name, pattern, i)

    suffix_or_null = lambda pattern: F.nullif(group(pattern), F.lit(""))
    yes, no = F.lit(True), F.lit(False)
    return (
        F.when(name.rlike(NUMBERED_CODE), role(group(NUMBERED_CODE), no))
        .when(
            name.rlike(NUMBERED_TYPE),
            role(group(NUMBERED_TYPE, 2), yes),
        )
        .when(name.rlike(BILLING_CODE), role(suffix_or_null(BILLING_CODE), no))
        .when(name.rlike(BILLING_TYPE), role(suffix_or_null(BILLING_TYPE), yes))
        .when(
            name.rlike(TYPED_CODE),
            role(
                F.concat(group(TYPED_CODE, 1), group(TYPED_CODE, 2)),
                no,
                F.upper(group(TYPED_CODE, 1)),
            ),
        )
        .when(name.rlike(NESTED_CODE), role(F.lit("0"), F.contains(name, F.lit("type"))))
        .when(name.rlike(PLAIN_CODE), role(F.lit("0"), no))
        .when(name.rlike(PLAIN_TYPE), role(F.lit("0"), yes))
    )


def code_columns(headers: DataFrame) -> DataFrame:
    """(file, instance, code_pos, type_pos, implied_type) of every code column."""
    roles = (
        header_columns(headers)
        .withColumn("role", code_role(F.col("column")))
        .where(F.col("role").isNotNull())
        .select("file", "pos", "role.*")
    )
    code_pos = F.when(~F.col("is_type"), F.col("pos"))
    return (
        roles.groupBy("file", "instance")
        .agg(
            F.max(code_pos).alias("code_pos"),
            F.max(F.when(F.col("is_type"), F.col("pos"))).alias("type_pos"),
            F.max_by("implied_type", code_pos).alias("implied_type"),
        )
        .where(F.col("code_pos").isNotNull())
    )


def column_mapping(headers: DataFrame, threshold: int = FUZZY_THRESHOLD) -> DataFrame:
    """One row per file: ``<field>_pos`` of every field and the ordered code columns.

    Code columns are ordered by instance as text, a missing instance first.
    The lists are as long as the code columns of one header.
    """
    fields = (
        match_fields(headers, threshold)
        .groupBy("file")
        .agg(*[F.max(F.when(F.col("field") == f, F.col("pos"))).alias(f"{f}_pos") for f in FIELDS])
    )
    codes = (
        code_columns(headers)
        .groupBy("file")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("instance", "code_pos", "type_pos", "implied_type"))
            ).alias("code_columns")
        )
    )
    return headers.select("file").join(fields, "file", "left").join(codes, "file", "left")


def _found() -> dict[str, Column]:
    return {
        "description": F.col("description_pos").isNotNull(),
        "has_codes": F.coalesce(F.size("code_columns"), F.lit(0)) > 0,
        "has_price": F.col("cash_price_pos").isNotNull() | F.col("gross_charge_pos").isNotNull(),
        **{
            f: F.col(f"{f}_pos").isNotNull()
            for f in ("cash_price", "gross_charge", "negotiated_min", "negotiated_max")
        },
    }


def missing_fields() -> Column:
    """Critical parts a mapping row lacks."""
    # How the report names them.
    labels = {
        "description": "description",
        "has_codes": "code columns",
        "has_price": "pricing information",
    }
    found = _found()
    return F.array_compact(
        F.array(*[F.when(~found[k], F.lit(label)) for k, label in labels.items()])
    )


def mapping_flags(mapping: DataFrame) -> DataFrame:
    """Which canonical parts were found, and the critical ones that were not."""
    return mapping.select(
        "file",
        *[flag.alias(k) for k, flag in _found().items()],
        missing_fields().alias("missing_fields"),
    )
