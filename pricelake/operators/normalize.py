"""Raw charge lines to typed operations, with reject reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pricelake.functions import codes as C, names as NM, prices as P
from pricelake.schemas import POSITION, PRICE_FIELDS

NO_STANDARD_CODE = "no_standard_code"
NO_CASH_PRICE = "missing_cash_price"
NOT_OUTPATIENT = "not_outpatient"
#: Column of raw lines that tells why one could not be read.
FAULT = "fault"

# U+FFFD stands for bytes that were not valid UTF-8; they are dropped.
_BAD_BYTES = "�"


def clean_description(text: Column) -> Column:
    """Trimmed description; missing ones are called 'Unknown'."""
    bare = F.trim(NM.without(text, _BAD_BYTES))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("Unknown"))


def clean_setting(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def is_outpatient(setting: Column) -> Column:
    """Blank settings count as outpatient, 'both' does not."""
    return setting.isin("", "outpatient")


def _typed(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return raw.select(
        "facility_id",
        *POSITION,
        *keep,
        clean_description(F.col("description")).alias("description"),
        clean_setting(F.col("setting")).alias("setting"),
        *[P.clean_price(F.col(p)).alias(p) for p in PRICE_FIELDS],
        "code_pairs",
        C.standard_codes(F.col("code_pairs")).alias("pairs"),
    )


def _failures(
    has_code: Column, outpatient_only: bool, require_cash_price: bool
) -> dict[str, Column]:
    checks = {NO_STANDARD_CODE: ~F.coalesce(has_code, F.lit(False))}
    if require_cash_price:
        checks[NO_CASH_PRICE] = F.col("cash_price").isNull()
    if outpatient_only:
        checks[NOT_OUTPATIENT] = ~is_outpatient(F.col("setting"))
    return checks


def _lines(typed: DataFrame, *extra: Column) -> DataFrame:
    return typed.select(
        "facility_id",
        *POSITION,
        "description",
        "setting",
        F.coalesce("cash_price", F.lit(0.0)).alias("cash_price"),
        *PRICE_FIELDS[1:],
        F.to_json(C.codes_map(F.col("pairs"))).alias("codes_key"),
        *extra,
    )


def normalize(
    raw: DataFrame,
    outpatient_only: bool = True,
    require_cash_price: bool = True,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Typed row and ``reasons`` for every raw charge line; no row is dropped.

    A line is accepted when ``reasons`` is empty; a missing cash price counts
    as 0 where it is not required.  A line that could not be read as a record
    has its ``fault``, if ``raw`` has such a column, for its only reason.  ``keep`` names further columns to carry.
    One projection chain over the scan, no shuffle.
    """
    failures = _failures(F.size("pairs") > 0, outpatient_only, require_cash_price)
    reasons = F.array_compact(F.array(*[F.when(f, F.lit(name)) for name, f in failures.items()]))
    if FAULT in raw.columns:
        keep = (*keep, FAULT)
        reasons = F.when(F.col(FAULT).isNull(), reasons).otherwise(F.array(FAULT))
    kept = [F.col(c) for c in keep if c != FAULT]
    return _lines(_typed(raw, keep), reasons.alias("reasons"), *kept)


def accept(
    raw: DataFrame, outpatient_only: bool = True, require_cash_price: bool = True
) -> DataFrame:
    """The accepted lines alone.

    Same rows as ``normalize`` with empty reasons, but the checks are separate
    filters: they move below the projection and spare rejected lines the rest,
    the cheapest check (the setting) first, the codes last.
    """
    typed = _typed(raw)
    has_code = C.has_standard_code(F.col("code_pairs"))
    for failed in reversed(_failures(has_code, outpatient_only, require_cash_price).values()):
        typed = typed.where(~failed)
    return _lines(typed)


def rejected(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.size("reasons") > 0)


def with_codes(rows: DataFrame) -> DataFrame:
    """Add the codes map and the primary codes to rows that carry its text."""
    codes = C.codes_from_text(F.col("codes_key"))
    return rows.withColumn("codes", codes).withColumns(
        {
            "rc_code": C.first_code(F.col("codes"), "RC"),
            "hcpcs_code": C.first_code(F.col("codes"), "HCPCS"),
        }
    )
