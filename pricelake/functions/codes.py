"""Billing codes: type names, the codes map of a charge, and code lookups."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Other spellings of the code types that are kept.
CODE_TYPE_ALIASES = {
    "CPT": "HCPCS",
    "REV": "RC",
    "ICD10": "ICD-10",
    "ICD10CM": "ICD-10-CM",
    "ICD10PCS": "ICD-10-PCS",
}
# Nationally standardised code types.
STANDARD_CODE_TYPES = ("CPT", "HCPCS", "ICD-10", "ICD-10-CM", "ICD-10-PCS", "RC")
# Texts that mean "no code".
EMPTY_CODES = ("", "N/A", "NULL", "NONE")

CODES_MAP = "map<string,array<string>>"


def normalize_code_type(code_type: Column) -> Column:
    """Canonical type name; a missing type becomes 'unknown'."""
    name = F.upper(F.trim(code_type))
    aliased = F.when(name.isNull() | (name == ""), F.lit("unknown"))
    for alias, canonical in CODE_TYPE_ALIASES.items():
        aliased = aliased.when(name == alias, F.lit(canonical))
    return aliased.otherwise(name)


def is_standard_code_type(code_type: Column) -> Column:
    return F.upper(code_type).isin(*STANDARD_CODE_TYPES)


def _trimmed(code_pairs: Column) -> Column:
    return F.transform(
        code_pairs,
        lambda p: F.struct(
            F.upper(F.trim(p["type"])).alias("type"), F.trim(p["code"]).alias("code")
        ),
    )


def _is_kept(pair: Column) -> Column:
    return pair["type"].isin(*STANDARD_CODE_TYPES, *CODE_TYPE_ALIASES) & ~F.upper(
        pair["code"]
    ).isin(*EMPTY_CODES)


def has_standard_code(code_pairs: Column) -> Column:
    return F.exists(_trimmed(code_pairs), _is_kept)


def standard_codes(code_pairs: Column) -> Column:
    """Pairs with canonical types, minus empty codes and non-standard types."""
    aliases = F.create_map(*[F.lit(x) for pair in CODE_TYPE_ALIASES.items() for x in pair])
    return F.transform(
        F.filter(_trimmed(code_pairs), _is_kept),
        lambda p: F.struct(
            F.coalesce(F.try_element_at(aliases, p["type"]), p["type"]).alias("type"),
            p["code"].alias("code"),
        ),
    )


def codes_map(pairs: Column) -> Column:
    """Map from type to its codes in source order, repeats kept.

    Types are sorted, so that two equal maps also have equal JSON text.
    """
    types = F.sort_array(F.array_distinct(F.transform(pairs, lambda p: p["type"])))
    return F.map_from_entries(
        F.transform(
            types,
            lambda t: F.struct(
                t.alias("key"),
                F.transform(
                    F.filter(pairs, lambda p: p["type"] == t), lambda p: p["code"]
                ).alias("value"),
            ),
        )
    )


def codes_text(codes: Column) -> Column:
    """JSON text of a codes map; equal maps give equal text."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(codes))))


def codes_from_text(text: Column) -> Column:
    return F.from_json(text, CODES_MAP)


def first_code(codes: Column, code_type: str) -> Column:
    return F.get(F.try_element_at(codes, F.lit(code_type)), F.lit(0))


def has_code(codes: Column, code: str) -> Column:
    """True when any type of the map lists ``code``."""
    return F.array_contains(F.flatten(F.map_values(codes)), code)
