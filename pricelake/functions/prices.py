"""Price text to numbers, and numbers back to display text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A number with nothing but blanks around it.  Signs other than plus do not match.
_POSITIVE = r"^\s*(\+?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*$"


def clean_price(text: Column) -> Column:
    """Number behind a price cell, or NULL when it is missing or not positive.

    The pattern keeps out texts a cast would take for numbers ('1d', 'NaN',
    'Infinity'); an overflowing exponent is no price either.  Signs are taken
    out by byte search: ``translate`` takes a text apart letter by letter.
    """
    bare = F.replace(F.replace(text, F.lit("$"), F.lit("")), F.lit(","), F.lit(""))
    digits = F.regexp_extract(bare, _POSITIVE, 1)
    return F.nullif(
        F.nullif(F.nullif(digits, F.lit("")).try_cast("double"), F.lit(0.0)),
        F.lit(float("inf")),
    )


def to_table_price(price: Column) -> Column:
    """Price as stored in the tables; NULL when it does not fit."""
    return F.round(price, 2).try_cast("decimal(10,2)")


def fits_table_price(price: Column) -> Column:
    return price.isNull() | to_table_price(price).isNotNull()


def money_or_na(price: Column) -> Column:
    return F.when(price.isNull(), F.lit("N/A")).otherwise(F.format_string("$%.2f", price.cast("double")))


def money_range(low: Column, high: Column) -> Column:
    return F.concat(money_or_na(low), F.lit(" - "), money_or_na(high))
