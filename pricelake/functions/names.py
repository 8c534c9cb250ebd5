"""Facility names, identifiers and addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Short forms of common words in hospital names.
NAME_WORDS = {
    "baylor": "bsw",
    "scott": "bsw",
    "white": "bsw",
    "ascension": "asc",
    "seton": "asc",
    "cedar": "cp",
    "park": "cp",
    "regional": "reg",
    "medical": "med",
    "center": "ctr",
    "hospital": "hosp",
    "health": "hlth",
    "system": "sys",
    "emergency": "er",
    "campus": "campus",
    "georgetown": "gtown",
}

_STATE = r"\b([A-Z]{2})\b"
_STATE_ZIP = r"\b([A-Z]{2})\s+\d{5}"


def without(text: Column, letters: str) -> Column:
    """``text`` without ``letters``; bytes that are not valid UTF-8 count as U+FFFD.

    Only a text that has one of them is taken apart letter by letter.
    """
    has = ~F.is_valid_utf8(text)
    for letter in letters:
        has = has | F.contains(text, F.lit(letter))
    return F.when(has, F.translate(text, letters, "")).otherwise(text)


def facility_id(name: Column) -> Column:
    """Identifier made of the shortened, distinct words of a hospital name."""
    words = F.split(
        F.trim(
            F.regexp_replace(
                F.regexp_replace(F.lower(name), r"(?U)[^a-z0-9\s-]", ""),
                r"(?U)\s+",
                " ",
            )
        ),
        " ",
    )
    short = F.create_map(*[F.lit(x) for pair in NAME_WORDS.items() for x in pair])
    parts = F.array_distinct(
        F.transform(
            words, lambda w: F.coalesce(F.try_element_at(short, w), F.substring(w, 1, 4))
        )
    )
    joined = F.regexp_replace(F.array_join(parts, "-"), "-+", "-")
    return F.btrim(joined, F.lit("-"))


def title_case(text: Column) -> Column:
    """First letter of every run of letters upper, the rest lower."""
    runs = F.split(F.regexp_replace(F.lower(text), r"(?<!\p{L})(\p{L})", "\u0001$1"), "\u0001")
    return F.array_join(
        F.transform(
            runs,
            lambda run, i: F.when(i == 0, run).otherwise(
                F.concat(F.upper(F.left(run, F.lit(1))), F.substr(run, F.lit(2)))
            ),
        ),
        "",
    )


def file_stem(path: Column) -> Column:
    """File name without directories and without its last extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def file_extension(path: Column) -> Column:
    """Lower-case extension with its dot, '' when there is none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1))


def name_from_file(path: Column) -> Column:
    """Hospital name told by a file name such as ``74_ST-MARY_standardcharges``."""
    stem = file_stem(path)
    parts = F.split(stem, "_")
    patterned = (F.size(parts) >= 3) & (F.element_at(parts, -1) == "standardcharges")
    middle = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), "_")
    return title_case(
        F.when(patterned, F.translate(middle, "-", " ")).otherwise(F.translate(stem, "-_", "  "))
    )


def name_from_json_file(path: Column) -> Column:
    """Same for JSON files: the second part of the stem, when there is one."""
    parts = F.split(file_stem(path), "_")
    return F.when(
        F.size(parts) >= 2, title_case(F.translate(F.get(parts, F.lit(1)), "-", " "))
    ).otherwise(name_from_file(path))


def _state_in(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, _STATE, 1), F.lit(""))


def _part(parts: Column, i: int) -> Column:
    return F.trim(F.get(parts, F.lit(i)))


def city_state_of_address(address: Column) -> Column:
    """(city, state) of "STREET, CITY, ST ZIP"; both NULL for fewer parts."""
    parts = F.split(address, ",")
    known = F.size(parts) >= 3
    return F.struct(
        F.when(known, _part(parts, 1)).alias("city"),
        F.when(known, _state_in(_part(parts, 2))).alias("state"),
    )


def city_state_of_location(location: Column, address: Column) -> Column:
    """(city, state) of "CITY, ST", falling back to the street address.

    The address is only asked when the location names no city: its city is the
    second of three or more comma parts, the first of two, or the word before
    "ST 12345" when there is no comma.
    """
    loc = F.split(location, ",")
    has_location = F.size(loc) >= 2
    loc_city = F.when(has_location, _part(loc, 0))
    loc_state = F.when(has_location, _state_in(_part(loc, 1)))

    adr = F.split(address, ",")
    n = F.size(adr)
    before_zip = F.regexp_extract(address, r"^(.*?)\s*" + _STATE_ZIP, 1)
    adr_city = (
        F.when(n >= 3, _part(adr, 1))
        .when(n == 2, _part(adr, 0))
        .otherwise(F.nullif(F.regexp_extract(before_zip, r"(\S+)\s*$", 1), F.lit("")))
    )
    adr_state = F.when(n >= 2, _state_in(F.element_at(adr, -1))).otherwise(
        F.nullif(F.regexp_extract(address, _STATE_ZIP, 1), F.lit(""))
    )
    use_address = F.coalesce(loc_city, F.lit("")) == ""
    return F.struct(
        F.when(use_address, F.coalesce(adr_city, loc_city)).otherwise(loc_city).alias("city"),
        F.when(use_address, F.coalesce(adr_state, loc_state)).otherwise(loc_state).alias("state"),
    )
