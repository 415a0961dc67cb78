"""Scalar functions on text: numbers in two notations, dates, hashes, column letters and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The constants of 32-bit FNV-1a, and the form of a case id.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
CASE_ID = r"^N1:(ElmLne|ElmTr2):(.+)$"


def number(text: Column) -> Column:
    """A number with a decimal comma and thousand dots, or with a decimal point; anything else is null."""
    t = F.trim(text)
    comma = F.regexp_like(t, F.lit(r"^[+-]?(\d{1,3}(\.\d{3})+|\d+),\d+$"))
    grouped = F.regexp_like(t, F.lit(r"^[+-]?\d{1,3}(\.\d{3}){2,}$"))
    plain = F.regexp_like(t, F.lit(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"))
    no_dots = F.regexp_replace(t, r"\.", "")
    return F.when(comma, F.regexp_replace(no_dots, ",", ".").try_cast("double")).when(grouped, no_dots.try_cast("double")).when(plain, t.try_cast("double"))


def day(text: Column) -> Column:
    """A date written as yyyy-MM-dd, dd.MM.yyyy or yyyyMMdd; null if it is none."""
    t = F.trim(text)
    return F.coalesce(*(F.when(F.regexp_like(t, F.lit(p)), F.try_to_date(t, f)) for p, f in ((r"^\d{4}-\d\d-\d\d$", "yyyy-MM-dd"), (r"^\d\d\.\d\d\.\d{4}$", "dd.MM.yyyy"), (r"^\d{8}$", "yyyyMMdd"))))


def fnv1a(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, 32 bits."""
    digits = F.hex(F.encode(text, "UTF-8"))
    pairs = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).otherwise(F.array().cast("array<int>"))
    step = lambda h, at: (h.bitwiseXOR(F.conv(digits.substr(at, F.lit(2)), 16, 10).cast("long")) * FNV_PRIME) % (1 << 32)
    return F.aggregate(pairs, F.lit(FNV_OFFSET), step)


def column_letters(number: Column) -> Column:
    """Spreadsheet letters of a column counted from 1, up to three of them."""
    letter = lambda x: F.char(F.lit(65) + x)
    last, second, third = (number - 1) % 26, F.floor((number - 27) / 26) % 26, F.floor((number - 703) / 676) % 26
    return F.concat(F.when(number > 702, letter(third)).otherwise(""), F.when(number > 26, letter(second)).otherwise(""), letter(last))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def case_id(text: Column) -> tuple[Column, Column]:
    """Class and key of a case id N1:class:key; null if it is none."""
    part = lambda i: F.nullif(F.regexp_extract(text, CASE_ID, i), F.lit(""))
    return part(1), part(2)


def stable_json(values: Column) -> Column:
    """JSON of a map of text with its keys in order; null values are left out."""
    kept = F.filter(F.map_entries(values), lambda e: e["value"].isNotNull())
    return F.to_json(F.map_from_entries(F.array_sort(kept)))


def csv_cell(value: Column) -> Column:
    """A quoted cell: quotes doubled, formulas guarded, null and what is not finite empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    text = F.when(text.isin("NaN", "Infinity", "-Infinity"), "").otherwise(text)
    safe = F.when(F.regexp_like(text, F.lit(r"^[\s\x00-\x1f]*[=+@-]")), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def measurement(value: Column) -> Column:
    """A measured value as shown: one decimal with a comma, three digits where it is tiny, an exponent below 1e-6; zero has no
    sign, and what is missing is a dash."""
    size = F.abs(value)
    tiny = F.floor(-F.log10(size)) + 3
    digits = F.format_string("%.6f", value)
    shown = F.when(size == 0, "0").when(size < 1e-6, F.format_string("%.2e", value)).when(size < 0.1, digits.substr(F.lit(1), F.when(value < 0, 4).otherwise(3) + F.least(tiny, F.lit(6)).cast("int"))).otherwise(F.format_string("%.1f", value))
    return F.when(value.isNull() | F.isnan(value), "—").otherwise(F.replace(shown, F.lit("."), F.lit(",")))
