"""Guarded casts and scalar helpers, all built from Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*\z|^(?i)\s*[+-]?(inf|infinity|nan)\s*\z"
DATE = r"^\s*(\d{1,6})([-/ \\])(\d{1,2})\2(\d{1,2})(\s*|[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*)\z"


def try_number(c: Column) -> Column:
    """The double that a text denotes, digits grouped by _ allowed; null otherwise ('1d' is no number)."""
    plain = F.replace(F.trim(c), F.lit("_"), F.lit(""))
    signed_nan = F.lower(F.trim(c)).rlike(r"^[+-]nan\z")
    return F.when(c.rlike(NUMBER), F.when(signed_nan, F.lit(float("nan"))).otherwise(plain.try_cast("double")))


def try_day(c: Column) -> Column:
    """The date of year-month-day texts with -, /, \\ or blanks as one separator; null otherwise ('2024' is no date)."""
    part = lambda g: F.regexp_extract(c, DATE, g)
    year = F.lpad(part(1), 4, "0")
    year = F.when(F.length(part(1)) > 4, part(1)).otherwise(year)
    day = F.concat_ws("-", year, F.lpad(part(3), 2, "0"), F.lpad(part(4), 2, "0"))
    return F.when(c.rlike(DATE), day.try_cast("date"))


def try_integer(c: Column, kind: str = "bigint") -> Column:
    """The integer nearest to the number that a text denotes, halves away from zero; null out of range or for no number."""
    plain = F.replace(F.trim(c), F.lit("_"), F.lit(""))
    return F.when(c.rlike(NUMBER), F.round(plain.try_cast("decimal(38,18)"), 0).try_cast(kind))


MOMENT = r"^\s*(\d{1,6})([-/ \\])(\d{1,2})\2(\d{1,2})(?:[T ](\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d{1,6})?))?)?\s*\z"


def try_moment(c: Column) -> Column:
    """The time of a date (as try_day takes it), with hours and minutes, and seconds, if there are any; without a zone. Null otherwise."""
    part = lambda g: F.regexp_extract(c, MOMENT, g)
    two = lambda g: F.lpad(F.when(part(g) == "", "0").otherwise(part(g)), 2, "0")
    year = F.when(F.length(part(1)) > 4, part(1)).otherwise(F.lpad(part(1), 4, "0"))
    seconds = F.when(part(7).rlike(r"^\d(\.|\z)"), F.concat(F.lit("0"), part(7))).when(part(7) == "", "00").otherwise(part(7))
    text = F.concat(year, F.lit("-"), two(3), F.lit("-"), two(4), F.lit(" "), two(5), F.lit(":"), two(6), F.lit(":"), seconds)
    return F.when(c.rlike(MOMENT), text.try_cast("timestamp_ntz"))


def is_number(c: Column) -> Column:
    return try_number(c).isNotNull()


def fnv1a(c: Column) -> Column:
    """FNV-1a, 32 bits, over the UTF-8 bytes, as a long."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda i: F.conv(F.hex(F.substring(c.cast("binary"), i, F.lit(1))), 16, 10).cast("long"))
    step = lambda h, b: F.pmod(h.bitwiseXOR(b) * F.lit(16777619).cast("long"), F.lit(1 << 32))
    return F.when(c.isNotNull(), F.when(F.octet_length(c) == 0, F.lit(2166136261)).otherwise(F.aggregate(codes, F.lit(2166136261), step)))


def rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.format_string("rgba(%d,%d,%d,%d)", r, g, b, a)


def column_letters(n: Column) -> Column:
    """1 -> A, 27 -> AA; up to three letters."""
    z = n - 1
    one = lambda v: F.char(F.lit(65) + F.pmod(v, F.lit(26)).cast("int"))
    two = F.floor(z / 26) - 1
    three = F.floor(two / 26) - 1
    return F.concat(F.when(three >= 0, one(three)).otherwise(""), F.when(two >= 0, one(two)).otherwise(""), one(z))


def letters_column(c: Column) -> Column:
    """A -> 1, AA -> 27."""
    digits = F.transform(F.split(F.upper(c), ""), lambda x: F.ascii(x) - 64)
    return F.aggregate(F.filter(digits, lambda d: d > 0), F.lit(0), lambda a, d: a * 26 + d)


def excel_day(serial: Column, date1904: bool = False) -> Column:
    return F.date_add(F.lit("1904-01-01" if date1904 else "1899-12-30").cast("date"), F.floor(serial).cast("int"))


def pdf_date(c: Column) -> Column:
    """D:YYYYMMDDhhmmss±hh'mm to ISO 8601; a text without a four-digit year as it is, missing parts 01 or 00."""
    pattern = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:(Z)|([+-])(\d{2})'?(\d{2})?)?"
    part = lambda g, d: F.coalesce(F.nullif(F.regexp_extract(c, pattern, g), F.lit("")), F.lit(d))
    zone = F.when(F.regexp_extract(c, pattern, 7) != "", F.lit("Z")).when(F.regexp_extract(c, pattern, 8) != "", F.concat(F.regexp_extract(c, pattern, 8), part(9, "00"), F.lit(":"), part(10, "00"))).otherwise("")
    iso = F.concat(part(1, ""), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit("T"), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"), zone)
    return F.when(c.rlike(r"^(?:D:)?\d{4}"), iso).otherwise(c)
