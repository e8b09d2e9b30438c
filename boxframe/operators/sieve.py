"""Typed sieve: pattern ladders as CASE expressions; the first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import is_number, try_day, try_number

# Patterns and ranges of the classification.
YEAR = r"^\d{4}\z"
CURRENCY = r"^\$[\d,.]+\z"
PERCENTAGE = r"^[\d,.]+\s*%\z"
ZIP_CODE = r"^\d{5}(-\d{4})?\z"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}"
MONEY = r"^([$€£¥]\s*[\d,.]+|[\d,.]+\s*(USD|EUR|GBP|JPY))\z"
PHONE = r"^\+?[\d\s().-]{7,15}\z"
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
CODE = r"^[A-Za-z]{1,3}\z"


def stripped(c: Column) -> Column:
    return F.translate(c, ",$ ", "")


def pass1_type(c: Column, years: bool = True) -> Column:
    """year, measure, date, currency, percentage, zip_code, iso_date or null. Stripping $ and , makes most currencies measures."""
    t = F.trim(c)
    year = t.rlike(YEAR) & F.coalesce(t.try_cast("int").between(1900, 2099), F.lit(False)) & F.lit(years)
    return (
        F.when(year, "year").when(is_number(stripped(c)), "measure").when(try_day(c).isNotNull(), "date").when(c.rlike(CURRENCY), "currency")
        .when(c.rlike(PERCENTAGE), "percentage").when(c.rlike(ZIP_CODE), "zip_code").when(c.rlike(ISO_DATE), "iso_date")
    )


def structural_type(c: Column, weight: Column, style_rank: Column) -> Column:
    """The ladder without years, then structural_bold and structural_rare."""
    return F.coalesce(pass1_type(c, years=False), F.when(weight == "bold", "structural_bold").when(style_rank >= 3, "structural_rare"))


def pattern(c: Column) -> Column:
    """Sieve patterns of single cells."""
    t = F.trim(c)
    return (
        F.when(t.rlike(MONEY), "currency").when(t.rlike(PERCENTAGE), "percentage").when(t.rlike(EMAIL), "email").when(t.rlike(UUID), "uuid")
        .when(t.rlike(ISO_DATE + r"\z"), "iso_date").when(t.rlike(ZIP_CODE), "zip").when(t.rlike(r"^-?\d+\z"), "integer").when(t.rlike(r"^-?[\d,]*\.?\d+\z"), "number").when(t.rlike(PHONE), "phone")
    )


def sieve_role(c: Column, before_data: Column, weight: Column) -> Column:
    """header, label, a pattern, numeric, date, code or text."""
    return (
        F.when(before_data, "header").when(weight == "bold", "label").when(pattern(c).isNotNull(), pattern(c)).when(is_number(stripped(c)), "numeric")
        .when(try_day(c).isNotNull(), "date").when(F.trim(c).rlike(CODE), "code").otherwise("text")
    )


def sieve_role_with_domain(c: Column, before_data: Column, weight: Column, domain: Column) -> Column:
    """The same with domain:x before label, where domain is the one that contains all of the cell's tokens."""
    return (
        F.when(before_data, "header").when(pattern(c).isNotNull(), pattern(c)).when(is_number(stripped(c)), "numeric").when(try_day(c).isNotNull(), "date")
        .when(domain.isNotNull(), F.concat(F.lit("domain:"), domain)).when(weight == "bold", "label").when(F.trim(c).rlike(CODE), "code").otherwise("text")
    )


def masked_role(c: Column, page_role: Column, weight: Column, leftmost: Column, row_typed: Column) -> Column:
    """Round one of masking: a page role, else a type, else the kind of label."""
    label = F.when((weight == "bold") & leftmost & (row_typed == 0), "section_label").when((weight == "bold") & leftmost, "total_label").when(leftmost & (row_typed > 0), "row_label")
    return F.coalesce(page_role, pass1_type(c, years=False), label)


def overlay_domain(c: Column) -> Column:
    """Kinds used by the annotation overlay."""
    t = F.trim(c)
    return (
        F.when(t.rlike(r"^(19|20)\d{2}\z"), "year").when(t.rlike(r"^\d{2}-\d{7}\z"), "ein").when(t.rlike(CURRENCY), "currency").when(t.rlike(r"^-?[\d,]+\.\d+\z"), "number")
        .when(t.rlike(r"^\d{1,2}[a-z]\z"), "lineref").when(t.rlike(r"^-?[\d,]+\z"), "integer").otherwise("text")
    )


def char_classes(c: Column) -> list[Column]:
    return [F.length(F.regexp_replace(c, "[^0-9]", "")).alias("n_digits"), F.length(F.regexp_replace(c, "[^A-Za-z]", "")).alias("n_letters"), F.length(c).alias("n_chars")]


def clean_token(c: Column) -> Column:
    """Whether a token is 4 to 30 long, no number, does not start with a digit or punctuation and is over 80 % letters."""
    letters = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    return F.length(c).between(4, 30) & try_number(c).isNull() & ~c.rlike(r"^[0-9\p{Punct}]") & (letters > 0.8 * F.length(c))


def role_distribution(df: DataFrame, by: list[str], role: str = "role") -> DataFrame:
    """Count and percentage to one decimal of each role."""
    n = df.groupBy(*by, role).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(Window.partitionBy())
    return n.withColumn("pct", F.round(F.col("n") * 100.0 / total, 1))
