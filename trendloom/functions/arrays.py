"""Expressions over the arrays of structs of a publication record.

Each stays inside its row, so no query explodes or joins an array. Where one field suffices it is
taken out first (``array["field"]``), which lets Parquet read that field alone; Spark does not
prune the fields used inside a lambda.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom.schemas import FIRST_YEAR, LAST_YEAR

MIN_ABSTRACT = 50


def pick_localized(texts: Column, language: str = "en", require_text: bool = False) -> Column:
    """Text of the first element in the language."""

    def wanted(x: Column) -> Column:
        hit = x["language"] == language
        return hit & x["text"].isNotNull() if require_text else hit

    return F.get(F.filter(texts, wanted), F.lit(0))["text"]


def earliest_priority_country(priorities: Column) -> Column:
    """Country prefix of the priority filed first; an undated priority sorts first."""
    dated = F.arrays_zip(priorities["filing_date"].alias("day"), priorities["publication_number"].alias("number"))
    return F.substring(F.array_min(dated)["number"], 1, 2)


def collect_codes(cpc: Column) -> Column:
    return cpc["code"]


def has_long_text(texts: Column, language: str = "en", longer_than: int = MIN_ABSTRACT) -> Column:
    return F.exists(texts, lambda x: (x["language"] == language) & (F.length(x["text"]) > longer_than))


def has_code(cpc: Column, pattern: str) -> Column:
    return F.exists(cpc["code"], lambda code: code.rlike(pattern))


def first_code(codes: Column, pattern: str) -> Column:
    return F.get(F.filter(codes, lambda c: c.rlike(pattern)), F.lit(0))


def no_us_priority(priorities: Column) -> Column:
    """True also when there is no priority at all, or its number is missing."""
    us = F.exists(priorities["application_number"], lambda number: number.startswith("US"))
    return F.coalesce(~us, F.lit(True))


def first_country(parties: Column) -> Column:
    return F.get(parties["country_code"], F.lit(0))


def year_of_date(yyyymmdd: Column) -> Column:
    """NULL for an impossible date."""
    return F.year(F.try_to_date(yyyymmdd.cast("string"), "yyyyMMdd"))


def year_of_number(yyyymmdd: Column) -> Column:
    return F.floor(yyyymmdd / 10000).cast("int")


def published_in(yyyymmdd: Column, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> Column:
    """Range on the stored number, which reaches the Parquet scan as a pushed filter."""
    return yyyymmdd.between(first * 10000 + 101, last * 10000 + 1231)
