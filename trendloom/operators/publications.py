"""Candidate selection from nested publication records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.functions import arrays as A
from trendloom.schemas import CPC_CANDIDATE, CPC_COUNTRY, FIRST_YEAR, LAST_YEAR


def european_candidates(publications: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """EP records of the years ``first`` to ``last`` with an English abstract and a matching code, no US first priority.

    The country and date tests come first and are plain column predicates, so Parquet skips row
    groups by them; the array tests run inside the scan stage, with no explode and no shuffle.
    """
    hits = publications.where(
        (F.col("country_code") == "EP")
        & A.published_in(F.col("publication_date"), first, last)
        & A.year_of_date(F.col("publication_date")).between(first, last)
        & A.has_long_text(F.col("abstract_localized"))
        & A.has_code(F.col("cpc"), CPC_CANDIDATE)
    )
    out = hits.select(
        F.col("publication_number").alias("ep_id"),
        A.year_of_date(F.col("publication_date")).alias("year"),
        A.pick_localized(F.col("title_localized")).alias("title"),
        A.pick_localized(F.col("abstract_localized"), require_text=True).alias("abstract"),
        A.earliest_priority_country(F.col("priority_claim")).alias("priority_country"),
        A.first_code(A.collect_codes(F.col("cpc")), CPC_CANDIDATE).alias("cpc"),
    )
    # A NULL priority country fails the comparison and is dropped, as intended.
    return out.where((F.col("priority_country") != "US") & F.col("abstract").isNotNull())


def ordered_candidates(publications: DataFrame) -> DataFrame:
    return european_candidates(publications).orderBy("year", "ep_id")


def applicant_countries(publications: DataFrame) -> DataFrame:
    """First applicant and inventor country of EP records under the wider code list.

    Unlike the candidate query a record without priorities passes.
    """
    year = A.year_of_number(F.col("publication_date"))
    hits = publications.where(
        F.col("publication_number").startswith("EP")
        & year.between(FIRST_YEAR, LAST_YEAR)
        & A.published_in(F.col("publication_date"), FIRST_YEAR, LAST_YEAR + 1)
        & A.has_long_text(F.col("abstract_localized"))
        & A.has_code(F.col("cpc"), CPC_COUNTRY)
        & A.no_us_priority(F.col("priority_claim"))
    )
    return hits.select(
        F.col("publication_number").alias("ep_id"),
        year.alias("year"),
        A.first_country(F.col("assignee_harmonized")).alias("applicant_country"),
        A.first_country(F.col("inventor_harmonized")).alias("inventor_country"),
    )
