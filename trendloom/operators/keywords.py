"""Keyword families in free text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.schemas import EMERGING_FAMILIES

# Unicode word classes, and only a newline ends a line.
FLAGS = "(?Ud)"


def keyword_match(text: Column, pattern: str) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(FLAGS + pattern)


def keyword_flags(df: DataFrame, text: str, families: Mapping[str, str] = EMERGING_FAMILIES) -> DataFrame:
    return df.withColumns({name: keyword_match(F.col(text), p) for name, p in families.items()})


def emergence_rate(df: DataFrame, text: str, families: Mapping[str, str] = EMERGING_FAMILIES) -> DataFrame:
    """Hits per family and year, and per 1,000 rows of the year, in one pass over the text."""
    counts = df.groupBy("year").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(keyword_match(F.col(text), p)).alias(name) for name, p in families.items()],
    )
    long = counts.unpivot(["year", "rows"], list(families), "family", "hits")
    return long.select("family", "year", "hits", (F.col("hits") * 1000 / F.col("rows")).alias("per_thousand"))
