"""Two offices side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.functions.labels import recode_nullable
from trendloom.operators.profile import year_axis
from trendloom.operators.trends import linear_trend
from trendloom.schemas import FIRST_YEAR, LAST_YEAR, TECH_COMPARISON

OFFICES = ["USPTO", "EPO"]


def _offices(spark) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, OFFICES))).alias("office"))


def yearly_comparison(labelled: DataFrame) -> DataFrame:
    """Per year and office: genuine rows, share of applied ones and its linear trend.

    ``labelled`` holds the genuine rows of both offices, told apart by ``office``; both are
    counted in a single grouped pass.
    """
    rows = labelled.where(F.col("year").between(FIRST_YEAR, LAST_YEAR))
    counts = rows.groupBy("office", "year").agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(F.col("innovation_orientation") == "applied") * 100 / F.count(F.lit(1))).alias("applied_share"),
    )
    dense = year_axis(_offices(labelled.sparkSession)).join(counts, ["office", "year"], "left").na.fill(0, ["n"])
    return linear_trend(dense, "applied_share", "office")


def side_by_side(yearly: DataFrame) -> DataFrame:
    """The same with one column set per office."""
    values = ["n", "applied_share", "fitted"]
    picks = [
        F.max(F.when(F.col("office") == office, F.col(v))).alias(f"{office.lower()}_{v}")
        for office in OFFICES for v in values
    ]
    return yearly.groupBy("year").agg(*picks)


def technique_comparison(labelled: DataFrame) -> DataFrame:
    """Share of each compared technique among all genuine rows of its office."""
    grouped = labelled.select("office", recode_nullable(F.col("ai_technique"), TECH_COMPARISON).alias("technique"))
    counts = grouped.groupBy("office").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col("technique") == t).alias(t) for t in TECH_COMPARISON.values()],
    )
    long = counts.unpivot(["office", "rows"], list(TECH_COMPARISON.values()), "technique", "n")
    return long.select("office", "technique", "n", (F.col("n") * 100 / F.col("rows")).alias("share"))
