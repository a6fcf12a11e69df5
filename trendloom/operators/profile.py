"""Counts, shares and summaries over label tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.functions.labels import normalise_bool, recode
from trendloom.schemas import (
    FIRST_YEAR, HEATMAP_DOMAINS, HEATMAP_TECHS, LAST_YEAR, SUMMARY_DIMENSIONS, TECH_GROUPS,
    TECH_GROUPS_WITH_SPEECH, YEARS,
)


def typed_labels(df: DataFrame, *flags: str) -> DataFrame:
    """Turn textual flags into booleans once, at the edge."""
    return df.withColumns({f: normalise_bool(F.col(f)) for f in flags or ("is_genuine_ai",)})


def successes(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "success")


def genuine(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_genuine_ai"))


def non_genuine(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_genuine_ai"))


def with_tech_groups(df: DataFrame) -> DataFrame:
    return df.withColumn("tech_grouped", recode(F.col("ai_technique"), TECH_GROUPS)).withColumn(
        "tech_grouped2", recode(F.col("ai_technique"), TECH_GROUPS_WITH_SPEECH)
    )


def year_axis(groups: DataFrame) -> DataFrame:
    """One row per group and year of the period."""
    years = F.sequence(F.lit(FIRST_YEAR), F.lit(LAST_YEAR))
    return groups.withColumn("year", F.explode(years))


def count_by_year(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by, "year").agg(F.count(F.lit(1)).alias("n"))


def count_by_year_dense(df: DataFrame) -> DataFrame:
    """All years of the period, 0 where there is nothing."""
    axis = year_axis(df.sparkSession.range(1).drop("id"))
    counts = count_by_year(df.where(F.col("year").between(FIRST_YEAR, LAST_YEAR)))
    return axis.join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def value_counts_topk(df: DataFrame, column: str, k: int) -> DataFrame:
    """Most frequent values; ties go to the smaller value."""
    return value_counts(df, column).orderBy(F.desc("n"), column).limit(k)


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str], rest: str = "not_listed") -> DataFrame:
    """Counts as a matrix with one column per listed value and one for all others, absent cells 0."""
    value = F.when(F.col(column).isin(list(values)), F.col(column)).otherwise(rest)
    table = df.where(F.col(column).isNotNull()).select(row, value.alias(column)).groupBy(row).pivot(column, [*values, rest])
    return table.agg(F.count(F.lit(1))).na.fill(0)


def crosstab_long(df: DataFrame, row: str, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))


def row_share(counts: DataFrame, row: str) -> DataFrame:
    """Cell / row total * 100; the denominator holds non-null categories only.

    The window runs over aggregated cells, one row per pair of labels.
    """
    total = F.sum("n").over(Window.partitionBy(row))
    return counts.withColumn("share", F.col("n") * 100 / total)


def fixed_crosstab(df: DataFrame) -> DataFrame:
    """Technique x domain over the fixed lists, in list order, absent cells 0, with row shares."""
    cells = df.where(F.col("tech_grouped2").isin(HEATMAP_TECHS) & F.col("application_domain").isin(HEATMAP_DOMAINS))
    counts = cells.groupBy("tech_grouped2", "application_domain").agg(F.count(F.lit(1)).alias("n"))
    one = df.sparkSession.range(1)
    grid = one.select(F.posexplode(F.array(*map(F.lit, HEATMAP_TECHS))).alias("row_pos", "tech_grouped2")).select(
        "*", F.posexplode(F.array(*map(F.lit, HEATMAP_DOMAINS))).alias("col_pos", "application_domain")
    )
    full = grid.join(counts, ["tech_grouped2", "application_domain"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("tech_grouped2"))
    return full.withColumn("share", F.col("n") * 100 / F.nullif(total, F.lit(0)))


def share_of_total(df: DataFrame, column: str) -> DataFrame:
    """Value count / all rows * 100: rows without a value stay in the denominator."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.count(column).alias("present"))
    # The total is a number of its own; counts stay where they are. It takes both counts, and rows
    # without a value go by a count, so that it is made from the same shuffle.
    total = counts.agg(F.sum(F.greatest("n", "present"))).scalar()
    return counts.where("present > 0").select(column, "n", (F.col("n") * 100 / total).alias("share"))


def conditional_share_by_year(df: DataFrame, condition: Column, *by: str) -> DataFrame:
    """Share of rows meeting the condition among all rows of a year; NULL for an empty year.

    A group's few yearly shares are gathered in a map and spread over the axis, so the input is
    scanned once.
    """
    rows = df.where(F.col("year").between(FIRST_YEAR, LAST_YEAR))
    rates = rows.groupBy(*by, "year").agg(
        (F.count_if(condition) * 100 / F.count(F.lit(1))).alias("share")
    )
    per_group = rates.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("year", "share"))).alias("shares"))
    return year_axis(per_group).select(*by, "year", F.try_element_at("shares", F.col("year")).alias("share"))


def coverage_report(df: DataFrame, *flags: str) -> DataFrame:
    """Per flag: rows where it holds, all rows and the percentage."""
    sums = df.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(f)).alias(f) for f in flags]
    )
    long = sums.unpivot("total", list(flags), "flag", "n_true")
    return long.select("flag", "n_true", "total", (F.col("n_true") * 100 / F.nullif("total", F.lit(0))).alias("pct"))


def round_half_even(c: Column, digits: int) -> Column:
    return F.rint(c * 10**digits) / 10**digits


def coverage_by_year(df: DataFrame, flag: str) -> DataFrame:
    table = df.groupBy("year").agg(F.count_if(F.col(flag)).alias("n_with"), F.count(F.lit(1)).alias("total"))
    return table.withColumn("pct", round_half_even(F.col("n_with") / F.col("total") * 100, 1))


def label_summary(df: DataFrame) -> DataFrame:
    """Totals and rates of a labelling run in one pass."""
    ok = F.col("status") == "success"
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("success"),
        F.count_if(ok & F.col("is_genuine_ai")).alias("genuine"),
        F.count_if(ok & ~F.col("is_genuine_ai")).alias("non_genuine"),
    )
    of_success = F.nullif(F.col("success"), F.lit(0))
    return counts.select(
        "*",
        (F.col("success") * 100 / F.nullif("total", F.lit(0))).alias("success_pct"),
        (F.col("genuine") * 100 / of_success).alias("genuine_pct"),
        (F.col("non_genuine") * 100 / of_success).alias("non_genuine_pct"),
    )


def all_dimension_profile(df: DataFrame, k: int = 10, dimensions: Sequence[str] = SUMMARY_DIMENSIONS) -> DataFrame:
    """Most frequent values of every label column in one scan and one shuffle of counts."""
    counts = (
        df.select(*dimensions).unpivot([], list(dimensions), "dimension", "value")
        .where(F.col("value").isNotNull())
        .groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    # Ranks aggregated rows only, so a frequent label is one row here.
    by = Window.partitionBy("dimension").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def summary_report(
    df: DataFrame, k: int = 10, dimensions: Sequence[str] = SUMMARY_DIMENSIONS,
    cut: Sequence[str] = ("ai_technique", "application_domain"),
) -> DataFrame:
    """The block report as one table: (section, rank, value, n, pct).

    The dimensions in ``cut`` list their k most frequent values, the others all. Years are ranked
    by their distance from the start of the period and all listed, also those outside it.

    Every row contributes its entries to all blocks at once; they are counted in one scan and
    one shuffle, and only the counts are ranked.
    """
    ok = F.col("status") == "success"
    kept = ok & F.col("is_genuine_ai")
    lines = {"classified": F.lit(True), "successful": ok, "genuine": kept, "non_genuine": ok & ~F.col("is_genuine_ai")}
    entries = [F.struct(F.lit("totals").alias("section"), F.when(hit, name).alias("value")) for name, hit in lines.items()]
    entries += [F.struct(F.lit(d).alias("section"), F.when(kept, F.col(d)).alias("value")) for d in dimensions]
    entries.append(F.struct(F.lit("year").alias("section"), F.when(kept, F.col("year").cast("string")).alias("value")))
    counts = (
        df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where(F.col("value").isNotNull())
        .groupBy("section", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    section = Window.partitionBy("section")
    place = F.row_number().over(section.orderBy(F.desc("n"), "value"))
    rank = (
        F.when(F.col("section") == "totals", F.array_position(F.array(*map(F.lit, lines)), F.col("value")).cast("int"))
        .when(F.col("section") == "year", F.col("year_number") - (FIRST_YEAR - 1))
        .otherwise(place)
    )

    def line(name: str) -> Column:
        return F.max(F.when(F.col("value") == name, F.col("n"))).over(section)

    base = F.when(F.col("value").isin("classified", "successful"), line("classified")).otherwise(line("successful"))
    pct = F.when(F.col("section") == "totals", F.col("n") * 100 / base)
    numbered = counts.withColumn("year_number", F.when(F.col("section") == "year", F.col("value")).cast("int"))
    report = numbered.select("section", rank.alias("rank"), "value", "n", pct.alias("pct"))
    return report.where(~F.col("section").isin(list(cut)) | (F.col("rank") <= k))


def missing_count(df: DataFrame, *columns: str) -> DataFrame:
    counts = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot("total", list(columns), "column", "n_missing").select("column", "n_missing", "total")


def country_breakdown(df: DataFrame, country: str, k: int = 15) -> DataFrame:
    """Per country: total, share of all rows with a country, slope of its yearly counts.

    Years without a row of the country are left out of the slope, not counted as 0.
    """
    per_year = count_by_year(df.where(F.col(country).isNotNull()), country)
    table = per_year.groupBy(country).agg(F.sum("n").alias("total"), F.regr_slope("n", "year").alias("slope"))
    # One row per country; the best k are chosen after the window, from which the total comes.
    grand = F.sum("total").over(Window.partitionBy(F.lit(0)))
    return table.withColumn("share", F.col("total") * 100 / grand).orderBy(F.desc("total"), country).limit(k)


def country_year_matrix(df: DataFrame, country: str, countries: Sequence[str]) -> DataFrame:
    """Countries x years of the period, absent cells 0."""
    rows = df.where(F.col(country).isin(list(countries)))
    counts = rows.groupBy(country).pivot("year", YEARS).agg(F.count(F.lit(1))).na.fill(0)
    return counts.select(country, *[F.col(str(y)).alias(f"y{y}") for y in YEARS])


def recoded(df: DataFrame, column: str, mapping: Mapping[str, str], name: str) -> DataFrame:
    return df.withColumn(name, recode(F.col(column), mapping))
