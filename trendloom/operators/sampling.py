"""Seeded samples. A row's place is the hash of its id and the seed, so a sample does not
change with partitioning, reruns or lost executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.operators.reshape import top_n

SEED = 42


def draw_order(id_col: str, seed: int = SEED) -> list[Column]:
    return [F.md5(F.concat(F.col(id_col), F.lit(f":{seed}"))), F.col(id_col)]


def _allocations(df: DataFrame, size: int, stratum: str, counted: Column) -> DataFrame:
    """``df`` with ``alloc``, the sample size of a row's stratum.

    ``counted`` marks one row per stratum, the null one included; column ``_n`` holds the stratum's rows.
    Sizes are rounded half-even, then the surplus or shortfall is taken one by one from the largest
    strata, earliest first. The windows run over counts, or over what a sample left of every stratum.
    """
    everything = Window.partitionBy(F.lit(0))
    known = F.col(stratum).isNotNull()
    sized = df.withColumn("_all", F.sum(F.when(counted, F.col("_n"))).over(everything)).withColumn(
        "_rounded", F.when(known, F.rint(F.col("_n") / F.col("_all") * size).cast("bigint"))
    )
    largest = Window.partitionBy(F.lit(0)).orderBy(F.col("_rounded").desc_nulls_last(), stratum)
    gaps = sized.withColumn(
        "_gap", size - F.sum(F.when(counted, F.col("_rounded"))).over(everything)
    ).withColumn("_place", F.dense_rank().over(largest))
    step = F.when(F.col("_place") <= F.abs("_gap"), F.signum("_gap").cast("bigint")).otherwise(0)
    return gaps.where(known).withColumn("alloc", F.col("_rounded") + step).drop("_all", "_rounded", "_gap", "_place")


def proportional_alloc(df: DataFrame, size: int = 100, stratum: str = "year") -> DataFrame:
    """Sample sizes per stratum that add up to ``size``."""
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    return _allocations(counts, size, stratum, F.lit(True)).select(stratum, F.col("_n").alias("n"), "alloc")


def stratified_sample(
    df: DataFrame, id_col: str, size: int = 100, stratum: str = "year", seed: int = SEED
) -> DataFrame:
    """min(allocation, pool) rows of every stratum, drawn and counted in one scan."""
    # No allocation exceeds size + 1.
    pool = top_n(df, [stratum], draw_order(id_col, seed), size + 1, "_rank", "_pool")
    counted = pool.select(*df.columns, F.col("_rank").alias("rank"), F.col("_pool").alias("_n"))
    sized = _allocations(counted, size, stratum, F.col("rank") == 1)
    return sized.where(F.col("rank") <= F.col("alloc")).select(*df.columns, "rank")


def balanced_sample(
    df: DataFrame, id_col: str, by: Sequence[str] = ("year", "is_genuine_ai"), n: int = 4, seed: int = SEED
) -> DataFrame:
    rows = df
    for column in by:
        rows = rows.where(F.col(column).isNotNull())
    return top_n(rows, list(by), draw_order(id_col, seed), n)


# Rows per part of the preview sample and the pool each part needs.
PREVIEW_QUOTAS = [("fundamental", 5, 5), ("applied", 10, 10), ("both", 2, 2), ("non_genuine", 3, 0)]
PREVIEW_CAP = 20


def diverse_sample(df: DataFrame, id_col: str, seed: int = SEED) -> DataFrame:
    """Quota sample over orientations; the applied part takes one row per technique."""
    part = F.when(~F.col("is_genuine_ai"), "non_genuine").when(
        F.col("is_genuine_ai") & F.col("innovation_orientation").isin("fundamental", "applied", "both"),
        F.col("innovation_orientation"),
    )
    pool = df.withColumn("part", part).where(F.col("part").isNotNull())
    names = F.array(*[F.lit(name) for name, _, _ in PREVIEW_QUOTAS])
    position = F.array_position(names, F.col("part")).cast("int")
    take = F.element_at(F.array(*[F.lit(t) for _, t, _ in PREVIEW_QUOTAS]), position)
    needed = F.element_at(F.array(*[F.lit(m) for _, _, m in PREVIEW_QUOTAS]), position)

    # One scan: within the applied part a group is a technique and the smallest id comes first.
    applied = F.col("part") == "applied"
    grouped = pool.withColumn("_technique", F.when(applied, F.col("ai_technique")))
    drawn, by_id = draw_order(id_col, seed)
    most = max(t for _, t, _ in PREVIEW_QUOTAS)
    first = top_n(grouped, ["part", "_technique"], [F.when(~applied, drawn), by_id], most, "_rank", "_pool")
    # What is left: ten rows a part, and of the applied one ten a technique.
    in_part = Window.partitionBy("part")
    sized = first.withColumn("_rows", F.sum(F.when(F.col("_rank") == 1, F.col("_pool"))).over(in_part))
    ranked = sized.where(~applied | (F.col("_rank") == 1)).withColumn(
        "rank", F.row_number().over(in_part.orderBy(drawn, by_id))
    )
    chosen = ranked.where((F.col("rank") <= take) & (F.col("_rows") >= needed))
    return chosen.orderBy(position, "rank").limit(PREVIEW_CAP).select("part", "rank", *df.columns)


def review_sample(df: DataFrame, id_col: str, n: int = 10, seed: int = SEED) -> DataFrame:
    """Genuine rows first, then non-genuine ones with distinct reasons, n in all."""
    genuine = F.col("is_genuine_ai")
    part = F.when(genuine, 1).otherwise(2)
    grouped = df.where(genuine.isNotNull()).withColumn("part", part).withColumn(
        "_reason", F.when(~genuine, F.col("false_positive_reason"))
    )
    # One scan: the smallest ids of the genuine rows and of every reason.
    first = top_n(grouped, ["part", "_reason"], [id_col], n, "_rank").where(genuine | (F.col("_rank") == 1))
    drawn, by_id = draw_order(id_col, seed)
    return first.orderBy("part", F.when(~genuine, drawn), by_id).limit(n).select(*df.columns, "part")


def head_sample(df: DataFrame, id_col: str, n: int = 10) -> DataFrame:
    """The first rows having both texts."""
    return df.where(F.col("has_abstract") & F.col("has_claim")).orderBy(id_col).limit(n)
