"""Agreement between two raters, and checks of labels against the declared vocabulary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.schemas import VOCABULARY


def confusion(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Contingency table of two label columns; a row needs both labels."""
    rated = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return rated.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))


def cohen_kappa(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """(po - pe) / (1 - pe) for any number of classes."""
    return kappa_of_table(confusion(df, a, b, *by), a, b, *by)


def kappa_of_table(table: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """The same from contingency cells; a finer table than ``by`` is summed up.

    Each cell adds to the margins of its two classes, so one grouping of the small table gives
    them all.
    """
    none = F.lit(0).cast("bigint")
    same = F.when(F.col(a) == F.col(b), F.col("n")).otherwise(none)

    def margin(label: str, row: Column, col: Column, agree: Column) -> Column:
        return F.struct(F.col(label).alias("label"), row.alias("row"), col.alias("col"), agree.alias("agree"))

    margins = F.array(margin(a, F.col("n"), none, same), margin(b, none, F.col("n"), none))
    classes = (
        table.select(*by, F.explode(margins).alias("m")).select(*by, "m.*")
        .groupBy(*by, "label").agg(F.sum("row").alias("row"), F.sum("col").alias("col"), F.sum("agree").alias("agree"))
    )
    totals = classes.groupBy(*by).agg(
        F.sum("row").alias("n"),
        (F.sum("agree") / F.sum("row")).alias("po"),
        (F.sum(F.col("row").cast("double") * F.col("col")) / F.pow(F.sum("row").cast("double"), F.lit(2.0))).alias("pe"),
    )
    return totals.withColumn("kappa", (F.col("po") - F.col("pe")) / F.nullif(1 - F.col("pe"), F.lit(0.0)))


def recall_f1(df: DataFrame, reference: str, predicted: str, *by: str) -> DataFrame:
    """Recall, precision and F1 of a flag; which column is the reference must be named."""
    r, p = F.col(reference), F.col(predicted)
    rated = df.where(r.isNotNull() & p.isNotNull())
    counts = rated.groupBy(*by).agg(
        F.count_if(r & p).alias("tp"), F.count_if(r & ~p).alias("fn"), F.count_if(~r & p).alias("fp"),
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return top / F.nullif(bottom, F.lit(0))

    return counts.withColumns(
        {
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "f1": ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")),
        }
    )


def agreement_rate(
    df: DataFrame, flags: Sequence[str], pairs: Mapping[str, tuple[str, str]], present: Sequence[str] = ()
) -> DataFrame:
    """Share of equal values among rows all flags hold for, per named pair (NULL equals NULL).

    ``present`` names columns that must hold a value, e.g. the labels of an older run.
    """
    rows = df.dropna(subset=list(present)) if present else df
    for flag in flags:
        rows = rows.where(F.col(flag))
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(a).eqNullSafe(F.col(b))).alias(name) for name, (a, b) in pairs.items()],
    )
    long = counts.unpivot("n", list(pairs), "dimension", "agree")
    return long.select("dimension", "agree", "n", (F.col("agree") * 100 / F.nullif("n", F.lit(0))).alias("pct"))


def combine_batches(df: DataFrame, a: str, b: str, batch: str) -> DataFrame:
    """Agreement per batch, its mean weighted by rows, and the value over all rows pooled."""
    table = confusion(df, a, b, batch)
    per_batch = kappa_of_table(table, a, b, batch).select(F.col(batch).cast("string").alias("batch"), "n", "kappa")
    pooled = kappa_of_table(table, a, b).select(F.lit("pooled").alias("batch"), "n", "kappa")
    return per_batch.unionByName(weighted_mean(per_batch)).unionByName(pooled)


def weighted_mean(per_batch: DataFrame, value: str = "kappa") -> DataFrame:
    return per_batch.agg(
        F.lit("weighted").alias("batch"), F.sum("n").alias("n"),
        (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias(value),
    )


def schema_conformance(df: DataFrame, vocabulary: Mapping[str, Sequence[str]] = VOCABULARY) -> DataFrame:
    """Per dimension: rows, missing values and values outside the vocabulary, in one scan."""
    checks = []
    for name, allowed in vocabulary.items():
        value = F.col(name)
        checks.append(F.count_if(value.isNull()).alias(f"{name}_null"))
        checks.append(F.count_if(~value.isin(list(allowed))).alias(f"{name}_out"))
    counts = df.agg(F.count(F.lit(1)).alias("total"), *checks)
    per_dimension = F.array(
        *[
            F.struct(F.lit(n).alias("dimension"), F.col(f"{n}_null").alias("n_null"), F.col(f"{n}_out").alias("n_outside"))
            for n in vocabulary
        ]
    )
    return counts.select("total", F.explode(per_dimension).alias("d")).select("d.*", "total")


def null_rule_check(df: DataFrame, fields: Sequence[str], flag: str = "is_genuine_ai") -> DataFrame:
    """Non-genuine rows that still carry labels, per field and for any of them."""
    filled = [F.col(f).isNotNull() for f in fields]
    any_filled = filled[0]
    for column in filled[1:]:
        any_filled = any_filled | column
    counts = df.where(~F.col(flag)).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(c).alias(f) for f, c in zip(fields, filled)],
        F.count_if(any_filled).alias("any"),
    )
    return counts.unpivot("rows", [*fields, "any"], "field", "n_filled").select("field", "n_filled", "rows")
