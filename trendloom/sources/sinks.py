"""Row unions and writers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_variant_rows(*parts: DataFrame) -> DataFrame:
    """Stack row sets with differing columns; absent ones are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def project_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The listed columns that exist, in list order."""
    return df.select(*[c for c in columns if c in df.columns])


def write_projected(df: DataFrame, columns: Sequence[str], path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = project_columns(df, columns).write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


# Rows of a table of publications lie in this order, in and across files.
PUBLICATION_ORDER = ["country_code", "publication_date", "publication_number"]


def land_publications(
    df: DataFrame, path: str, row_group_bytes: int = 32 << 20,
    build: Callable[[DataFrame], DataFrame] | None = None, order: Mapping[str, str] | None = None,
) -> None:
    """Store publication records so that a query on offices and dates reads its row groups only.

    Files are ranges of office, date and number, sorted inside; the number splits an office or a
    day that holds much of the table. There are ``spark.sql.shuffle.partitions`` ranges before empty
    and small ones are merged. Finding the ranges reads the source a second time, once per landing.

    Nested records are several times wider than the values they are made of. With ``build``, a row by
    row projection, ``df`` holds those values, from which ``order`` derives the three columns above;
    records are built where their row has come to lie, so that only ``df`` is shuffled and sorted.
    """
    derived = {c: F.expr(order[c]) if order else F.col(c) for c in PUBLICATION_ORDER}
    ranges = df.repartitionByRange(*derived.values()).withColumns(derived).sortWithinPartitions(*PUBLICATION_ORDER)
    records = build(ranges.select(*df.columns)) if build else ranges
    records.write.option("parquet.block.size", row_group_bytes).option("compression", "zstd").parquet(path)
