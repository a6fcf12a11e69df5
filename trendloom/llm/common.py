"""Helpers shared by the operators of this package."""

from __future__ import annotations

import builtins
import gc
from collections.abc import Callable

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.session import scratch_dir

#: What separates words in Java's expressions; ``bytes.split()`` cuts at the same six bytes.
BLANKS = r"[\x20\x09-\x0D]+"


#: Objects that a worker holds for later tasks.
HELD = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is missing."""
    return F.coalesce(F.col(column), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a step's rows to the shared folder and go on from there.

    Lineage ends here, so a lost executor repeats no earlier step. The shuffle files of the steps
    before are let go: Spark deletes them once the driver has collected its references.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def worker_wide(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, once for all tasks of a Python worker.

    This package travels with every task, so its own globals are new in each; those of an installed
    module are not. The last few objects are held.
    """
    held = vars(builtins).setdefault("_trendloom_held", {})
    if key not in held:
        while len(held) >= HELD:
            held.pop(next(iter(held)))
        held[key] = make()
    return held[key]


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Rows that hold whole texts go to Python in smaller batches, unless the session says how many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, rows)


class Codes(dict):
    """64-bit codes of words, remembered up to a fixed number of words per Python worker."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()
