"""Parallel reading of delimited files whose quoted fields hold line breaks.

Where a record starts depends on all quotes before it, so a file cannot simply be cut at line
breaks. It takes two passes over its slices (the splits Spark reads it in):

1. A line maps what it starts in (a record, or a quoted field left open) to what it ends in. Lines
   without quotes change nothing; the others' maps are put together per slice, and a running
   composition over the slices of a file says what each slice starts in. Only maps are shuffled.
2. All slices are read in parallel. Those that neither start nor end inside a record are taken line
   by line; in the others lines are joined to records as they come, and what a slice holds of a
   record that crosses its borders (at most two fragments) is put together afterwards.

A field is quoted if it starts with a quote; a quote inside it is doubled. That is what Spark's own
reader takes, whose rows these are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUOTE = '"'


def _ends_open(line: Column, sep: str, starts_open: bool) -> Column:
    """Whether a line ends inside a quoted field."""

    def after(open_: Column, field: Column) -> Column:
        odd = (F.length(field) - F.length(F.replace(field, F.lit(QUOTE), F.lit("")))) % 2 == 1
        return F.when(open_, ~odd).otherwise(F.startswith(field, F.lit(QUOTE)) & odd)

    return F.aggregate(F.split(line, re.escape(sep)), F.lit(starts_open), after)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    raw = spark.read.text(path, lineSep="\n")
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def slices(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """Columns ``file, start, open, plain``, a row per slice: whether it starts inside a quoted
    field, and whether every line of it is a record by itself."""
    line = F.col("value")
    mapped = _lines(spark, path).select(
        "file", "start", F.monotonically_increasing_id().alias("at"),
        F.when(F.contains(line, F.lit(QUOTE)), F.struct(_ends_open(line, sep, False).alias("a"), _ends_open(line, sep, True).alias("b"))).alias("m"),
    )
    changes = F.when(F.col("m.a") | ~F.col("m.b"), F.struct("at", "m.a", "m.b"))
    own = mapped.groupBy("file", "start").agg(F.sort_array(F.collect_list(changes)).alias("maps"), F.max("m.a").alias("opens"))
    step = lambda s, m: F.struct(F.when(s["a"], m["b"]).otherwise(m["a"]).alias("a"), F.when(s["b"], m["b"]).otherwise(m["a"]).alias("b"))
    whole = F.aggregate("maps", F.struct(F.lit(False).alias("a"), F.lit(True).alias("b")), step)
    composed = own.select("file", "start", whole.alias("w"), F.coalesce("opens", F.lit(False)).alias("opens"))
    # Behind the last slice that ends alike whatever it starts in, only slices that swap the two count.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("w.a") == F.col("w.b")
    swaps = F.sum((F.col("w.a") & ~F.col("w.b")).cast("int")).over(Window.partitionBy("file").orderBy("start"))
    known = F.last(F.when(fixed, F.struct(F.col("w.a").alias("end"), F.col("swaps"))), ignorenulls=True).over(before)
    counted = composed.withColumn("swaps", swaps).withColumn("known", known).withColumn("so_far", F.coalesce(F.max("swaps").over(before), F.lit(0)))
    odd = (F.col("so_far") - F.coalesce("known.swaps", F.lit(0))) % 2 == 1
    starts_open = F.coalesce("known.end", F.lit(False)) != odd
    # The first slice holds the header and is read as if it had open fields.
    plain = ~F.col("open") & ~F.col("opens") & (F.col("start") > 0)
    return counted.select("file", "start", starts_open.alias("open"), "opens").select("file", "start", "open", plain.alias("plain"))


def _joined(sep: str, header: bool):
    quote, cut = QUOTE.encode(), sep.encode()

    def ends_open(line: bytes, now: bool) -> bool:
        if quote in line:
            for field in line.split(cut):
                odd = field.count(quote) % 2 == 1
                now = not odd if now else field.startswith(quote) and odd
        return now

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records (``part`` null) and fragments (0 goes on from the slice before, 1 goes on behind)."""
        at, held, open_, part, first = None, [], False, None, False
        rows: list[tuple] = []

        def close(kind: int | None) -> None:
            if held:
                rows.append((*at, kind, b"\n".join(held)))
                held.clear()

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary()]
            out = pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["file", "start", "part", "record"]
            )
            rows.clear()
            return out

        for batch in batches:
            for file, start, starts_open, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, start) != at:
                    close(part if part is not None else 1 if open_ else None)
                    at, open_, first = (file, start), starts_open, header and start == 0
                    part = 0 if starts_open else None
                held.append(line)
                open_ = ends_open(line, open_)
                if not open_:
                    if first:
                        held.clear()
                    close(part)
                    part, first = None, False
            if rows:
                yield batch_of()
        close(part if part is not None else 1 if open_ else None)
        if rows:
            yield batch_of()

    return work


def quoted_records(spark: SparkSession, path: str | list[str], sep: str, header: bool = True) -> DataFrame:
    """Columns ``file_path, record``: the records of all files, without their headers.

    A field left open runs to the end of its file. Empty lines are no records.
    """
    # One row per slice, that is one per 128 MB of input by Spark's defaults.
    known = F.broadcast(slices(spark, path, sep))
    lines = _lines(spark, path).join(known, ["file", "start"])
    alone = lines.where("plain").select(F.col("file").alias("file_path"), F.col("value").alias("record"))
    mixed = lines.where("NOT plain").select("file", "start", "open", F.col("value").cast("binary").alias("line"))
    found = mixed.mapInArrow(_joined(sep, header), "file string, start long, part int, record binary")
    whole = found.where("part IS NULL").select(F.col("file").alias("file_path"), F.col("record").cast("string").alias("record"))
    # A fragment that goes on from before belongs to the last record left open.
    order = Window.partitionBy("file").orderBy("start", "part")
    opened = F.last(F.when(F.col("part") == 1, F.col("start")), ignorenulls=True).over(order)
    pieces = found.where("part IS NOT NULL").withColumn("opened", opened)
    parts = F.sort_array(F.collect_list(F.struct("start", F.col("record").cast("string").alias("record"))))
    crossing = pieces.groupBy("file", "opened").agg(parts.alias("parts")).select(
        F.col("file").alias("file_path"), F.array_join("parts.record", "\n").alias("record")
    )
    records = alone.union(whole).union(crossing)
    bare = F.when(F.endswith("record", F.lit("\r")), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    return records.withColumn("record", bare).where("record <> ''")
