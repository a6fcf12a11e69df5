"""Row selection and joins that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# A key with more rows than this is split into parts of about this many rows.
HOT_ROWS = 1_000_000
SLICES = 64


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ()) -> DataFrame:
    """One row per key, the first under ``order``; remaining columns settle ties.

    A minimum over structs combines map-side, so a task passes on one row per key, however many
    copies there are. Columns named in ``order`` stand first in the struct and are stored once.
    """
    named = [o for o in order if isinstance(o, str)]
    ranks = [F.col(o) if isinstance(o, str) else o.alias(f"_o{i}") for i, o in enumerate(order)]
    row = F.struct(*ranks, *[F.col(c) for c in df.columns if c not in keys and c not in named])
    first = df.groupBy(*keys).agg(F.min(row).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in df.columns])


# A task passes on what it holds, and starts anew, once it holds more than this.
HELD_ROWS = 100_000
HELD_BYTES = 1 << 26


def _cut_task(keys: Sequence[str], by: Sequence[str], n: int):
    """Arrow batches of a task to the first n rows per key under ``by``, and in ``_rows``, on
    one row of each key, how many rows it stands for. Memory is bounded: past ``HELD_ROWS`` or
    ``HELD_BYTES`` the rows are passed on, which leaves a key more rows than n, never fewer."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def shorten(table):
            order = pc.sort_indices(
                table, sort_keys=[(c, "ascending") for c in (*keys, *by)], null_placement="at_start"
            )
            table = table.take(order).combine_chunks()
            opens = np.zeros(len(table), dtype=bool)
            opens[:1] = True
            for c in keys:
                # A null differs from every value and equals a null.
                codes = table[c].dictionary_encode(null_encoding="encode").combine_chunks().indices.to_numpy()
                opens[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(opens)
            place = np.arange(len(table)) - np.repeat(starts, np.diff(np.append(starts, len(table))))
            rows = np.zeros(len(table), dtype=np.int64)
            rows[starts] = np.add.reduceat(table["_rows"].to_numpy(), starts)
            at = table.schema.get_field_index("_rows")
            return table.set_column(at, table.schema.field(at), pa.array(rows)).filter(pa.array(place < n))

        held, fresh = [], []
        for batch in batches:
            if batch.num_rows:
                fresh.append(pa.Table.from_batches([batch]))
            # Sorted anew only when as much has come as is held, so a row is sorted a few times.
            if sum(map(len, fresh)) > sum(map(len, held)) or sum(t.nbytes for t in fresh) > HELD_BYTES:
                held, fresh = [shorten(pa.concat_tables(held + fresh))], []
                if len(held[0]) > HELD_ROWS or held[0].nbytes > HELD_BYTES:
                    yield from held.pop().to_batches()
        if held or fresh:
            yield from shorten(pa.concat_tables(held + fresh)).to_batches()

    return cut


def top_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int, rank: str = "rank",
    pool: str | None = None,
) -> DataFrame:
    """The first n rows of every group, numbered in ``rank``, and in ``pool`` the group's size.

    One scan: every task keeps the n first rows of its groups while it reads, and counts all of
    them; slices made of several tasks cut again, and only their survivors are ranked together. Exact:
    a row among the first n of its group is among the first n of its task and of its slice. ``order``
    is ascending, nulls first, by columns or expressions of numbers, texts, dates or booleans; groups and
    order by floating-point numbers or nested values are an error, for tasks would place NaN differently.
    """
    named = {f"_by{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)}
    ranked = df.select("*", *[c.alias(name) for name, c in named.items()], F.lit(1).cast("bigint").alias("_rows"))
    for c in (*keys, *named):
        kind = ranked.schema[c].dataType
        if isinstance(kind, (T.FloatType, T.DoubleType, T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            raise TypeError(f"cannot group or order by {kind.simpleString()}")
    kept = ranked.mapInArrow(_cut_task(list(keys), list(named), n), ranked.schema)

    def again(rows: DataFrame, by: Sequence[str], place: str) -> DataFrame:
        group = Window.partitionBy(*(by or [F.lit(0)]))
        first = F.row_number().over(group.orderBy(*named)).alias(place)
        total = F.sum("_rows").over(group).alias("_total")
        others = [c for c in rows.columns if c not in ("_rows", place)]
        cut = rows.select(*[f"`{c}`" for c in others], first, total).where(F.col(place) <= n)
        return cut.withColumn("_rows", F.when(F.col(place) == 1, F.col("_total")).otherwise(0)).drop("_total")

    spread = kept.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(SLICES)))
    sliced = again(spread, [*keys, "_slice"], "_local").drop("_slice", "_local")
    everything = Window.partitionBy(*(keys or [F.lit(0)]))
    found = again(sliced, keys, rank)
    if pool:
        found = found.withColumn(pool, F.max("_rows").over(everything))
    return found.drop(*named, "_rows")


def hot_keys(df: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the parts to split them into: at most
    rows / hot_rows keys, hence small."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > hot_rows).select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts"))


def _salted(df: DataFrame, hot: DataFrame, on: Sequence[str]) -> DataFrame:
    """Spread the rows of hot keys. The salt depends on the row and its input split only, so a
    task run again after an executor loss gives every row the same salt. Of texts only the size
    is hashed: long ones would cost more to hash than to move."""
    size = {f.name: F.octet_length(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, T.StringType)}
    spread = F.xxhash64(*[size.get(c, F.col(f"`{c}`")) for c in df.columns], F.spark_partition_id())
    flagged = df.withColumn("_spread", spread).join(F.broadcast(hot), list(on), "left")
    salt = F.coalesce(F.pmod(F.col("_spread"), F.col("_parts")).cast("int"), F.lit(0))
    return flagged.withColumn("_salt", salt).drop("_spread", "_parts")


def _replicated(df: DataFrame, hot: DataFrame, on: Sequence[str]) -> DataFrame:
    salts = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    return df.join(F.broadcast(hot), list(on), "left").withColumn("_salt", F.explode(salts)).drop("_parts")


def lookup_join(
    left: DataFrame,
    on: Sequence[str],
    lookups: Sequence[tuple[DataFrame, Sequence[str | Column]]],
    how: str = "left",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Join lookup tables, each cut to its first row per key under the order given with it.

    Left rows are kept as often as they occur. Lookups are reduced before their hot keys are
    repeated. With ``hot_rows=None`` no keys are counted or split: the left side is read and
    shuffled once and every lookup once, which is right where the key is an id of the left side.
    """
    out, keys = left, list(on)
    if hot_rows:
        hot = hot_keys(left, on, hot_rows)
        out, keys = _salted(left, hot, on), [*on, "_salt"]
    for table, order in lookups:
        first = keep_first(table, on, order)
        out = out.join(_replicated(first, hot, on) if hot_rows else first, keys, how)
    return out.select(*left.columns, *[c for t, _ in lookups for c in t.columns if c not in on])


def membership_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """``left_semi`` / ``left_anti`` that splits hot left keys, unless ``hot_rows`` is None: then
    the left side is read once, and splitting is left to adaptive execution."""
    members = right.select(*on)
    if not hot_rows:
        return left.join(members, list(on), how).select(*left.columns)
    hot = hot_keys(left, on, hot_rows)
    members = _replicated(members.distinct(), hot, on)
    return _salted(left, hot, on).join(members, [*on, "_salt"], how).select(*left.columns)


# Bits in a table of keys, and how many of them a row of it holds, which is what Spark's bitmaps have.
KEY_BITS = 1 << 26
BITMAP_BITS = 8 * 4096


def split_by_keys(left: DataFrame, right: DataFrame, on: str, bits: int = KEY_BITS) -> tuple[DataFrame, DataFrame]:
    """``left`` in two parts: rows whose key may be among those of ``right``, and rows whose key is not.

    The second part need not be shuffled for a left join. A key of ``right`` sets one of ``bits`` bits
    (a multiple of ``BITMAP_BITS``), which are broadcast: 8 MB at most by default. Past as many keys the
    bits fill up, and more rows go into the first part; a row with a partner is always there.
    """
    bit = F.pmod(F.xxhash64(on), F.lit(bits))
    word, at = F.floor(bit / BITMAP_BITS).alias("_word"), F.pmod(bit, F.lit(BITMAP_BITS))
    known = right.where(F.col(on).isNotNull()).groupBy(word).agg(F.bitmap_construct_agg(at).alias("_bits"))
    byte = F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1)))
    hit = F.getbit(F.conv(byte, 16, 10).cast("int"), F.pmod(at, F.lit(8)).cast("int")) == 1
    flagged = left.withColumn("_word", word).join(F.broadcast(known), "_word", "left")
    flagged = flagged.withColumn("_known", F.col(on).isNotNull() & F.coalesce(hit, F.lit(False)))
    return tuple(flagged.where(F.col("_known") == side).select(*left.columns) for side in (True, False))
