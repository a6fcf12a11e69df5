"""Keys met once and keys met twice, in a pair of Bloom filters that tasks fill and merge.

A task sets its keys' bits in two filters: keys it has met, and keys it has met again. Filters are
cut into panes; a pane's pairs are merged bit by bit (a bit of two tasks' first filters is a bit of
the second), so no key met twice anywhere is missed. The second filter is broadcast; keys that it
does not hold occur once.

Filters have ``BITS`` bits a key up to ``MAX_BITS`` in all, which bounds the broadcast. Beyond that
they fill up and hold more single keys (about 1.4 % of them at 16 bits a key, 40 % at two): callers
count what the filter holds, so their results never depend on its size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.llm.common import settle

BITS, MAX_BITS, PANE = 16, 1 << 30, 1 << 20
#: Keys a task collects before it hands over its filters' bits.
FLUSH = 1 << 19

#: From a text, its keys: 16-byte hashes, a key as often as it is met.
Keys = Callable[[bytes], list[bytes]]


def bits_for(n: int) -> int:
    """Size of a filter for ``n`` keys, in whole panes."""
    return min(MAX_BITS, PANE * max(1, -(-n * BITS // PANE)))


def places(keys: list[bytes], bits: int) -> np.ndarray:
    """Two bits a key, as an array of two columns."""
    halves = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    return halves % np.uint64(bits)


def _pack(at: np.ndarray) -> bytes:
    return zlib.compress(np.diff(np.unique(at), prepend=np.uint64(0)).astype("<u4").tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw), "<u4"), dtype=np.uint64)


def _by_pane(at: np.ndarray) -> dict[int, bytes]:
    at = np.unique(at)
    panes = at // np.uint64(PANE)
    cuts = np.flatnonzero(np.diff(panes)) + 1
    return {int(p[0]) // PANE: _pack(p % np.uint64(PANE)) for p in np.split(at, cuts) if len(p)}


def _marks(bits: int, keys_of: Keys):
    def flush(keys: list[bytes]) -> pa.RecordBatch:
        distinct, n = np.unique(np.frombuffer(b"".join(keys), "V16"), return_counts=True)
        own = places([distinct.tobytes()], bits)
        once, twice = _by_pane(own.ravel()), _by_pane(own[n > 1].ravel())
        panes = list(once)
        return pa.RecordBatch.from_arrays(
            [pa.array(panes, pa.int32()), pa.array([once[p] for p in panes], pa.binary()), pa.array([twice.get(p) for p in panes], pa.binary())],
            ["pane", "once", "twice"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[bytes] = []
        for batch in batches:
            for text in batch.column(0):
                keys.extend(keys_of(text.as_py()))
                if len(keys) >= FLUSH:
                    yield flush(keys)
                    keys = []
        if keys:
            yield flush(keys)

    return work


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second filter's panes, from rows sorted by pane."""

    def done(pane: int, twice: np.ndarray) -> pa.RecordBatch:
        raw = zlib.compress(np.packbits(twice).tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([pane], pa.int32()), pa.array([raw], pa.binary())], ["pane", "bits"])

    now, once, twice = None, np.zeros(0, bool), np.zeros(0, bool)
    for batch in batches:
        for pane, o, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if pane != now:
                if now is not None:
                    yield done(now, twice)
                now, once, twice = pane, np.zeros(PANE, bool), np.zeros(PANE, bool)
            at = _unpack(o)
            twice[at] |= once[at]
            once[at] = True
            if t is not None:
                twice[_unpack(t)] = True
    if now is not None:
        yield done(now, twice)


def twice_filter(texts: DataFrame, keys_of: Keys, bits: int, label: str) -> DataFrame:
    """Columns ``pane, bits``: packed panes of the filter of keys met twice, from ``text`` (binary)."""
    marks = texts.select("text").mapInArrow(_marks(bits, keys_of), "pane int, once binary, twice binary")
    return settle(marks.repartition("pane").sortWithinPartitions("pane").mapInArrow(_merge, "pane int, bits binary"), f"{label}-filter")


def held(texts: DataFrame, keys_of: Keys, panes: DataFrame, bits: int) -> DataFrame:
    """Columns ``key, at`` (place among the text's keys) beside all columns of ``texts`` but ``text``:
    the keys that the filter holds."""
    # At most MAX_BITS bits, whatever the size of the input.
    filled = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in panes.collect()])
    kept = [f for f in texts.schema if f.name != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.zeros(bits // 8, np.uint8)
        for pane, raw in filled.value:
            twice[pane * PANE // 8 : (pane + 1) * PANE // 8] = np.frombuffer(zlib.decompress(raw), np.uint8)
        for batch in batches:
            keys, sizes = [], []
            for text in batch.column("text"):
                own = keys_of(text.as_py())
                keys.extend(own)
                sizes.append(len(own))
            if keys:
                bit = places(keys, bits)
                hit = np.flatnonzero(((twice[bit >> np.uint64(3)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1))
                n = np.array(sizes, np.int64)
                of, at = np.repeat(np.arange(len(n)), n)[hit], (np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n))[hit]
                columns = [batch.column(f.name).take(pa.array(of)) for f in kept]
                columns += [pa.array([keys[i] for i in hit], pa.binary()), pa.array(at.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [*[f.name for f in kept], "key", "at"])

    return texts.mapInArrow(work, T.StructType([*kept, T.StructField("key", T.BinaryType()), T.StructField("at", T.IntegerType())]))


def by_parts(pairs: DataFrame, counted: DataFrame, spread: str, hot_rows: int, label: str) -> DataFrame:
    """``pairs`` joined by ``key`` with ``counted`` (a row per key, ``n`` the pairs it has).

    Keys with more than ``hot_rows`` pairs are joined in parts, by a hash of ``spread``.
    """
    rows = settle(counted.withColumn("parts", F.ceil(F.col("n") / hot_rows).cast("int")).drop("n"), f"{label}-keys")
    # At most one row for hot_rows pairs.
    hot = F.broadcast(rows.where("parts > 1").select("key", F.col("parts").alias("of_parts")))
    part = F.coalesce(F.pmod(F.xxhash64(spread), F.col("of_parts")).cast("int"), F.lit(0))
    dealt = pairs.join(hot, "key", "left").withColumn("part", part).drop("of_parts")
    again = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return dealt.join(again, ["key", "part"]).drop("part")
