"""Removal of long byte strings that occur more than once.

A byte goes if a string of ``length`` bytes covers it that also starts somewhere else, in the same
or another document; or, where first copies stay, that also starts at an earlier place. Strings do
not cross documents.

Sorting every suffix of the input by difference covers moves some hundred bytes for each byte of
text (see the README for figures), so this module compares the fixed-length prefixes only where
they can be equal, in three steps that each lose nothing:

1. *Sample.* The anchor of a string is the least-hashed ``GRAM``-byte gram among the starts of its
   first ``REACH`` positions. It depends on the string alone, so equal strings have equal anchors,
   and neighbouring strings mostly share theirs: a document falls into runs of strings with one
   anchor. All strings of an anchor hold a *core*, the
   ``length - REACH + 1`` bytes from the anchor on.
2. *Name.* Cores are hashed and counted over all documents. A run whose core occurs once holds no
   repeated string. If all runs of a core are equal from their first to their last byte, they are
   repeated as a whole.
3. *Compare.* Of the other runs, one copy of each is looked up in its text, and the strings of the
   copies are compared one by one; the first and last repeated string bound what goes.

A core, run or string shared by many documents is counted map-side; the joins back are equality
joins whose large partitions Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.llm.common import settle, whole_text

LENGTH, REACH, GRAM = 400, 72, 8
#: String starts handled at once; runs are cut there too, which the comparison settles.
PIECE = 1 << 20

_BASE = 0x5851F42D4C957F2D
_BYTES = np.random.default_rng(400).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


class Prefix:
    """Hashes of any part of a byte array, from one running sum."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * _power(_BASE, len(raw)), out=self.sums[1:])
        self.back = _power(pow(_BASE, -1, 2**64), len(raw) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.back[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def anchors_of(raw: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For every start of a string in ``raw``, the place of its anchor."""
    x = raw.astype(np.uint64)
    for step in (1, 2, 4):  # eight bytes in one number
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    # Hash above, place below: the least number is the least hash, the first of equal ones.
    least = ((x >> np.uint64(32)) << np.uint64(32)) | np.arange(len(x), dtype=np.uint64)
    width = 1
    while 2 * width <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < REACH:
        least = np.minimum(least[: len(least) - (REACH - width)], least[REACH - width :])
    return (least[: len(raw) - length + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs_of(raw: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays ``core, whole, low, more, ahead`` of the runs: hashes of the core and of all bytes
    of the run, its first start, the further starts, and the bytes before its anchor."""
    core = length - REACH + 1
    for at in range(0, len(raw) - length + 1, PIECE):
        part = raw[at : at + PIECE + length - 1]
        places, hashes = anchors_of(part, length), Prefix(part)
        cut = np.flatnonzero(np.diff(places)) + 1
        low, high = np.r_[0, cut], np.r_[cut, len(places)] - 1
        anchor = places[low]
        more, ahead = high - low, anchor - low
        shape = (more * REACH + ahead).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        yield hashes.of(anchor, anchor + core), hashes.of(low, high + length) + shape, low + at, more, ahead


RUNS = "core long, whole long, doc long, low int, more int"


def _runs(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, docs = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                for part in runs_of(raw, length) if len(raw) >= length else ():
                    found.append(part[:4])
                    docs.append(np.full(len(part[0]), doc, np.int64))
            if found:
                core, whole, low, more = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(np.concatenate(docs)),
                        pa.array(low.astype(np.int32)), pa.array(more.astype(np.int32)),
                    ],
                    ["core", "whole", "doc", "low", "more"],
                )

    return work


def _strings(length: int):
    """Every string of the runs asked for: ``core, whole, weight, at, string`` (its hash)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core, whole, weight, low, more, text = (c.to_pylist() for c in batch.columns)
            rows = []
            for k, t in enumerate(text):
                raw = np.frombuffer(t, np.uint8)
                starts = np.arange(more[k] + 1)
                rows.append(Prefix(raw).of(starts, starts + length).view(np.int64))
            sizes = np.array([len(r) for r in rows], np.int64)
            again = lambda x: pa.array(np.repeat(np.array(x, np.int64), sizes))
            at = np.concatenate([np.arange(n) for n in sizes]) if rows else np.zeros(0, np.int64)
            hashed = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [again(core), again(whole), again(weight), pa.array(at.astype(np.int32)), pa.array(hashed)], ["core", "whole", "weight", "at", "string"]
            )

    return work


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key: rows equal in id and text share it, and share their verdict."""
    text = whole_text()
    return docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", text).alias("doc"), text.alias("text"))


def repeated_parts(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """Columns ``doc, low, high``: byte ranges that repeated strings cover; they may overlap.

    With ``keep_first`` only ranges of strings that start at an earlier place too: in a document
    before, by ``doc_id``, or before in the same one.
    """
    if length < 2 * REACH:
        raise ValueError(f"strings of {length} bytes are too short, {2 * REACH} is the least")
    texts = _keyed(docs).select("doc", "text").where(F.octet_length("text") >= length)
    runs = texts.mapInArrow(_runs(length), RUNS)
    cores = runs.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b"))
    again = cores.where("n > 1").select("core", (F.col("a") != F.col("b")).alias("mixed"))
    shared = settle(runs.join(again, "core"), "suffix-runs")
    if keep_first:
        ids = docs.select(F.xxhash64("doc_id", whole_text()).alias("doc"), F.col("doc_id").alias("id")).groupBy("doc").agg(F.min("id").alias("id"))
        shared = settle(shared.join(ids, "doc"), "suffix-places")
    place = F.struct(*(["id"] if keep_first else []), "doc", "low")
    equal = shared.where("NOT mixed")
    if keep_first:
        kept = equal.groupBy("core").agg(F.min(place).alias("kept"))
        equal = equal.join(kept, "core").where(place != F.col("kept"))
    equal = equal.select("doc", "low", (F.col("low") + F.col("more") + length).alias("high"))
    mixed = shared.where("mixed").drop("mixed")
    # One copy of each run stands for all of them, with their number.
    copies = mixed.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct(place.alias("place"), "more")).alias("c"))
    asked = copies.select("core", "whole", "weight", "c.place", "c.place.doc", "c.place.low", "c.more")
    # Texts with equal keys are equal: any one will do.
    part = F.substring(F.col("text").cast("binary"), F.col("low") + 1, F.col("more") + length)
    looked_up = asked.join(texts.dropDuplicates(["doc"]), "doc")
    strings = looked_up.select("core", "whole", "weight", "low", "more", part.alias("text")).mapInArrow(
        _strings(length), "core long, whole long, weight long, at int, string long"
    )
    strings = settle(strings, "suffix-strings")
    if not keep_first:
        twice = strings.groupBy("core", "string").agg(F.sum("weight").alias("n")).where("n > 1").select("core", "string")
        bounds = strings.join(twice, ["core", "string"]).groupBy("core", "whole").agg(F.min("at").alias("first"), F.max("at").alias("last"))
        found = mixed.join(bounds, ["core", "whole"])
    else:
        # All but the first copy of a run go whole; of that one, strings that another run held before.
        heads = asked.select("core", "whole", "place")
        placed = strings.join(heads, ["core", "whole"])
        where = F.struct("place.id", "place.doc", (F.col("place.low") + F.col("at")).alias("low"))
        firsts = placed.groupBy("core", "string").agg(F.min(where).alias("kept"))
        later = placed.join(firsts, ["core", "string"]).where(where != F.col("kept"))
        bounds = later.groupBy("core", "whole").agg(F.min("at").alias("first"), F.max("at").alias("last"))
        judged = mixed.join(heads, ["core", "whole"]).join(bounds, ["core", "whole"], "left")
        head = place == F.col("place")
        ends = [F.when(head, F.col("first")).otherwise(0).alias("first"), F.when(head, F.col("last")).otherwise(F.col("more")).alias("last")]
        found = judged.where(~head | F.col("first").isNotNull()).select("doc", "low", *ends)
    return equal.union(found.select("doc", (F.col("low") + F.col("first")).alias("low"), (F.col("low") + F.col("last") + length).alias("high")))


def _cut(raw: bytes, low: list[int], high: list[int]) -> tuple[bytes, int]:
    """The bytes left and the number of maximal runs removed."""
    left, at, n = [], 0, 0
    for a, b in sorted(zip(low, high, strict=True)):
        if a > at or not n:
            left.append(raw[at:a])
            n += 1
        at = max(at, b)
    left.append(raw[at:])
    return b"".join(left), n


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, kept: tuple[str, ...] = ("kept", "kept_text")) -> DataFrame:
    """Columns ``row`` (the input row), ``n_bytes, n_removed, n_spans``, and those asked for of
    ``kept`` (binary) and ``kept_text``.

    Texts are judged as UTF-8 bytes, a missing text is empty, and a text shorter than ``length``
    loses nothing. Repeated rows repeat each other's strings and lose them all; with ``keep_first``
    they are one document. There, a missing ``doc_id`` comes first.
    """
    parts = repeated_parts(docs, length, keep_first).groupBy("doc").agg(F.collect_set(F.struct("low", "high")).alias("parts"))
    joined = _keyed(docs).select("row", "doc").join(settle(parts, "suffix-parts"), "doc", "left").select("row", "parts")
    kinds = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType()}
    kinds |= {c: {"kept": T.BinaryType(), "kept_text": T.StringType()}[c] for c in kept}
    schema = T.StructType([joined.schema["row"], *[T.StructField(n, k) for n, k in kinds.items()]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, spans, left = [], [], [], []
            # The text is taken from the row, so that it is shuffled and sent once.
            for text, own in zip(batch.column(0).field("text"), batch.column(1).to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                rest, n = _cut(raw, [p["low"] for p in own], [p["high"] for p in own]) if own else (raw, 0)
                sizes.append(len(raw))
                gone.append(len(raw) - len(rest))
                spans.append(n)
                left.append(rest)
            texts = {"kept": lambda x: pa.array(x, pa.binary()), "kept_text": lambda x: pa.array([r.decode("utf-8", "ignore") for r in x], pa.string())}
            columns = [batch.column(0), *[pa.array(x, pa.int64()) for x in (sizes, gone, spans)], *[texts[c](left) for c in kept]]
            yield pa.RecordBatch.from_arrays(columns, ["row", *kinds])

    return joined.mapInArrow(work, schema)


def cut_documents(docs: DataFrame, length: int = LENGTH, keep_first: bool = True) -> DataFrame:
    """The documents without their repeated strings, with the columns they came with.

    The first copy of a string stays, by ``doc_id`` and place, unless asked otherwise.
    ``n_chars``, where there is one, follows the text. Of a character that is cut through, the
    bytes left go too. A missing text stays missing; a document may end up empty.
    """
    left = remove_repeats(docs, length, keep_first, ("kept_text",))
    left = left.select("row", F.when(F.col("row.text").isNotNull(), F.col("kept_text")).alias("kept_text"))
    columns = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return left.select(*[columns.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def digests(docs: DataFrame) -> DataFrame:
    """Columns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row per document."""
    own = remove_repeats(docs.select("doc_id", "text"), kept=("kept",))
    return own.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
