"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are reduced to lower-case words joined by single blanks. An item of m
characters may be met with up to k = m // SHARE edits; cut into k + 1 pieces, at least one piece
must then occur unchanged. Items too short for an edit must stand between word borders, so that "cat" is not
found in "concatenate". All pieces are found in one pass over the text by an Aho-Corasick
automaton, and every place where a piece hits is verified with Myers' bit-parallel distance.

Documents are only scanned, never shuffled. Items are held in the automaton in blocks of bounded
size, one pass per block, so a large benchmark costs more passes, not more memory. Where documents
are dropped, what a pass leaves is written before the next.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import settle

#: One edit is allowed for so many characters of an item.
SHARE = 14
#: Characters of the items held at once.
BLOCK = 1_000_000

_GAPS = re.compile(r"[\W_]+")
FOUND = "doc_id long, item_id long, distance int, start int, end int"


def normal(text: str) -> str:
    return _GAPS.sub(" ", text.lower()).strip()


def best_match(pattern: str, masks: dict[str, int], text: str, most: int) -> tuple[int, int] | None:
    """Least distance of ``pattern`` to any part of ``text`` and the end of the first such part,
    if the distance is at most ``most``. One column of the table per character, as bits of
    two whole numbers."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus = down | (~(horizontal | up) & full)
        minus = up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up = minus | (~(vertical | plus) & full)
        down = plus & vertical
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Leaks:
    """The items of a block, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], share: int = SHARE):
        self.items, self.masks, self.automaton = [], [], ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            pattern = normal(text)
            if not pattern:
                continue
            m, k = len(pattern), len(pattern) // share
            masks: dict[str, int] = {}
            for i, c in enumerate(pattern):
                masks[c] = masks.get(c, 0) | 1 << i
            cuts = [m * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(pattern[a:b], []).append((len(self.items), a))
            self.items.append((item_id, pattern, k))
            self.masks.append(masks)
        for piece, at in pieces.items():
            self.automaton.add_word(piece, (len(piece), at))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best match of every item met, in the reduced text."""
        if not self.items:
            return []
        text = normal(text)
        starts: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for item, offset in places:
                starts.setdefault(item, set()).add(end + 1 - size - offset)
        found = []
        for item, places in starts.items():
            item_id, pattern, k = self.items[item]
            best = None
            if not k:
                whole = (p for p in sorted(places) if (p == 0 or text[p - 1] == " ") and text[p + len(pattern) : p + len(pattern) + 1] in ("", " "))
                if (at := next(whole, None)) is not None:
                    found.append((item_id, 0, at, at + len(pattern)))
                continue
            # Places within reach of each other are verified together.
            for low, high in _runs(sorted(places), 2 * k + 1):
                a, b = max(0, low - k), high + len(pattern) + k
                if text.startswith(pattern, max(low, 0)):
                    hit = (0, max(low, 0) - a + len(pattern))
                else:
                    hit = best_match(pattern, self.masks[item], text[a:b], k)
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], a + hit[1])
            if best:
                found.append((item_id, best[0], max(0, best[1] - len(pattern)), best[1]))
        return sorted(found)


def _runs(numbers: list[int], reach: int) -> Iterator[tuple[int, int]]:
    low = high = numbers[0]
    for n in numbers[1:]:
        if n - high > reach:
            yield low, high
            low = n
        high = n
    yield low, high


def blocks(items: DataFrame, block: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """The items, without missing texts, in lists of about ``block`` characters."""
    own = items.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = own.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // block)
    for k in range(n):
        part = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in part.collect()]


def find_leaks(docs: DataFrame, items: DataFrame, share: int = SHARE, block: int = BLOCK) -> DataFrame:
    """Columns ``doc_id, item_id, distance, start, end``: every item met in every document.

    ``start`` and ``end`` are places in the reduced text (``start`` as if no character were
    inserted or missing); of several matches the closest counts, then the first. Missing and
    empty texts and items meet nothing; equal items and repeated documents each give their rows.
    Items of fewer than ``share`` characters are met only unchanged and as whole words. Very long
    texts are searched whole.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def one_block(held) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leaks = Leaks(held.value, share)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = [(d, *x) for d, t in zip(ids, texts, strict=True) if t for x in leaks.find(t)]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "distance", "start", "end"]
                )

        return own.mapInArrow(work, FOUND)

    spark = docs.sparkSession
    parts = [one_block(spark.sparkContext.broadcast(b)) for b in blocks(items, block)]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], FOUND)


def drop_contaminated(docs: DataFrame, items: DataFrame, share: int = SHARE, block: int = BLOCK) -> DataFrame:
    """The documents that hold no item, with the columns they came with; nothing is shuffled."""

    def one_block(rows: DataFrame, held) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leaks = Leaks(held.value, share)
            for batch in batches:
                texts = batch.column("text").to_pylist()
                yield batch.filter(pa.array([not (t and leaks.find(t)) for t in texts], pa.bool_()))

        return rows.mapInArrow(work, rows.schema)

    left, passes = docs, 0
    for held in blocks(items, block):
        # Written between passes, so that a task never holds more than one automaton.
        left = one_block(settle(left, f"clean-{passes}") if passes else left, docs.sparkSession.sparkContext.broadcast(held))
        passes += 1
    return left
