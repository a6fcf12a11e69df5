"""Substring dedup by sliding sentence spans.

A text is cut at line breaks and behind ``ENDS``: full stops, and also the marks that set clauses
apart, because a passage pasted into a sentence shares clauses with its other copies rather than
whole sentences. Every run of ``WIDTH`` consecutive pieces is hashed, and hashes are joined over all
documents. The first place of a span (by document, then place) stays; pieces covered by any other
place of a repeated span go, if the whole covered stretch has ``MIN_WORDS`` words or more. A text of
fewer pieces is one span.

Spans met once are told by a pair of Bloom filters (``bloom``), so only the hashes of spans that may
repeat are shuffled. A span that a third of all documents share is reduced map-side to its first
place, and joined back in parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.llm import bloom
from trendloom.llm.common import settle

WIDTH, MIN_WORDS, ENDS = 3, 35, ".!?,;:"
#: A span at more places than this is joined in parts of this size.
HOT_ROWS = 100_000

_BLANKS = rb"[\x20\x09-\x0D]+"


def cutter(ends: str = ENDS) -> re.Pattern[bytes]:
    return re.compile(rb"(?<=[" + re.escape(ends).encode() + rb"])" + _BLANKS + rb"|\n")


def pieces(text: bytes, cut: re.Pattern[bytes]) -> list[bytes]:
    """The sentences, trimmed, without empty ones."""
    return [p for p in (x.strip(b" \t\n\x0b\x0c\r") for x in cut.split(text)) if p]


def span_keys(text: bytes, width: int, cut: re.Pattern[bytes]) -> list[bytes]:
    """A 16-byte hash for every span, by its place."""
    codes = [xxhash.xxh3_128_digest(p) for p in pieces(text, cut)]
    return [xxhash.xxh3_128_digest(b"".join(codes[i : i + width])) for i in range(max(1, len(codes) - width + 1))] if codes else []


def covered(places: list[int], parts: list[bytes], width: int, min_words: int) -> list[int]:
    """The pieces under the spans at ``places``, without stretches of too few words."""
    under = sorted({j for i in places for j in range(i, min(i + width, len(parts)))})
    out: list[int] = []
    start = 0
    for k in range(1, len(under) + 1):
        if k == len(under) or under[k] > under[k - 1] + 1:
            stretch = under[start:k]
            if sum(len(parts[j].split()) for j in stretch) >= min_words:
                out += stretch
            start = k
    return out


def repeated_places(docs: DataFrame, width: int = WIDTH, ends: str = ENDS) -> DataFrame:
    """Columns ``id, of, places``: where a document's spans repeat an earlier place."""
    cut = cutter(ends)
    keys = lambda text: span_keys(text, width, cut)
    texts = docs.where(F.octet_length("text") > 0).select(
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("of"), F.col("text").cast("binary").alias("text")
    )
    # A piece has some 24 bytes; a wrong guess costs filter space or suspects, never a span.
    bits = bloom.bits_for((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 24)
    found = settle(bloom.held(texts, keys, bloom.twice_filter(texts, keys, bits, "span"), bits), "span-suspects")
    place = F.struct("id", "of", "at")
    counted = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    later = bloom.by_parts(found, counted.where("first != last").drop("last"), "of", HOT_ROWS, "span").where(place != F.col("first"))
    return later.groupBy("id", "of").agg(F.collect_set("at").alias("places"))


def _removed(width: int, min_words: int, cut: re.Pattern[bytes]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            # The text is taken from the row, so that it is shuffled and sent once.
            for value, places in zip(batch.column(0).field("text"), batch.column(1).to_pylist(), strict=True):
                text = (value.as_py() or "").encode()
                parts = pieces(text, cut)
                lost = covered(places, parts, width, min_words) if places else []
                n.append(len(parts))
                gone.append(lost)
                left = set(range(len(parts))).difference(lost)
                kept.append(b" ".join(p for j, p in enumerate(parts) if j in left) if lost else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(gone, pa.list_(pa.int32())), pa.array(kept, pa.binary()).cast(pa.string())],
                ["row", "n_sentences", "removed", "kept_text"],
            )

    return work


def remove_repeated_spans(docs: DataFrame, width: int = WIDTH, min_words: int = MIN_WORDS, ends: str = ENDS) -> DataFrame:
    """Columns ``row`` (the input row), ``n_sentences``, ``removed`` (places of sentences removed,
    from 0, sorted) and ``kept_text``.

    A text that loses nothing stays as it is; of another, the sentences left are joined by single
    blanks. Rows equal in ``doc_id`` and text are one document and share its verdict; a missing
    ``doc_id`` comes before all others; missing and empty texts have no span. Spans are told apart
    by 128-bit hashes.
    """
    d = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("of")).alias("d")
    g = repeated_places(docs, width, ends).alias("g")
    rows = d.join(g, F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.of") == F.col("g.of")), "left").select("row", "places")
    kinds = {"n_sentences": T.IntegerType(), "removed": T.ArrayType(T.IntegerType()), "kept_text": T.StringType()}
    schema = T.StructType([rows.schema["row"], *[T.StructField(n, k) for n, k in kinds.items()]])
    return rows.mapInArrow(_removed(width, min_words, cutter(ends)), schema)
