"""Line dedup with two Bloom filters.

A line's key is the line without blanks at both ends, A-Z lower-cased. Three passes over the texts:

1. *Mark.* Tasks fill a pair of Bloom filters, for keys met once and keys met in two documents, and
   merge them pane by pane (``bloom``).
2. *Suspect.* The second filter, of a fixed greatest size, is broadcast. Only keys that it holds
   are shuffled, as 16-byte hashes with their document, and counted exactly; keys found in
   ``min_docs`` documents or more lose their lines everywhere but in one document.
3. *Drop.* Documents meet the keys that they lose, and are split once more.

However full the filters are, the result is the same; the shuffle is at most 24 bytes a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.llm import bloom
from trendloom.llm.bloom import by_parts
from trendloom.llm.common import settle

MIN_CHARS, MIN_DOCS = 20, 3
#: A key in more documents than this is joined in parts of this size.
HOT_ROWS = 100_000

_BLANK = b" \t\n\x0b\x0c\r"


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """16-byte hash of the line's key, None for a key that is too short to count."""
    key = line.strip(_BLANK).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def keys_of(text: bytes, min_chars: int) -> set[bytes]:
    """The distinct keys of a text."""
    found = {key_of(line, min_chars) for line in text.split(b"\n")} if len(text) >= min_chars else set()
    found.discard(None)
    return found


def suspects(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Columns ``id, key``: the keys of every row that some two rows may share."""
    size = F.octet_length("text")
    lines = F.least(size - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.floor(size / (min_chars + 1)) + 1)
    long_enough = docs.where(size >= min_chars)
    bits = bloom.bits_for(long_enough.agg(F.sum(lines)).first()[0] or 0)
    texts = long_enough.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    keys = lambda text: list(keys_of(text, min_chars))
    return bloom.held(texts, keys, bloom.twice_filter(texts, keys, bits, "line"), bits).select("id", "key")


def lost_keys(found: DataFrame, min_docs: int = MIN_DOCS, keep: str = "last") -> DataFrame:
    """Columns ``id, keys``: what each document loses, from all suspects ``id, key``.

    Keys that a third of all documents share are counted map-side and joined in parts.
    """
    pairs = settle(found.groupBy("key", "id").agg(F.count(F.lit(1)).alias("n")).select("key", "id"), "line-suspects")
    best = F.max if keep == "last" else F.min
    counted = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), best(F.struct("id")).alias("kept")).where(F.col("n") >= min_docs)
    lost = by_parts(pairs, counted, "id", HOT_ROWS, "line").where(~F.col("id").eqNullSafe(F.col("kept.id")))
    return lost.groupBy("id").agg(F.collect_list("key").alias("keys"))


def _dropped(min_chars: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            # The text is taken from the row, so that it is shuffled and sent once.
            for value, keys in zip(batch.column(0).field("text"), batch.column(1).to_pylist(), strict=True):
                text = (value.as_py() or "").encode()
                lines = text.split(b"\n")
                lost = set(keys or ())
                left = [x for x in lines if key_of(x, min_chars) not in lost] if lost else lines
                total.append(len(lines))
                gone.append(len(lines) - len(left))
                kept.append(b"\n".join(left) if lost else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["row", "n_lines", "n_dropped", "kept_text"],
            )

    return work


def remove_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep: str = "last") -> DataFrame:
    """Columns ``row`` (the input row), ``n_lines``, ``n_dropped`` and ``kept_text``, a row per row.

    ``keep`` names the document whose lines stay: the ``last`` or ``first`` by ``doc_id``, all of
    its lines with that key. Rows of one ``doc_id`` are one document, those without an id together
    one that comes before all others. A missing or empty text is one empty line; keys shorter than
    ``min_chars`` code points never go. Keys are told apart by 128-bit hashes.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"keep is 'first' or 'last', not {keep!r}")
    lost = lost_keys(suspects(docs, min_chars), min_docs, keep)
    d = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id")).alias("d")
    rows = d.join(lost.alias("g"), F.col("d.id").eqNullSafe(F.col("g.id")), "left").select("row", "keys")
    kinds = {"n_lines": T.LongType(), "n_dropped": T.LongType(), "kept_text": T.StringType()}
    schema = T.StructType([rows.schema["row"], *[T.StructField(n, k) for n, k in kinds.items()]])
    return rows.mapInArrow(_dropped(min_chars), schema)


def digests(docs: DataFrame) -> DataFrame:
    """Columns ``doc_id, n_lines, n_dropped, kept_sha256``, one row per document."""
    own = remove_repeated_lines(docs.select("doc_id", "text"))
    return own.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
