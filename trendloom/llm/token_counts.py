"""Token counts by a two-tier lookup of pre-token lengths.

Byte-level BPE merges never cross pre-tokens, so a text's count is the sum over its pre-tokens.
Lengths of the most frequent pre-tokens are worked out once and broadcast; every worker encodes
the others when it first meets them and remembers a bounded number. Pre-tokens are never shuffled:
the first pass sends at most ``KEEP`` counters per task, the second sends nothing.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trendloom.llm.common import worker_wide

#: Pre-tokens a task reports, and the size of the broadcast table.
KEEP, TABLE = 4_096, 50_000
#: Pre-tokens a worker counts or remembers at once; longer texts are cut to pieces of so many characters.
REMEMBER, PIECE = 300_000, 1_000_000

PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters classed alike by this module's expressions and the library's; texts with others go to the library whole.
ALIKE = regex.compile(r"[\x00-ԯ -⁯₠-₿　-鿿가-힣＀-￯]*+")
#: A pre-token always starts at a blank between a visible character and a letter.
SAFE_CUT = regex.compile(r"(?<=\S) (?=\p{L})")


def load(path: str) -> Tokenizer:
    def make() -> Tokenizer:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return worker_wide(("tokenizer", path), make)


#: The printable stand-ins of bytes that byte-level models are written in: printable Latin-1
#: characters stand for themselves, the other bytes take the code points from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_STAND_IN = {b: b for b in _PLAIN} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def lengths(tokenizer: Tokenizer, words: list[str]) -> list[int]:
    """Tokens of each pre-token, by the library's own merges."""
    merge = tokenizer.model.tokenize
    return [len(merge(w.encode().decode("latin-1").translate(_STAND_IN))) for w in words]


def pieces(text: str) -> Iterator[str]:
    """The text in pieces at whose ends pre-tokens end too."""
    at = 0
    while len(text) - at > PIECE:
        cut = SAFE_CUT.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Counting:
    """Counts tokens; ``frequent`` is the first tier, what it learns by itself the second."""

    def __init__(self, path: str, frequent: dict[str, int]):
        self.tokenizer, self.frequent, self.known = load(path), frequent, dict(frequent)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def part(self, text: str) -> int:
        total = 0
        for piece in pieces(text):
            words = PRE_TOKEN.findall(piece)
            new = list(set(words).difference(self.known))
            if len(self.known) > len(self.frequent) + REMEMBER:
                self.known = dict(self.frequent)
                new = list(set(words).difference(self.known))
            self.known.update(zip(new, lengths(self.tokenizer, new), strict=True))
            total += sum(map(self.known.__getitem__, words))
        return total

    def text(self, text: str) -> int:
        if not ALIKE.fullmatch(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(map(self.part, parts))


def _frequent_pre_tokens(docs: DataFrame) -> DataFrame:
    """The pre-tokens that tasks find most often; which ones they are affects speed only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for piece in pieces(text or ""):
                    found.update(PRE_TOKEN.findall(piece))
                    if len(found) > REMEMBER:
                        found = Counter(dict(found.most_common(REMEMBER // 3)))
        best = found.most_common(KEEP)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["word", "n"]
        )

    each = docs.select("text").mapInArrow(count, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(TABLE)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Columns ``doc_id, n_bytes, n_tokens, over_limit``, one row per document.

    Counts are those of the tokenizer file at ``path`` without begin or end tokens; special strings
    inside a text count as the library takes them. A missing text is empty and has no token.
    """
    words = [row.word for row in _frequent_pre_tokens(docs).collect()]
    frequent = dict(zip(words, lengths(load(path), words), strict=True))
    tier = docs.sparkSession.sparkContext.broadcast(frequent)
    run = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = worker_wide(("counting", path, run), lambda: Counting(path, tier.value))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [counting.text(t) for t in texts]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
