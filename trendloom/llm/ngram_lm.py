"""Language-model scores from an Elias-Fano n-gram trie.

The trie has two levels, words and their successors, cut into files of bounded size in the shared
folder; tasks map them into memory, so what a worker holds does not grow with the corpus.

* Words: the sorted 64-bit hashes of the words of a shard (the upper bits of the hash), and the
  running sums of their counts, both as Elias-Fano lists.
* Successors: for every word of a shard a monotone pointer to its successors; the successors' numbers,
  made monotone over the whole file by adding the last one of the word before, also as an Elias-Fano
  list and searched relative to the context's range; and one byte per successor for its probability.
  Successors are dealt to several files by their number, so a frequent context fills no file alone.
* One byte per word for the weight that is left to unseen successors.

Probabilities are interpolated: ``P(w | v) = max(c(v, w) - D, 0) / c(v) + rest(v) * P(w)`` with
``P(w) = (c(w) + 1) / (N + V + 1)``. Pairs seen fewer than ``least`` times are left to the second
term; the registered query stores every pair (``least`` 1). Bytes hold the logarithm in steps of 1/32, rounded down, so that no distribution exceeds one.

Counts cover all training documents. Words and pairs are counted per group of texts before any
shuffle; a pair is counted only if both of its words occur ``least`` times, which no pair that does fails.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import Codes, settle, whole_text
from trendloom.llm.elias_fano import EliasFano, get, put
from trendloom.session import scratch_dir

#: Words and successors in a file; bytes of text handled at once.
WORDS, SUCCESSORS, GROUP = 500_000, 1_000_000, 3_000_000
DISCOUNT, LEAST, STEPS = 0.75, 2, 32
#: A word's number while rows are shuffled: its shard above, its place in the shard below.
SHARD_BIT = 40
#: The end of a text, no word of which holds a line break; it is also the context of the first word.
END = xxhash.xxh3_64_intdigest(b"\n")

#: Few enough words to stay in the processor's cache: more cost memory and time.
_codes = Codes(120_000)


def is_held_out(doc_id: Column) -> Column:
    """A seventh of the documents, by id; a missing id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(text: str) -> np.ndarray:
    """Hashes of the words and the end."""
    words = text.encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Rows of about GROUP bytes: the rows without the text, all tokens, tokens per row."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        others = list(zip(*[c.to_pylist() for c in batch.drop_columns(["text"]).columns], strict=True)) or [()] * len(texts)
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= GROUP):
                size += len(texts[end])
                end += 1
            found = [tokens(t) for t in texts[start:end]]
            _codes.trim()
            yield others[start:end], np.concatenate(found), np.array([len(f) for f in found], np.int64)
            start = end


def to_byte(p: np.ndarray) -> np.ndarray:
    """Logarithm in steps, rounded to the smaller probability."""
    steps = np.ceil(-np.log10(np.maximum(p, 1e-30)) * STEPS - 1e-9)
    return np.clip(steps, 0, 255).astype(np.uint8)


_VALUE = 10.0 ** (-np.arange(256) / STEPS)


@dataclass(frozen=True)
class Trie:
    """Where the files are and what all of them share."""

    folder: str
    bits: int
    sizes: tuple[int, ...]
    total: int
    split: int = 1

    @property
    def words(self) -> int:
        return sum(self.sizes)


class Reader:
    """Looks words and pairs up in the files, which are opened when first needed."""

    def __init__(self, trie: Trie):
        self.trie = trie
        self.offsets = np.r_[0, np.cumsum(trie.sizes)].astype(np.int64)
        self.open: dict[str, tuple] = {}

    def _file(self, name: str, kinds: list) -> list[np.ndarray]:
        if name not in self.open:
            self.open[name] = get(f"{self.trie.folder}/{name}", kinds)
        return self.open[name]

    def shard(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.trie.bits)).astype(np.int64) if self.trie.bits else np.zeros(len(hashes), np.int64)

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (shard above, place below; -1 if unknown) and count of each hash."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = self.shard(hashes)
        for s in np.unique(shard).tolist():
            if not self.trie.sizes[s]:
                continue
            parts = self._file(f"words-{s}", [np.uint64] * 8)
            own, sums = EliasFano(*parts[:4]), EliasFano(*parts[4:])
            mine = np.flatnonzero(shard == s)
            place = own.find(hashes[mine])
            mine, place = mine[place >= 0], place[place >= 0]
            number[mine] = (s << SHARD_BIT) + place
            count[mine] = (sums.at(place + 1) - sums.at(place)).astype(np.int64)
        return number, count

    def dense(self, number: np.ndarray) -> np.ndarray:
        return self.offsets[number >> SHARD_BIT] + (number & ((1 << SHARD_BIT) - 1))

    def rest(self, number: np.ndarray) -> np.ndarray:
        """The weight left to unseen successors; all of it for unknown contexts."""
        out = np.ones(len(number))
        shard = np.where(number >= 0, number >> SHARD_BIT, -1)
        for s in np.unique(shard[shard >= 0]).tolist():
            mine = np.flatnonzero(shard == s)
            (weight,) = self._file(f"rest-{s}", [np.uint8])
            out[mine] = _VALUE[weight[number[mine] & ((1 << SHARD_BIT) - 1)]]
        return out

    def seen(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The probability stored for each pair, 0 where there is none."""
        out = np.zeros(len(context))
        known = np.flatnonzero((context >= 0) & (word >= 0))
        following = self.dense(word[known])
        file = (context[known] >> SHARD_BIT) * self.trie.split + following % self.trie.split
        for f in np.unique(file).tolist():
            mine = np.flatnonzero(file == f)
            parts = self._file(f"successors-{f}", [np.uint64] * 8 + [np.uint8])
            first, ids, byte = EliasFano(*parts[:4]), EliasFano(*parts[4:8]), parts[8]
            if not ids.n:
                continue
            place = context[known[mine]] & ((1 << SHARD_BIT) - 1)
            low, end = first.at(place).astype(np.int64), first.at(place + 1).astype(np.int64)
            base = np.where(low > 0, ids.at(np.maximum(low - 1, 0)), np.uint64(0))
            wanted = base + following[mine].astype(np.uint64) + _PLUS
            at = ids.successor(wanted, low, end)
            safe = np.minimum(at, ids.n - 1)
            hit = (at < end) & (ids.at(safe) == wanted)
            out[known[mine[hit]]] = _VALUE[byte[at[hit]]]
        return out


#: Numbers start from 1 above the range before, so that equal sums never meet.
_PLUS = np.uint64(1)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, flat, _ in _groups(batches):
        words, n = np.unique(flat, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows of a partition by their first column, a file's number; a partition holds a few files."""
    held: dict[int, list] = {}
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        for k in np.unique(columns[0]).tolist():
            held.setdefault(k, []).append([c[columns[0] == k] for c in columns[1:]])
    for k, parts in held.items():
        yield k, [np.concatenate(c) for c in zip(*parts, strict=True)]


def _written(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["file", "n"])


def _write_words(folder: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for s, (words, n) in _by_key(batches):
            words = words.view(np.uint64)
            order = np.argsort(words)
            sums = np.r_[0, np.cumsum(n[order])]
            put(f"{folder}/words-{s}", EliasFano.build(words[order]).arrays() + EliasFano.build(sums).arrays())
            done.append((s, len(words)))
        yield _written(done)

    return work


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers by byte, the lowest of all first; upper bytes that are all zero are left out."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(raw: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    width = raw[at]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 1).reshape(width, n).T
    return out.view("<u8").ravel(), at + 1 + n * width


def pack(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys and their counts: some five bytes a pair, once the shuffle has compressed them."""
    return len(keys).to_bytes(4, "little") + _planes(np.diff(keys, prepend=0)) + _planes(n)


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(raw[:4], "little")
    gaps, at = _from_planes(raw, 4, size)
    return np.cumsum(gaps.astype(np.int64)), _from_planes(raw, at, size)[0].astype(np.int64)


def _count_pairs(trie: Trie, least: int):
    """The pairs of some texts, counted, as a block for each file they belong to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(trie)
        for _, flat, _ in _groups(batches):
            words, place = np.unique(flat, return_inverse=True)
            number, count = reader.lookup(words)
            dense = reader.dense(number)
            before = np.searchsorted(words, END)
            left, right = np.r_[before, place[:-1]], place
            both = (count[left] >= least) & (count[right] >= least)
            pairs, n = np.unique(left[both] * len(words) + right[both], return_counts=True)
            v, w = pairs // len(words), pairs % len(words)
            file = (number[v] >> SHARD_BIT) * trie.split + dense[w] % trie.split
            key = (number[v] & ((1 << SHARD_BIT) - 1)) * trie.words + dense[w]
            order = np.lexsort((key, file))
            file, key, n = file[order], key[order], n[order]
            cuts = np.r_[0, np.flatnonzero(np.diff(file)) + 1, len(file)] if len(file) else np.zeros(1, np.int64)
            blocks = [pack(key[i:j], n[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(file[cuts[:-1]] if len(file) else [], pa.int64()), pa.array(blocks, pa.binary())], ["file", "block"])

    return work


def _write_successors(trie: Trie, least: int):
    """Writes the files and passes on, for each, what its contexts' successors sum up to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = Reader(trie), {}
        for batch in batches:
            for f, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(f, []).extend([block] if block else [])
        while held:
            f, blocks = held.popitem()
            s = f // trie.split
            if not trie.sizes[s]:
                continue
            parts = [unpack(b) for b in blocks] or [(np.zeros(0, np.int64),) * 2]
            keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, which, np.concatenate([c for _, c in parts]))
            keys, n = keys[n >= least], n[n >= least]
            place, following = keys // trie.words, keys % trie.words
            sums = EliasFano(*reader._file(f"words-{s}", [np.uint64] * 8)[4:])
            first = np.searchsorted(place, np.arange(trie.sizes[s] + 1))
            # Each range goes on from the last number of the range before it.
            last = np.r_[place[1:] != place[:-1], np.ones(min(1, len(place)), bool)]
            ends = np.cumsum(np.where(last, following + 1, 0))
            ids = following + 1 + np.r_[0, ends[:-1]][: len(place)]
            own = (sums.at(place + 1) - sums.at(place)).astype(np.float64)
            put(
                f"{trie.folder}/successors-{f}",
                EliasFano.build(first).arrays() + EliasFano.build(ids).arrays() + [to_byte((n - DISCOUNT) / own)],
            )
            context = place[last]
            ends_at = np.flatnonzero(last)
            kinds = np.diff(ends_at, prepend=-1)
            seen = np.diff(np.cumsum(n)[ends_at], prepend=0)
            row = [[s], *[[x.astype(k).tobytes()] for x, k in ((context, "<u4"), (kinds, "<u4"), (seen, "<i8"))]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(row, [pa.int64(), *[pa.binary()] * 3], strict=True)], ["shard", "place", "kinds", "n"]
            )

    return work


def _write_rest(trie: Trie):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, sums_of = Reader(trie), {}
        for batch in batches:
            for s, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place, kinds, n = (np.frombuffer(r, k) for r, k in zip(raw, ("<u4", "<u4", "<i8"), strict=True))
                taken = sums_of.setdefault(s, np.zeros(trie.sizes[s]))
                taken[place] += n - DISCOUNT * kinds
        for s, taken in sums_of.items():
            counts = EliasFano(*reader._file(f"words-{s}", [np.uint64] * 8)[4:])
            every = np.arange(trie.sizes[s])
            own = (counts.at(every + 1) - counts.at(every)).astype(np.float64)
            put(f"{trie.folder}/rest-{s}", [np.where(taken > 0, to_byte(1 - taken / own), 0).astype(np.uint8)])
        yield _written([(s, len(t)) for s, t in sums_of.items()])

    return work


def train(docs: DataFrame, label: str = "ngrams", least: int = LEAST) -> Trie:
    """Count the words and pairs of ``docs(text)`` and write the trie to the shared folder.

    Pairs seen fewer than ``least`` times are not stored. Pairs are shuffled once, in packed blocks,
    to the file they belong to, and counted and written there.
    """
    spark = docs.sparkSession
    texts = docs.select(whole_text().alias("text"))
    folder = scratch_dir(spark, f"{label}-trie")
    words = settle(texts.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), f"{label}-words")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    bits = max(0, (max(kinds, 1) - 1) // WORDS).bit_length()
    shard = F.shiftrightunsigned("word", 64 - bits) if bits else F.lit(0).cast("long")
    dealt = words.select(shard.alias("file"), "word", "n").repartition(1 << bits, "file")
    sizes = {r.file: r.n for r in dealt.mapInArrow(_write_words(folder), "file long, n long").collect()}
    # There are at most as many pairs as tokens.
    split = 1 + total // (SUCCESSORS << bits)
    trie = Trie(folder, bits, tuple(sizes.get(s, 0) for s in range(1 << bits)), total, split)
    if not total:
        return trie
    files = (1 << bits) * split
    blocks = texts.mapInArrow(_count_pairs(trie, least), "file long, block binary")
    # An empty block for each, so that every file is written.
    every = spark.range(files).select(F.col("id").alias("file"), F.lit(None).cast("binary").alias("block"))
    sums = blocks.union(every).repartition(files, "file").mapInArrow(_write_successors(trie, least), "shard long, place binary, kinds binary, n binary")
    sums.repartition(1 << bits, "shard").mapInArrow(_write_rest(trie), "file long, n long").collect()
    return trie


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """Columns ``doc_id, n_tokens, n_known, base_score, score``, one row per document.

    Scores are logarithms to base 10 of the whole text's probability, the end included; a missing
    text is empty and scores its end.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, among = Reader(trie), trie.total + trie.words + 1
        for rows, flat, sizes in _groups(batches):
            words, place = np.unique(np.r_[flat, np.uint64(END)], return_inverse=True)
            place = place[:-1]
            number, count = reader.lookup(words) if trie.total else (np.full(len(words), -1), np.zeros(len(words), np.int64))
            alone = (count + 1) / among
            left = np.r_[np.searchsorted(words, np.uint64(END)), place[:-1]]
            pairs, which = np.unique(left * len(words) + place, return_inverse=True)
            v, w = pairs // len(words), pairs % len(words)
            p = alone[w]
            if trie.total:
                p = reader.seen(number[v], number[w]) + reader.rest(number[v]) * p
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            sums = lambda x: np.add.reduceat(x, starts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()), pa.array(sizes), pa.array(sums((count > 0).astype(np.int64)[place])),
                    pa.array(sums(np.log10(alone)[place])), pa.array(sums(np.log10(p)[which])),
                ],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def train_and_score(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Learn from the documents that are not held out, score all of them."""
    trie = train(docs.where(~is_held_out(F.col("doc_id"))), least=least)
    return score(docs, trie).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(trie.total).cast("long").alias("train_tokens"), "base_score", "score",
    )
