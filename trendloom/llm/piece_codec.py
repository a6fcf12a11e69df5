"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Blanks become the mark U+2581 and a text is cut in front of every run of marks; no piece holds a
mark after another character, so no merge crosses a cut and equal chunks encode alike. The
distinct chunks that a worker does not remember are encoded together: their characters lie in one
flat array of symbols, every round finds the best pair of each chunk by a segmented minimum, merges
it in all chunks at once, and compacts the arrays, until no pair is left.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import worker_wide

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CUT = re.compile(f"[^{MARK}]{MARK}")
#: Characters encoded together, chunks a worker remembers.
GROUP, REMEMBER = 1_000_000, 200_000
NONE = np.iinfo(np.int64).max
#: An odd multiplier that spreads keys over a table's places.
SPREAD = 0x9E3779B97F4A7C15


class PieceTable:
    """The model's pieces as arrays: ids of characters, ranks of pairs, bytes of ids."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.end, self.unknown = model.get_piece_size(), model.eos_id(), model.unk_id()
        pieces = [model.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        of = {pieces[i]: i for i in plain}
        # Ranks: higher scores first, equal scores share a rank, so that position decides.
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        self.rank = np.full(self.size, NONE, np.int64)
        self.rank[plain] = [order[model.get_score(i)] for i in plain]
        self.byte_id = np.zeros(256, np.int64)
        for i in range(self.size):
            if model.is_byte(i):
                self.byte_id[int(pieces[i][3:5], 16)] = i
        # A character without a piece of its own is a symbol beyond the pieces.
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.size
        for piece, i in of.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        span = self.size + 0x110000
        symbol = lambda s: of.get(s, self.size + ord(s) if len(s) == 1 else None)
        pairs = {}
        for piece, i in of.items():
            for k in range(1, len(piece)):
                a, b = symbol(piece[:k]), symbol(piece[k:])
                if a is not None and b is not None:
                    pairs[a * span + b] = i
        self.span = span
        self.shift = 64 - max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << (64 - self.shift), -1, np.int64)
        self.merged = np.full(len(self.keys), -1, np.int64)
        for key, i in pairs.items():
            at = (key * SPREAD % 2**64) >> self.shift
            while self.keys[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.merged[at] = key, i
        # What an id decodes to: nothing for control ids, a byte for byte ids.
        self.longest_blank = max((len(p) for p in of if not p.strip(MARK)), default=1)
        self.blank = of.get(MARK * self.longest_blank)
        out = [b"" if model.is_control(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else b" \xe2\x81\x87 " if i == self.unknown else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.bytes_of, self.name_of = out, list(map(str, range(self.size)))

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two neighbouring symbols merge to, or -1."""
        key = a * self.span + b
        at = ((key.view(np.uint64) * np.uint64(SPREAD)) >> np.uint64(self.shift)).astype(np.int64)
        found, out = self.keys[at], self.merged[at]
        out[found != key] = -1
        # Places taken by another key: look at the next ones.
        left = np.flatnonzero((found != key) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) % len(self.keys)
            found = self.keys[at[left]]
            hit = found == key[left]
            out[left[hit]] = self.merged[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out

    def ranks(self, piece: np.ndarray) -> np.ndarray:
        return np.where(piece >= 0, self.rank[piece], NONE)

    def merge(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all chunks after the merges, and the chunk of each symbol."""
        flat = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(c) for c in chunks], np.int64)
        sym, own = self.of_char[flat], np.repeat(np.arange(len(chunks)), sizes)
        done_sym, done_own = [], []
        to = np.full(len(sym), -1, np.int64)  # what a symbol and the next one merge to
        if len(sym) > 1:
            to[:-1] = np.where(own[:-1] == own[1:], self.pair(sym[:-1], sym[1:]), -1)
        rank = self.ranks(to)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            open_ = np.repeat(least != NONE, sizes)
            if not open_.all():  # compaction: chunks without a pair are finished
                done_sym.append(sym[~open_])
                done_own.append(own[~open_])
                sym, own, to, rank = sym[open_], own[open_], to[open_], rank[open_]
                sizes, least = sizes[least != NONE], least[least != NONE]
                if not len(sym):
                    break
            group = np.repeat(np.arange(len(sizes)), sizes)
            best = np.flatnonzero(rank == least[group])
            # In a run of overlapping occurrences the first, third, ... are taken.
            first = np.r_[True, (np.diff(best) > 1) | (group[best[1:]] != group[best[:-1]])]
            run = np.maximum.accumulate(np.where(first, np.arange(len(best)), 0))
            at = best[(np.arange(len(best)) - run) % 2 == 0]
            # Taking all occurrences at once equals taking them one by one from the left, as long as none of them
            # makes a pair that is at least as good; from the first one that does, the others wait.
            new, n = to[at], len(sym)
            has_left = (at > 0) & (own[at - 1] == own[at])
            left = np.where(has_left, sym[at - 1], 0)
            near = np.r_[False, (at[1:] - at[:-1] == 2) & (own[at[1:]] == own[at[:-1]])]
            left = np.where(near, np.r_[0, new[:-1]], left)
            after = np.minimum(at + 2, n - 1)
            has_right = (at + 2 < n) & (own[after] == own[at])
            to_left = np.where(has_left, self.pair(left, new), -1)
            to_right = np.where(has_right, self.pair(new, sym[after]), -1)
            bad = np.minimum(self.ranks(to_left), self.ranks(to_right)) <= rank[at]
            if bad.any():
                stop = np.full(len(sizes), n, np.int64)
                np.minimum.at(stop, group[at[bad]], at[bad])
                ok = at <= stop[group[at]]
                at, new, has_left, left, has_right, after = at[ok], new[ok], has_left[ok], left[ok], has_right[ok], after[ok]
            sym[at] = new
            stay = np.ones(n, bool)
            stay[at + 1] = False
            # Pairs next to a merge are looked up anew, now that all merges of the round are in place.
            nxt = np.where(has_right, sym[after], 0)
            to[at] = np.where(has_right, self.pair(sym[at], nxt), -1)
            back = at[has_left]
            prev = np.where(stay[back - 1], back - 1, back - 2)
            to[prev] = self.pair(sym[prev], sym[back])
            rank[at], rank[prev] = self.ranks(to[at]), self.ranks(to[prev])
            sym, own, to, rank = sym[stay], own[stay], to[stay], rank[stay]
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sym, own = np.concatenate(done_sym), np.concatenate(done_own)
        order = np.argsort(own, kind="stable")
        return sym[order], own[order]

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk; characters without a piece fall back to their bytes."""
        sym, own = self.merge(chunks)
        ends = np.cumsum(np.bincount(own, minlength=len(chunks))).tolist()
        ids = sym.tolist()
        out = [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for k in set(own[sym >= self.size].tolist()):
            out[k] = [j for i in out[k] for j in ([i] if i < self.size else self.byte_id[list(chr(i - self.size).encode())].tolist())]
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids put together, with the blank that encoding adds in front."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def text(self, ids: list[int]) -> str:
        return self.decode(ids).decode("utf-8", "replace").removeprefix(" ")


def segments(text: str) -> Iterator[str]:
    """The text with its marks, in parts that end where a chunk ends."""
    if not text:
        return
    text, at = MARK + text.replace(" ", MARK), 0
    while len(text) - at > GROUP:
        cut = CUT.search(text, at + GROUP // 2)
        if cut is None:
            break
        yield text[at : cut.start() + 1]
        at = cut.start() + 1
    yield text[at:]


class Codec:
    """Encodes and decodes texts, remembering a bounded number of chunks."""

    def __init__(self, pieces: PieceTable):
        self.pieces = pieces
        # Chunk to its ids as text, and to its bytes; chunks of the generation before move over when met again.
        self.ids_of: dict[str, str] = {}
        self.bytes_of: dict[str, bytes] = {}
        self.older: tuple[dict[str, str], dict[str, bytes]] = ({}, {})

    def chunk_ids(self, chunks: list[str]) -> list[list[int]]:
        """A long run of blanks takes its longest pieces from the left; the rest goes through the rounds."""
        longest, long_run, heads = self.pieces.longest_blank, MARK * 3 * self.pieces.longest_blank, {}
        if longest > 1 and any(map(long_run.__le__, chunks)):  # a cheap first look
            for k, c in enumerate(chunks):
                if c.startswith(long_run):
                    whole = (len(c) - len(c.lstrip(MARK))) // longest - 2
                    heads[k], chunks[k] = [self.pieces.blank] * whole, c[whole * longest :]
        ids = self.pieces.encode_chunks(chunks)
        for k, head in heads.items():
            ids[k] = head + ids[k]
        return ids

    def learn(self, chunks: set[str]) -> None:
        if len(self.ids_of) > REMEMBER:
            self.older, self.ids_of, self.bytes_of = (self.ids_of, self.bytes_of), {}, {}
        new = []
        for c in chunks.difference(self.ids_of):
            if c in self.older[0]:
                self.ids_of[c], self.bytes_of[c] = self.older[0][c], self.older[1][c]
            else:
                new.append(c)
        found = self.chunk_ids(list(new)) if new else []
        name, part = self.pieces.name_of.__getitem__, self.pieces.bytes_of.__getitem__
        self.ids_of.update(zip(new, [" ".join(map(name, ids)) for ids in found], strict=True))
        self.bytes_of.update(zip(new, [b"".join(map(part, ids)) for ids in found], strict=True))

    def encode(self, text: str) -> list[int]:
        chunks = [c for s in segments(text) for c in CHUNK.findall(s)]
        ids = dict(zip(own := list(dict.fromkeys(chunks)), self.chunk_ids(list(own)) if own else [], strict=True))
        return [i for c in chunks for i in ids[c]]

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of ids with the end id, digest of the ids, digest of the decoded text."""
        work = [(k, s) for k, t in enumerate(texts) for s in segments(t)]
        state = [[0, hashlib.sha256(), hashlib.sha256()] for _ in texts]
        at = 0
        while at < len(work):
            end, size = at, 0
            while end < len(work) and (end == at or size + len(work[end][1]) <= GROUP):
                size += len(work[end][1])
                end += 1
            cut = [(k, CHUNK.findall(s)) for k, s in work[at:end]]
            self.learn(set().union(*[c for _, c in cut]))
            for k, chunks in cut:
                own = state[k]
                ids = " ".join(map(self.ids_of.__getitem__, chunks)) + " "
                decoded = b"".join(map(self.bytes_of.__getitem__, chunks))
                own[1].update(ids.encode())
                own[2].update(decoded if own[0] else decoded.removeprefix(b" "))
                own[0] += ids.count(" ")
            at = end
        for n, ids, decoded in state:
            ids.update(str(self.pieces.end).encode())
            yield n + 1, ids.hexdigest(), decoded.hexdigest()


def codec(path: str) -> Codec:
    """A codec whose piece table the worker holds; what it learns goes with the task."""
    return Codec(worker_wide(("pieces", path), lambda: PieceTable(path)))


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """Columns ``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row per document.

    Ids end with the model's end id; a missing text is empty and has that id only. Very long texts
    go through in parts, a chunk without any blank as one.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            n, ids, decoded = zip(*own.digests([t or "" for t in batch.column(1).to_pylist()]), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Columns ``doc_id, ids``: the ids themselves, with the end id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = [own.encode(t or "") + [own.pieces.end] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, ids array<int>")


def decode_documents(rows: DataFrame, path: str) -> DataFrame:
    """Columns ``doc_id, text`` from ``doc_id, ids``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path).pieces
        for batch in batches:
            texts = [own.text(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")
