"""Prefix trie of conversations: what they share, from the first turn on.

A turn is a 20-byte cell (16 bytes of a hash of role and text, 4 of the text's length), and a
conversation the string of its cells. Texts are shuffled once, to put turns in order; from then on
only cells move.

1. Conversations are range-sorted by (path, id), so a path that a third of them share is spread;
   their ids are joined to chunks of text there, and a second range sort by path brings a path's
   chunks together, where one pass hashes them in order.
2. *Shards.* Sorted paths are cut into shards of bounded size: each holds a range of prefixes. A
   shard numbers its turns densely, packs a double array (``BASE`` of a node plus a turn's number
   is the child's slot, ``CHECK`` of that slot is the node) and walks all its paths through it.
3. *Shared nodes.* Only prefixes of a shard's first or last path can occur in other shards. Their
   sums are merged over all shards; every merged node adds its own part to its ancestors once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.llm.common import settle

CELL = 20
#: Cells of a shard, and characters of a chunk of ids.
SHARD, CHUNK = 1 << 18, 1 << 16
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _cell() -> Column:
    """40 hex digits for a turn."""
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return F.concat(F.substring(F.sha2(whole, 256), 1, 32), F.lower(F.lpad(F.hex(F.octet_length("text")), 8, "0")))


def paths(turns: DataFrame) -> DataFrame:
    """Columns ``conv_id, leader, cells`` (hex): every conversation's turns in order.

    By turn, a missing one first; then by role and text. Rows without ``conv_id`` belong to no
    conversation and are left out.
    """
    own = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    grouped = own.withColumn("leader", F.col("conv_id") - F.col("conv_id") % 5).repartition("leader")
    order = Window.partitionBy("leader", "conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    cells = grouped.select("leader", "conv_id", F.row_number().over(order).alias("at"), _cell().alias("cell"))
    listed = cells.groupBy("leader", "conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "cell"))).alias("cells"))
    return listed.select("conv_id", "leader", F.array_join(F.col("cells.cell"), "").alias("cells"))


def share_leaders_turns(conversations: DataFrame) -> DataFrame:
    """Columns ``conv_id, path``: the first turns of a conversation replaced by its leader's.

    The leader of c is c - c % 5, the number of turns h is crc32(c) % 9: the leader's first h turns
    (all, if it has fewer), then c's own behind its first h.
    """
    digits = 2 * CELL
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    lead = F.max(F.when(F.col("conv_id") == F.col("leader"), F.substring("cells", 1, 8 * digits))).over(Window.partitionBy("leader"))
    known = conversations.select("conv_id", "cells", F.coalesce(lead, F.lit("")).alias("lead"), h.alias("h"))
    start = F.substr(F.col("lead"), F.lit(1), F.col("h") * digits)
    rest = F.substr(F.col("cells"), F.col("h") * digits + 1)
    return known.select("conv_id", F.unhex(F.concat(start, rest)).alias("path"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, first, n, ids``: neighbouring ids of a path as text."""
    now, ids, size = None, [], 0
    out: list[tuple] = []

    def close() -> None:
        if ids:
            out.append((now, ids[0], len(ids), ",".join(map(str, ids))))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "first", "n", "ids"])

    for batch in batches:
        for path, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if path != now or size > CHUNK:
                close()
                now, ids, size = path, [], 0
            ids.append(conv)
            size += 12
        if out:
            yield batch_of(out)
            out.clear()
    close()
    if out:
        yield batch_of(out)


class DoubleArray:
    """BASE and CHECK over codes from 1 on; slot 0 is the root. A base may be negative."""

    def __init__(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.codes, self.start, self.length = codes, start, length
        self.span = int(codes.max(initial=0)) + 1
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.check[0] = 0
        self.low = self.high = 1
        slot = np.zeros(len(start), np.int64)
        for depth, live in self._levels():
            code, parent = codes[start[live] + depth], slot[live]
            pairs = np.unique(parent * self.span + code)
            self._place(pairs // self.span, pairs % self.span)
            slot[live] = self.base[parent] + code

    def _levels(self) -> Iterator[tuple[int, np.ndarray]]:
        live = np.arange(len(self.start))
        for depth in range(int(self.length.max(initial=0))):
            live = live[self.length[live] > depth]
            yield depth, live

    def _reserve(self, end: int) -> None:
        if end > len(self.check):
            more = max(end, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _free(self, n: int) -> np.ndarray:
        """The first ``n`` free slots."""
        width = 2 * n + 64
        while True:
            self._reserve(self.low + width)
            found = np.flatnonzero(self.check[self.low : self.low + width] < 0)[:n] + self.low
            if len(found) == n:
                return found
            width *= 2

    def _place(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Slots for all children of one level, given by parent and code, sorted."""
        first = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        size = np.diff(np.r_[first, len(parents)])
        for f, n in zip(first[size > 1], size[size > 1], strict=True):
            own = codes[f : f + n]
            base = self._fit(own)
            self.base[parents[f]] = base
            self.check[base + own] = parents[f]
            self.high = max(self.high, int(base + own[-1]) + 1)
        lone = first[size == 1]
        if len(lone):  # a single child goes to any free slot
            slots = self._free(len(lone))
            self.base[parents[lone]] = slots - codes[lone]
            self.check[slots] = parents[lone]
            self.low, self.high = int(slots[-1]) + 1, max(self.high, int(slots[-1]) + 1)

    def _fit(self, codes: np.ndarray) -> int:
        """A base that puts all codes on free slots: near the front, or behind all others."""
        if len(codes) <= 64:
            bases = self._free(64) - codes[0]
            self._reserve(int(bases[-1] + codes[-1]) + 1)
            fits = np.flatnonzero((self.check[bases[:, None] + codes] < 0).all(axis=1))
            if len(fits):
                return int(bases[fits[0]])
        base = self.high - int(codes[0])
        self._reserve(base + int(codes[-1]) + 1)
        return base

    def walk(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Depth, paths still going and their slots there, level by level from the root."""
        slot = np.zeros(len(self.start), np.int64)
        yield 0, np.arange(len(slot)), slot.copy()
        for depth, live in self._levels():
            there = self.base[slot[live]] + self.codes[self.start[live] + depth]
            if not (self.check[there] == slot[live]).all():
                raise AssertionError("a path left the double array")
            slot[live] = there
            yield depth + 1, live, there


_PART = (
    "shard long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, parent binary, key binary, last_bytes long, branch int, forked boolean"
)
_KINDS = [pa.int64()] * 8 + [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.bool_()]


def _prefix_keys(path: bytes) -> list[bytes]:
    """A 16-byte key for every prefix, from the empty one on."""
    state = hashlib.blake2b(digest_size=16)
    keys = [state.digest()]
    for at in range(0, len(path), CELL):
        state.update(path[at : at + CELL])
        keys.append(state.copy().digest())
    return keys


def shard_nodes(shard: int, rows: list[tuple[bytes, int, int, str]]) -> pa.RecordBatch:
    """Nodes of a shard, from its distinct paths in order with members, first member and digest.

    A node on the first or last path has a ``key`` and only what hangs beside those paths; other
    nodes are whole, but for ``parent_conv_id`` where the parent has a key (``parent``).
    """
    raw, n, least, ends = zip(*rows, strict=True)
    length = np.array([len(p) // CELL for p in raw], np.int64)
    start = np.r_[0, np.cumsum(length)[:-1]]
    cells = np.frombuffer(b"".join(raw), f"V{CELL}")
    depth_of = np.arange(len(cells)) - np.repeat(start, length)
    # Turns are numbered as a walk by levels meets them, so that siblings' numbers lie close.
    met = np.argsort(depth_of, kind="stable")
    distinct, first, code = np.unique(cells[met], return_index=True, return_inverse=True)
    rank = np.empty(len(distinct), np.int64)
    rank[np.argsort(first)] = np.arange(1, len(distinct) + 1)
    codes = np.empty(len(cells), np.int64)
    codes[met] = rank[code.ravel()]
    bytes_of = np.zeros(len(distinct) + 1, np.int64)
    if len(distinct):
        bytes_of[rank] = distinct.view(np.uint8).reshape(-1, CELL)[:, 16:].copy().view(">u4").ravel()
    trie = DoubleArray(codes, start, length)

    size = trie.high
    check = trie.check[:size]
    convs, low, depth, last = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64), np.zeros(size, np.int64)
    members, smallest = np.array(n, np.int64), np.array(least, np.int64)
    end_of = np.zeros(len(raw), np.int64)
    spine: list[list[int]] = [[], []]
    for d, live, slot in trie.walk():
        np.add.at(convs, slot, members[live])
        np.minimum.at(low, slot, smallest[live])
        depth[slot], end_of[live] = d, slot
        if d:
            last[slot] = bytes_of[codes[start[live] + d - 1]]
        for branch, path in enumerate((0, len(raw) - 1)):
            if d <= length[path]:
                spine[branch].append(int(end_of[path]))
    used = np.flatnonzero(check >= 0)
    children = np.bincount(check[used[used > 0]], minlength=size)
    keys = [_prefix_keys(raw[0]), _prefix_keys(raw[-1])]
    key = {s: k for branch in (0, 1) for s, k in zip(spine[branch], keys[branch], strict=True)}
    branch_of = {s: 1 for s in spine[1]} | {s: 0 for s in spine[0]}
    both = set(spine[0]) & set(spine[1])

    on = np.zeros(size, bool)
    on[list(key)] = True
    leaves = ((children == 0) & ~on).astype(np.int64)
    saved = np.where(on, 0, (convs - 1) * last)
    by_depth = used[np.argsort(depth[used], kind="stable")]
    cuts = np.flatnonzero(np.diff(depth[by_depth])) + 1
    for level in reversed(np.split(by_depth, cuts)):
        below = level[(level > 0) & ~on[level]]
        np.add.at(leaves, check[below], leaves[below])
        np.add.at(saved, check[below], saved[below])
    beside = children - np.bincount(check[[s for s in key if s]], minlength=size).astype(np.int64)

    ends_at = dict(zip(end_of.tolist(), ends, strict=True))
    slots = used.tolist()
    known = [None if on[p] else int(low[p]) for p in check[used]]
    columns = [
        [shard] * len(slots), low[used], depth[used], known, convs[used], np.where(on, beside, children)[used], leaves[used], saved[used],
        [ends_at.get(s) for s in slots], [key.get(p) if s else None for s, p in zip(slots, check[used].tolist(), strict=True)],
        [key.get(s) for s in slots], last[used], [branch_of.get(s) for s in slots], [s in both for s in slots],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], [c.split()[0] for c in _PART.split(", ")])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the shards of a task, from chunks sorted by path and first id."""
    name, rows, size = TaskContext.get().partitionId() << 32, [], 0
    now, n, least, state = None, 0, 0, hashlib.sha256()
    for batch in batches:
        for path, first, more, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if path != now:
                if now is not None:
                    rows.append((now, n, least, state.hexdigest()))
                    size += len(now) // CELL + 1
                    if size >= SHARD:
                        yield shard_nodes(name, rows)
                        name, rows, size = name + 1, [], 0
                now, n, least, state = path, 0, first, hashlib.sha256()
            state.update((("," if n else "") + ids).encode())
            n += more
    if now is not None:
        yield shard_nodes(name, [*rows, (now, n, least, state.hexdigest())])


def _merged(shared: DataFrame) -> DataFrame:
    """Nodes on shards' edges, whole: sums over shards, then over their edge nodes below."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    bests = [F.max(c).alias(c) for c in ("depth", "last_bytes", "ends_sha256", "parent")]
    one = shared.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("shard").alias("home"), *sums, *bests)
    kids = one.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("kids"))
    n_children = F.col("n_children") + F.coalesce("kids", F.lit(0))
    own = one.join(kids, "key", "left").withColumn("n_children", n_children).select(
        "key", "conv_id", "home", "n_convs", "n_children", "depth", "parent", "ends_sha256",
        (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("last_bytes")).alias("saved"),
    )
    own = settle(own, "trie-shared")
    # A node's own part stands in one shard, its home; a shard's sums along its paths include it.
    here = F.col("shard") == F.col("home")
    placed = shared.select("shard", "key", "branch", "forked", "depth").join(own.select("key", "home", "leaves", "saved"), "key")
    down = Window.partitionBy("shard", "branch").orderBy(F.desc("depth"))
    second = Window.partitionBy("shard")
    totals = []
    for part in ("leaves", "saved"):
        value = F.when(here, F.col(part)).otherwise(0)
        beyond = F.when(F.col("forked"), F.sum(F.when(F.col("branch") == 1, value)).over(second))
        totals.append((F.sum(value).over(down) + F.coalesce(beyond, F.lit(0))).alias(part))
    below = placed.select("key", *totals).groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = own.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return own.drop("leaves", "saved", "home").join(below, "key").join(above, "parent", "left")


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie over ``conv_id, path``, a row each, in columns ``NODE``.

    ``conv_id`` is the smallest member (a conversation that starts with the node's turns),
    ``parent_conv_id`` the parent's, null for the root; ``n_leaves`` counts childless nodes of the
    subtree, ``saved_tokens`` sums (members - 1) x bytes of the last text over it, ``ends_sha256``
    hashes the ids, in order, of conversations that end there. Without conversations there is no
    node. Turns and prefixes are told apart by 128-bit hashes.
    """
    ordered = conversations.select("path", "conv_id").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    chunks = settle(ordered.mapInArrow(_chunks, "path binary, first long, n long, ids string"), "trie-chunks")
    sharded = chunks.repartitionByRange("path").sortWithinPartitions("path", "first")
    parts = settle(sharded.mapInArrow(_shards, _PART), "trie-parts")
    shared = parts.where("key IS NOT NULL")
    merged = settle(_merged(shared), "trie-merged")
    inner = parts.where("key IS NULL")
    # The edge nodes of a shard, again with it: no key meets more rows than a shard has.
    edges = shared.select("shard", F.col("key").alias("parent")).join(merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("found")), "parent")
    hanging = inner.where("parent IS NOT NULL").join(edges, ["shard", "parent"]).withColumn("parent_conv_id", F.col("found"))
    rows = inner.where("parent IS NULL").select(*NODE).union(hanging.select(*NODE)).union(merged.select(*NODE))
    return rows.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS)))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie over conversations rebuilt by ``share_leaders_turns``, from ``conv_id, turn, role, text``.

    Missing roles and texts are empty, other columns are not read, repeated rows are turns of their
    own. A conversation is held as 20 bytes a turn in one row.
    """
    return trie_nodes(settle(share_leaders_turns(paths(turns)), "trie-paths"))
