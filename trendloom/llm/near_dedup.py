"""MinHash near-dedup with an LSH forest.

1. Every text becomes its set of 64-bit shingle hashes, the set a digest and ``TREES * DEPTH``
   minimum hashes. Texts with equal sets form one node.
2. The forest: each tree sorts the nodes by its own ``DEPTH`` values first. A node's candidates are
   the neighbours that share the longest prefixes with it: the next ``NEAR`` nodes of the order that
   share at least the first value. In a thin region these reach nodes that share one value, in a
   dense region only those that share many, so the depth adapts to the region.
3. Candidates whose whole signatures agree in at least ``AGREE`` of all places tie nodes into
   families. A family is not a result but a place to look: a document linked to any member lands in
   it, even if the linked member itself is not its neighbour in any tree.
4. Inside a family all sets are compared exactly, in blocks of bounded size; every pair of blocks is
   a task of its own and hands on a spanning forest of the links found, never all pairs.
5. Connected components of the links give the result.

With 8 trees, a pair at the threshold shares no first value in any tree with probability 0.2^8, and
its signatures agree too little with a chance below one in a million; families make further misses
harmless unless they separate a document from its whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import Codes, settle
from trendloom.llm.components import components

#: Words of a shingle, unless a caller says otherwise, and the most there can be.
SHINGLE, LONGEST = 5, 16
TREES, DEPTH = 8, 8
NEAR, AGREE = 8, 0.55
IDENTITY = ["doc_id", "h1", "h2"]
#: Members and hashes of a block; hashes handled at once when signatures are made.
MEMBERS, HASHES, STEP = 1_000, 2_000_000, 8_192

_RANDOM = np.random.default_rng(20_11)
_MIX = np.random.default_rng(20_12).integers(1, 2**63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RANDOM.integers(0, 2**64, TREES * DEPTH, dtype=np.uint64)
_ODD = _RANDOM.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_codes = Codes()


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; bytes are lower-cased and cut as ASCII."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    codes = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    found = sum(codes[k : k + n] * _MIX[k] for k in range(size))
    found ^= found >> np.uint64(31)
    return np.unique(found * np.uint64(0xD6E8FEB86659FD93))


def signature(hashes: np.ndarray) -> bytes:
    """16 bits of the minimum of every hash function, most significant byte first."""
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), STEP):
        part = (hashes[at : at + STEP, None] ^ _XOR) * _ODD
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(20)).astype(">u2").tobytes()


def node_of(hashes: np.ndarray) -> int:
    """A digest of the set, as a signed number."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - 2**63


def identity() -> list[Column]:
    """What tells rows apart: the id and 128 bits of the text."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Columns ``doc_id, h1, h2, n_shingles, node, signature``; the last two are null for empty sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, signs = [], [], []
            for text in batch.column(3).to_pylist():
                own = shingles(text, size)
                sizes.append(len(own))
                nodes.append(node_of(own) if len(own) else None)
                signs.append(signature(own) if len(own) else None)
            _codes.trim()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(signs, pa.binary())],
                [*IDENTITY, "n_shingles", "node", "signature"],
            )

    rows = docs.select(*identity(), "text")
    return rows.mapInArrow(work, "doc_id long, h1 long, h2 long, n_shingles long, node long, signature binary")


class Forest:
    """Union-find over the nodes met by one task; keeps the links that join two sets."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate links among rows sorted by tree and signature."""
    width = TREES * DEPTH
    tail = (np.zeros(0, np.int8), np.zeros((0, width), ">u2"), np.zeros(0, np.int64))
    for batch in batches:
        if not batch.num_rows:
            continue
        own = (
            batch.column(0).to_numpy(zero_copy_only=False).astype(np.int8),
            np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, width),
            batch.column(2).to_numpy(zero_copy_only=False),
        )
        tree, keys, node = (np.concatenate(x) for x in zip(tail, own, strict=True))
        old, forest, links = len(tail[0]), Forest(), []
        for step in range(1, NEAR + 1):
            a = np.arange(max(0, old - step), len(tree) - step)
            a = a[(tree[a] == tree[a + step]) & (keys[a, 0] == keys[a + step, 0])]
            agree = (keys[a] == keys[a + step]).sum(axis=1)
            for i in a[agree >= AGREE * width]:
                u, v = int(node[i]), int(node[i + step])
                if forest.join(u, v):
                    links.append((u, v))
        tail = (tree[-NEAR:], keys[-NEAR:], node[-NEAR:])
        yield pa.RecordBatch.from_arrays(
            [pa.array([u for u, _ in links], pa.int64()), pa.array([v for _, v in links], pa.int64())], ["u", "v"]
        )


def families(nodes: DataFrame) -> DataFrame:
    """Columns ``node, family`` of all nodes that the forest ties to another."""
    size = DEPTH * 2
    turned = [F.concat(F.substring("signature", t * size + 1, TREES * size), F.substring("signature", 1, t * size)) for t in range(TREES)]
    trees = nodes.select("node", F.posexplode(F.array(*turned)).alias("tree", "key"))
    ordered = trees.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    ties = ordered.select("tree", "key", "node").mapInArrow(_neighbours, "u long, v long")
    return components(settle(ties, "near-ties"), "near-families").select("node", F.col("root").alias("family"))


def _sets(size: int):
    """The sets of the members, for texts that are the node's own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingles(t, size) for t in batch.column(1).to_pylist()]
            nodes = batch.column(0).to_pylist()
            right = [len(h) > 0 and node_of(h) == n for h, n in zip(hashes, nodes, strict=True)]
            _codes.trim()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array([h.tobytes() for h in hashes], pa.binary())],
                ["node", "family", "blocks", "hashes"],
            ).filter(pa.array(right, pa.bool_()))

    return work


def spanning_links(nodes: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with ``100 * intersection >= percent * union``, exactly."""
    order = np.argsort(nodes, kind="stable")
    keep = order[np.r_[True, np.diff(np.asarray(nodes)[order]) != 0]]
    nodes, sets = [nodes[i] for i in keep], [sets[i] for i in keep]
    m, sizes = len(nodes), np.array([len(s) for s in sets], np.int64)
    own = np.repeat(np.arange(m), sizes)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[place] > 1
    renumber = np.cumsum(count > 1) - 1
    place, own = renumber[place[shared]], own[shared]
    common = np.zeros((m, m), np.float32)
    rows = max(1, 8_000_000 // m)  # shingles laid out at once
    by = np.argsort(place, kind="stable")
    place, own = place[by], own[by]
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, rows):
        a, b = np.searchsorted(place, [low, low + rows])
        laid = np.zeros((min(rows, int(place[b - 1]) - low + 1) if b > a else 0, m), np.float32)
        laid[place[a:b] - low, own[a:b]] = 1
        common += laid.T @ laid
    either = sizes[:, None] + sizes[None, :] - common
    linked = 100 * common >= percent * either
    np.fill_diagonal(linked, False)
    seen, links = np.zeros(m, bool), []
    for start in range(m):
        if seen[start]:
            continue
        seen[start], front = True, [start]
        while front:
            i = front.pop()
            new = np.flatnonzero(linked[i] & ~seen)
            seen[new] = True
            links += [(nodes[i], nodes[j]) for j in new]
            front += new.tolist()
    return links


def _verify(percent: int):
    def links_of(members: dict[str, list]) -> list[tuple[int, int]]:
        return spanning_links(members["node"], [np.frombuffer(h, np.uint64) for h in members["hashes"]], percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by family and pair of blocks."""
        now, held = None, {"node": [], "hashes": []}
        for batch in batches:
            links = []
            for *key, node, hashes in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != now:
                    links += links_of(held) if len(held["node"]) > 1 else []
                    now, held = key, {"node": [], "hashes": []}
                held["node"].append(node)
                held["hashes"].append(hashes)
            yield _links(links)
        yield _links(links_of(held) if len(held["node"]) > 1 else [])

    return work


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])


def verified_links(docs: DataFrame, members: DataFrame, percent: int, size: int = SHINGLE) -> DataFrame:
    """Exact links inside families. ``members``: ``node, family, doc_id, n_shingles``."""
    totals = members.groupBy("family").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("n"))
    blocks = F.ceil(F.greatest(F.col("m") / MEMBERS, F.col("n") / HASHES)).cast("int")
    placed = members.join(totals.select("family", blocks.alias("blocks")), "family")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Both sides are shuffled at every size: members grow with the corpus, so a broadcast would not last.
    with_text = placed.join(texts.hint("merge"), "doc_id").select("node", "text", "family", "blocks")
    sets = with_text.mapInArrow(_sets(size), "node long, family long, blocks int, hashes binary")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # A member of block b meets every block once, its own included.
    pairs = sets.withColumn("b", block).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = pairs.select("family", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "node", "hashes")
    dealt = keyed.repartition("family", "b1", "b2").sortWithinPartitions("family", "b1", "b2")
    return dealt.mapInArrow(_verify(percent), "u long, v long")


def _grouped(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """Columns ``doc_id, h1, h2, n_shingles, first``, one row per row of ``docs``.

    ``first`` is the smallest identity reachable; it is null for rows without ``doc_id`` or words.
    """
    signed = settle(signatures(docs, size), "near-signatures")
    linkable = signed.where("node IS NOT NULL AND doc_id IS NOT NULL")
    nodes = linkable.groupBy("node").agg(
        F.min(F.struct(*IDENTITY)).alias("own"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
    )
    members = nodes.join(families(nodes.select("node", "signature")), "node").select(
        "node", "family", F.col("own.doc_id").alias("doc_id"), "n_shingles", "own"
    )
    members = settle(members, "near-members")
    links = settle(verified_links(docs, members.drop("own"), percent, size), "near-links")
    roots = components(links, "near-components")
    grouped = roots.join(members, "node").select("node", "root", "own")
    least = grouped.groupBy("root").agg(F.min("own").alias("least"))
    of_node = settle(grouped.join(least, "root").select("node", "least"), "near-groups")
    firsts = linkable.groupBy("node").agg(F.min(F.struct(*IDENTITY)).alias("own"))
    known = firsts.join(of_node, "node", "left").select("node", F.coalesce("least", "own").alias("found"))
    out = signed.drop("signature").join(known, "node", "left")
    return out.select(*IDENTITY, "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("found")).alias("first"))


def find_groups(docs: DataFrame, percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """Columns ``doc_id, n_shingles, component_id, kept``, one row per row of ``docs``.

    Texts are linked if ``100 * intersection >= percent * union`` of their sets of shingles of ``size`` words;
    ``component_id`` is the smallest ``doc_id`` reachable. A text without words (or missing) is
    linked with nothing. A row without ``doc_id`` takes no part: its ``component_id`` is null and it
    is kept. Rows with equal ``doc_id`` and different texts are told apart by their texts.
    """
    alone = F.coalesce(F.col("first.doc_id"), F.col("doc_id"))
    return _grouped(docs, percent, size).select(
        "doc_id", "n_shingles", alone.alias("component_id"), F.coalesce(F.col("doc_id") == alone, F.lit(True)).alias("kept")
    )


def keep_one_of_each(docs: DataFrame, percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """One row of every group, the one with the smallest id, with the columns it came with.

    Rows are told apart by id and text, so a text without a copy stays even if its id also has
    another text that goes. Rows equal in both are one document, of which the smallest row stays;
    rows without ``doc_id`` all stay.
    """
    own = F.struct(*IDENTITY)
    found = _grouped(docs, percent, size).where("doc_id IS NOT NULL").select(*IDENTITY, (F.coalesce("first", own) != own).alias("gone"))
    counted = found.groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("n"), F.max("gone").alias("gone"))
    marks = settle(counted.where("gone OR n > 1"), "near-marks")
    # Its size is known before the join, so that few repeated rows cost no shuffle of the texts.
    twice = settle(marks.where("NOT gone").select(*IDENTITY), "near-twice")
    rows = docs.select(F.struct("*").alias("row"), F.struct(*identity()).alias("key")).select("row", "key.*")
    single = rows.join(marks, IDENTITY, "left_anti").select("row.*")
    return single.union(rows.join(twice, IDENTITY).groupBy(*IDENTITY).agg(F.min("row").alias("row")).select("row.*"))
