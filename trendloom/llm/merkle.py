"""Merkle manifest of a dataset: a hash for every row, source and table, and proofs for each row.

Per source the rows' hashes (leaves) are put in order by ``doc_id``; while several nodes remain,
every ``ARITY`` neighbours become their hash. The sources' roots are treated likewise.

*Midstates.* A parent keeps, for every child slot, a copy of its hash state from before that child
(``Parent``). Folding a claimed row upwards resumes the state of its slot with the replacement and
the right siblings only; what stands left of it is never hashed again.

*In Spark.* Leaves are hashed inside the JVM; only ids and 32-byte digests are shuffled. Rows are
numbered by a range sort, so a source with a third of all rows is spread over tasks like any other.
Blocks of ``ARITY ** LEVELS`` neighbours become subtrees, one at a time in a task; block roots are the
nodes of the next round, until each source has one. On the way down a block gets its path to the
root once, and folds its rows through its own subtree and then through that path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from trendloom.llm.common import settle

ARITY, LEVELS = 3, 6
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<slot int, children array<string>>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon, and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**replaced: Column) -> Column:
    """32-byte hash of a row of documents, columns named in ``replaced`` taken from there."""
    return F.unhex(F.sha2(F.concat(*[encoded(replaced.get(c, F.col(c))) for c in FIELDS]), 256))


class Parent:
    """The hash of a run of children, with the state from before each of them."""

    def __init__(self, children: list[bytes]):
        self.children, self.before = children, []
        state = hashlib.sha256()
        for child in children:
            self.before.append(state.copy())
            state.update(child)
        self.value = state.hexdigest().encode()

    def fold(self, slot: int, replacement: bytes) -> bytes:
        state = self.before[slot].copy()
        state.update(b"".join([replacement, *self.children[slot + 1 :]]))
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> bytes:
        return b"".join(self.children[:slot] + self.children[slot + 1 :])


class Subtree:
    """The tree over a block of nodes: ``levels`` of parents, or as many as leave one node."""

    def __init__(self, nodes: list[bytes], levels: int | None):
        self.rows: list[list[Parent]] = []
        now = nodes
        while len(now) > 1 if levels is None else len(self.rows) < levels:
            self.rows.append([Parent(now[i : i + ARITY]) for i in range(0, len(now), ARITY)])
            now = [p.value for p in self.rows[-1]]
        self.root = now[0]

    def steps(self, at: int) -> Iterable[tuple[int, Parent]]:
        """Slot and parent on the way up from node ``at``."""
        for row in self.rows:
            yield at % ARITY, row[at // ARITY]
            at //= ARITY


_NODES = "g string, idx long, n long, node binary"
_WAY = f"g string, idx long, path {PATH}, subroot binary"
_STEPS = pa.list_(pa.struct([("slot", pa.int32()), ("children", pa.list_(pa.string()))]))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of every block, from rows sorted by group, block and idx."""
    block: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if block and (row["block"], row["g"]) != (block[0]["block"], block[0]["g"]):
                yield block
                block = []
            block.append(row)
    if block:
        yield block


def _subtree(block: list[dict]) -> Subtree:
    return Subtree([r["node"].hex().encode() for r in block], LEVELS if block[0]["n"] > BLOCK else None)


def _batch(rows: Iterable[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A node for every block."""
    for block in _blocks(batches):
        top = block[0]
        row = (top["g"], top["block"], -(-top["n"] // BLOCK), bytes.fromhex(_subtree(block).root.decode()))
        yield _batch([row], ["g", "idx", "n", "node"], [pa.string(), pa.int64(), pa.int64(), pa.binary()])


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The way up of every node: through its block, then as the block's root goes on."""
    for above, *block in _blocks(batches):
        tree = _subtree(block)
        step = lambda s, p: {"slot": s, "children": [c.decode() for c in p.children]}
        rows = [(r["g"], r["idx"], [step(s, p) for s, p in tree.steps(i)] + above["path"], above["subroot"]) for i, r in enumerate(block)]
        yield _batch(rows, ["g", "idx", "path", "subroot"], [pa.string(), pa.int64(), _STEPS, pa.binary()])


_HEXES = ("leaf", "subroot", "root", "proof_sha256", "folded_root")


def _proofs(id_kind: pa.DataType):
    """Every leaf's proof and the root folded from its claim."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for above, *block in _blocks(batches):
            tree = _subtree(block)
            path = [(s["slot"], Parent([c.encode() for c in s["children"]])) for s in above["path"]]
            upper = b"".join(p.siblings(s) for s, p in path)
            root = (path[-1][1].value if path else tree.root).decode()
            rows = []
            for i, r in enumerate(block):
                way = list(tree.steps(i))
                proof = hashlib.sha256(b"".join([p.siblings(s) for s, p in way]) + upper).hexdigest()
                value = r["claim"].hex().encode()
                for slot, parent in way + path:
                    value = parent.fold(slot, value)
                folded = value.decode()
                rows.append((r["doc_id"], r["source"], r["node"].hex(), above["subroot"].hex(), root, proof, folded, folded == root))
            yield _batch(rows, ["doc_id", "source", *_HEXES, "verified"], [id_kind, *[pa.string()] * 6, pa.bool_()])

    return work


def numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """Adds ``idx``, the place in group ``g`` under ``order`` (from 0, nulls first), and ``n``, its size.

    A range sort by group and order, then an offset per group and partition: no group meets in one
    task, and rows equal in all of ``order`` are spread too.
    """
    marked = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = marked.repartitionByRange("g", *order, "tie").sortWithinPartitions("g", *order, "tie").drop("tie")
    placed = settle(dealt.withColumn("pos", F.monotonically_increasing_id()).withColumn("part", F.shiftright("pos", 33)), label)
    runs = placed.groupBy("g", "part").agg(F.count(F.lit(1)).alias("size"), F.min("pos").alias("first"))
    group = Window.partitionBy("g")
    before = F.sum("size").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = runs.select("g", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("size").over(group).alias("n"))
    return placed.join(offsets, ["g", "part"]).select(*rows.columns, (F.col("pos") + F.col("shift")).alias("idx"), "n")


def _in_blocks(nodes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """The nodes by block; if asked, behind the row of ``above`` for the block's root."""
    rows = nodes.withColumn("block", F.expr(f"idx DIV {BLOCK}"))
    if above is not None:
        heads = above.select("g", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"), "path", "subroot")
        rows = rows.unionByName(heads, allowMissingColumns=True)
    return rows.repartition("g", "block").sortWithinPartitions("g", "block", "idx")


def grow(nodes: DataFrame, label: str) -> list[DataFrame]:
    """The nodes ``g, idx, n, node`` of every round, the last with one node per group."""
    rounds = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        roots = _in_blocks(rounds[-1].select("g", "idx", "n", "node")).mapInArrow(_roots, _NODES)
        rounds.append(settle(roots, f"{label}-{len(rounds)}"))
        most = -(-most // BLOCK)
    return rounds


def descend(rounds: list[DataFrame], top: DataFrame, label: str) -> DataFrame:
    """``g, idx, path, subroot`` of the nodes of round one, from those of the last round (``top``)."""
    now = top
    for k in range(len(rounds) - 2, 0, -1):
        now = settle(_in_blocks(rounds[k], now).mapInArrow(_ways, _WAY), f"{label}-{k}")
    return now


def prove(docs: DataFrame, **claimed: Column) -> DataFrame:
    """Columns ``doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified``, a row per row.

    ``claimed`` gives columns of documents as someone else holds them (none: the row itself). Their
    leaf is folded with the siblings of the original; ``verified`` says whether that gives ``root``.
    ``proof_sha256`` is the hash of all siblings, level by level, from left to right.

    Digests are lowercase hex and enter hashes as hex text. Missing values are ``-``; a missing
    source is a source of its own, before all others; missing ids come first in their source.
    Repeated rows are leaves of their own, side by side; rows of one id are ordered by leaf. A
    source's lone leaf is its root, a lone source's root the table's. No rows give no row.
    """
    rows = docs.select(encoded(F.col("source")).alias("g"), "source", "doc_id", leaf_of().alias("node"), leaf_of(**claimed).alias("claim"))
    # Written first: the range sort reads its rows twice, and texts should be hashed once.
    rows = settle(rows, "merkle-hashes")
    leaves = settle(numbered(rows, ["doc_id", "node", "claim"], "merkle-order"), "merkle-leaves")
    below = grow(leaves, "merkle-rows")
    named = below[-1].select("g", "node").join(leaves.where("idx = 0").select("g", "source"), "g")
    sources = named.select(F.lit("").alias("g"), F.col("g").alias("of"), "source", "node")
    sources = settle(numbered(sources, ["source"], "merkle-sources"), "merkle-subroots")
    above = grow(sources, "merkle-top")
    way = above[-1].select("g", F.lit(0).cast("long").alias("idx"), F.array().cast(PATH).alias("path"), F.col("node").alias("subroot"))
    if len(above) > 1:  # else a lone source's root is the top
        way = _in_blocks(sources.select("g", "idx", "n", "node"), descend(above, way, "merkle-down")).mapInArrow(_ways, _WAY)
    tops = sources.join(way.select("idx", "path"), "idx")
    tops = settle(tops.select(F.col("of").alias("g"), F.lit(0).cast("long").alias("idx"), "path", F.col("node").alias("subroot")), "merkle-tops")
    doc_id = leaves.schema["doc_id"]
    texts = [T.StructField(c, T.StringType()) for c in ("source", *_HEXES)]
    schema = T.StructType([doc_id, *texts, T.StructField("verified", T.BooleanType())])
    return _in_blocks(leaves, descend(below, tops, "merkle-paths")).mapInArrow(_proofs(to_arrow_type(doc_id.dataType)), schema)
