"""Line dedup, conversation tries and manifests against brute force, on odd, hot and empty tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trendloom.llm import bloom, line_dedup, merkle, prefix_trie

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Lines


def expected_lines(rows, min_chars=20, min_docs=3, keep=max):
    """(id, lines, dropped, text) of every row; ids None come first."""
    key, rank = lambda x: x.strip(BLANK).translate(LOWER), lambda d: (d is not None, d or 0)
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(rank(doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if len(k := key(x)) < min_chars or len(held[k]) < min_docs or keep(held[k]) == rank(doc)]
        out.append((doc, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def lines_of(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.select("row.doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=repr)


@pytest.fixture
def line_rows():
    common, shared = "This line is on a third of all pages", "É" * 19 + "x"
    rows = [(k, f"{common.upper() if k % 2 else common}  \nown line number {k} of this table\n\t{common}") for k in range(30)]
    rows += [(100 + k, "é" * 19 + f"\n{shared}\nshort\r\n{'漢' * 20}\n") for k in range(4)]
    rows += [(200, "twice in one text, but nowhere else\ntwice in one text, but nowhere else"), (201, "x" * 200_000), (202, "\n" * 3000)]
    rows += [(None, common), (None, None), (300, None), (301, ""), (302, " \n \x0b\n"), (5, rows[5][1]), (103, rows[33][1])]
    rows += [(400, "found in two documents only, so it stays"), (401, "found in two documents only, so it stays")]
    return rows


@pytest.mark.parametrize("keep", ["last", "first"])
def test_lines(spark, line_rows, keep):
    data = [(d, t, 1, "row", b"k") for d, t in line_rows]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_lines int, row string, `my key` binary").repartition(5)
    found = line_dedup.remove_repeated_lines(docs, keep=keep)
    assert lines_of(found) == expected_lines(line_rows, keep=max if keep == "last" else min)
    assert found.select("row.*").columns == docs.columns


def test_lines_with_small_panes_a_full_filter_and_hot_keys_in_parts(spark, line_rows, monkeypatch):
    """Neither size of the filters nor parts of hot keys nor flushes show in the result."""
    docs = spark.createDataFrame(line_rows, "doc_id long, text string").repartition(4)
    expected = expected_lines(line_rows, 5, 2)
    for changed in ({"PANE": 64, "MAX_BITS": 64}, {"PANE": 64, "BITS": 200}, {"FLUSH": 1}, {"HOT_ROWS": 4}):
        with monkeypatch.context() as m:
            for name, value in changed.items():
                m.setattr(line_dedup if name == "HOT_ROWS" else bloom, name, value)
            assert lines_of(line_dedup.remove_repeated_lines(docs, 5, 2)) == expected


def test_few_single_keys_are_suspected(spark):
    rows = [(k, "\n".join(f"line {j} of document {k}, met nowhere else" for j in range(200))) for k in range(100)]
    docs = spark.createDataFrame([*rows, (1000, rows[0][1])], "doc_id long, text string").repartition(4)
    found = line_dedup.suspects(docs)
    assert 400 <= found.count() <= 400 + 0.03 * 20_000


def test_lines_of_nothing(spark, nothing):
    found = line_dedup.digests(nothing)
    assert found.collect() == [] and found.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


# Tries


def expected_nodes(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                kids[path[: d - 1]].add(path[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, m in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(m) - 1) * (len(path[-1][1].encode()) if path else 0)
    return sorted(
        (
            (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(",".join(map(str, sorted(ends[p])))))
            for p, m in members.items()
        ),
        key=repr,
    )


def nodes_of(df):
    return sorted((tuple(r) for r in df.select(*prefix_trie.NODE).collect()), key=repr)


TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture
def turns():
    """A first turn of a third of all conversations, copies, chains, ties, missing values."""
    rng = random.Random(5)
    rows = []
    for c in range(0, 400):
        first = "hot" if rng.random() < 0.4 else f"t{rng.randint(0, 30)}"
        rows += [(c, k, "user" if k % 2 else "", first if k == 0 else rng.choice("abcé漢") * rng.randint(0, 3)) for k in range(rng.randint(1, 9))]
    rows += [(c, k, "user", "copy") for c in range(1000, 1090) for k in range(4)]
    rows += [(2000, k, "user", str(k // 2)) for k in range(120)] + [(2005, k, "user", str(k // 2)) for k in range(121)]
    rows += [(2001, None, None, None), (2001, None, "a", None), (2001, 0, None, "x"), (2002, 1, "b", "x"), (2002, 1, "a", "y"), (2002, 1, "a", "y")]
    return [*rows, (None, 1, "user", "no conversation"), (3004, 0, "u", "its leader is missing")]


@pytest.mark.parametrize("sizes", [None, (40, 20), (1, 1)])
def test_trie(spark, turns, sizes, monkeypatch):
    if sizes:
        monkeypatch.setattr(prefix_trie, "SHARD", sizes[0])
        monkeypatch.setattr(prefix_trie, "CHUNK", sizes[1])
    df = spark.createDataFrame([(*r, 1, "p") for r in turns], TURNS + ", depth int, path string").repartition(3)
    assert nodes_of(prefix_trie.conversation_trie(df)) == expected_nodes(turns)


def test_trie_of_one_and_of_none(spark):
    one = [(7, 0, "user", "alone")]
    assert nodes_of(prefix_trie.conversation_trie(spark.createDataFrame(one, TURNS))) == expected_nodes(one)
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).collect() == []


def test_trie_of_turnless_conversations(spark):
    """Followers whose own turns all go, and whose leader is missing, end at the root."""
    rows = [(c, 0, "user", "only") for c in range(1, 60) if c % 5]
    expected = expected_nodes(rows)
    assert expected[0][1] == 0 and expected[0][-1] != sha("")
    assert nodes_of(prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS))) == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 40), max_size=6), min_size=1, max_size=60))
def test_double_array_holds_exactly_the_prefixes(found):
    length = np.array([len(p) for p in found], np.int64)
    codes = np.array([c for p in found for c in p], np.int64)
    trie = prefix_trie.DoubleArray(codes, np.r_[0, np.cumsum(length)[:-1]], length)
    at = {}
    for depth, live, slots in trie.walk():
        for k, s in zip(live.tolist(), slots.tolist(), strict=True):
            assert at.setdefault(s, tuple(found[k][:depth])) == tuple(found[k][:depth])
    assert len(set(at.values())) == len(at) == (trie.check >= 0).sum()
    assert set(at.values()) == {tuple(p[:d]) for p in found for d in range(len(p) + 1)}


# Manifests


def expected_manifest(rows, claim):
    """rows: doc_id, source, lang, n_chars, text."""
    h = lambda parts: sha("".join(parts))
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = defaultdict(list)
    for r in rows:
        leaf, said = h(map(enc, r)), h(map(enc, (*r[:4], claim(r))))
        by[r[1]].append(((r[0] is not None, r[0] or 0), leaf, said, r))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def way(levels, i):
        for level in levels[:-1]:
            run = i // 3 * 3
            yield level[run:i], level[i + 1 : run + 3]
            i //= 3

    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = tree([x[1] for x in by[s]])
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (_, leaf, value, r) in enumerate(by[s]):
            path = [*way(trees[s], i), *way(top, k)]
            for left, right in path:
                value = h([*left, value, *right])
            proof = h(x for left, right in path for x in left + right)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], proof, value, value == top[-1][0]))
    return sorted(out, key=repr)


def manifest_of(df):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


ROWS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest(spark, levels, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    rng = random.Random(1)
    rows = [(k, rng.choice(["hot", "hot", *"abcdefgé漢", "", None]), "en", k, f"line {k}\n" * rng.randint(0, 3)) for k in range(150)]
    rows += [(None, "hot", None, None, None), (None, None, None, None, "x\n"), (999, "lone", "en", 1, "y" * 100_000 + "\n")]
    rows += [rows[3]] * 8 + [(3, rows[3][1], "de", 7, "another row of that id\n")]
    docs = spark.createDataFrame([(*r, "x", b"y") for r in rows], ROWS + ", leaf string, idx binary").repartition(4)
    claim = lambda r: r[4].replace("\n", "") if r[4] is not None and r[0] is not None and r[0] % 3 == 0 else r[4]
    said = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    assert manifest_of(merkle.prove(docs, text=said)) == expected_manifest(rows, claim)


@pytest.mark.parametrize("rows", [[(1, "a", "en", 2, "t\n")], [(1, "a", "en", 2, "t"), (1, None, "en", 2, "t")], []])
def test_small_manifests(spark, rows):
    found = manifest_of(merkle.prove(spark.createDataFrame(rows, ROWS)))
    assert found == expected_manifest(rows, lambda r: r[4]) and all(r[-1] for r in found)


def test_midstates_resume_with_right_siblings_only():
    children = [sha(str(k)).encode() for k in range(3)]
    own = merkle.Parent(children)
    for slot in range(3):
        changed = [*children[:slot], b"new", *children[slot + 1 :]]
        assert own.fold(slot, b"new") == hashlib.sha256(b"".join(changed)).hexdigest().encode()
        assert own.fold(slot, children[slot]) == own.value
