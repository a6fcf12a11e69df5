"""Operators without SQL against plain brute force, on odd and on empty tables."""

import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trendloom.llm import (
    decontaminate, elias_fano, near_dedup, ngram_lm, piece_codec, quality_rules, sharding, span_dedup, suffix_dedup,
    token_counts, url_filters,
)

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


# Codec and token counts


def test_codec_equals_the_library(documents, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = by_id(piece_codec.digest_documents(documents, PIECES))
    for k, t in enumerate(texts):
        ids = model.encode(t or "")
        expected = (len(ids) + 1, sha(" ".join(map(str, [*ids, 2])).encode()), sha(model.decode(ids).encode()))
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == expected


def test_codec_round_trip(documents, texts):
    back = by_id(piece_codec.decode_documents(piece_codec.encode_documents(documents, PIECES), PIECES))
    assert all(back[k].text == (t or "") for k, t in enumerate(texts))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="▁ ab\n<>0x", max_size=90))
def test_codec_and_counts_on_any_text(text):
    model, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.codec(PIECES)
    ids = own.encode(text)
    assert ids == model.encode(text) and own.pieces.text(ids) == model.decode(ids)
    library = Tokenizer.from_file(BYTES)
    counting = token_counts.Counting(BYTES, {})
    for t in (text, text + "<|endoftext|>" + text):
        assert counting.text(t) == len(library.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("n", [1, 15, 16, 17, 47, 48, 49, 64, 100, 333])
def test_codec_on_runs_of_blanks(n):
    model, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.codec(PIECES)
    for text in (" " * n, " " * n + "a", "b" + " " * n + "a"):
        assert own.encode(text) == model.encode(text)


def test_texts_longer_than_a_piece(monkeypatch, texts):
    monkeypatch.setattr(token_counts, "PIECE", 50)
    monkeypatch.setattr(piece_codec, "GROUP", 40)
    library, model = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counting, own = token_counts.Counting(BYTES, {}), piece_codec.codec(PIECES)
    for t in (x for x in texts if x):
        assert counting.text(t) == len(library.encode(t, add_special_tokens=False).ids)
        assert own.encode(t) == model.encode(t)


def test_token_counts_equal_the_library(documents, texts):
    library, got = Tokenizer.from_file(BYTES), by_id(token_counts.count_tokens(documents, BYTES))
    for k, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((t or "").encode()), n, n > 512)


# Near copies and repeated strings


def groups(texts, percent=80, size=5):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    top = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = top[i], top[j]
                top = [min(x, y) if z in (x, y) else z for z in top]
    return sets, top


@pytest.mark.parametrize(("members", "size"), [(1_000, 4), (7, 5)])
def test_near_copies_equal_all_pairs(monkeypatch, documents, texts, members, size):
    monkeypatch.setattr(near_dedup, "MEMBERS", members)
    sets, top = groups(texts, size=size)
    got = by_id(near_dedup.find_groups(documents, size=size))
    assert len(set(top)) < len(texts) - 25
    for k in range(len(texts)):
        assert (got[k].n_shingles, got[k].component_id, got[k].kept) == (len(sets[k]), top[k], top[k] == k)


def test_near_copies_without_ids(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d  e\tf"), (2, "other words are here now"), (3, None)]
    got = near_dedup.find_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, ((r.doc_id, r.component_id, r.kept) for r in got))) == sorted(
        map(str, [(None, None, True), (1, 1, True), (2, 1, False), (2, 2, True), (3, 3, True)])
    )


def test_one_of_each_keeps_the_columns(documents, texts):
    kept = near_dedup.keep_one_of_each(documents)
    _, top = groups(texts)
    assert kept.columns == documents.columns
    assert sorted({r.doc_id for r in kept.collect()}) == sorted(set(top))


def test_one_row_of_each_group_stays(spark, documents, texts):
    """Repeated rows leave one row; a text without a copy stays beside another text of its id."""
    rows = near_dedup.keep_one_of_each(documents).collect()
    _, top = groups(texts)
    assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((k, texts[k] or "") for k in set(top))
    long = [" ".join(f"{w}{k}" for k in range(120)) for w in ("one", "two", "three")]
    more = [(1, long[0], 5), (2, long[0], 5), (2, long[1], 5), (3, long[2], 6), (3, long[2], 7), (3, long[2], 6), (4, None, 0), (4, None, 0)]
    more += [(5, long[2] + " end", 8), (6, "", 1), (6, None, 1), (7, "some few words here now", 1), (7, "Some few words  here now", 1)]
    more += [(None, long[0], 9), (None, long[0], 9)]
    docs = spark.createDataFrame(more, "doc_id long, text string, n_chars long").repartition(4)
    once = near_dedup.keep_one_of_each(docs)
    left = [(1, long[0], 5), (2, long[1], 5), (3, long[2], 6), (4, None, 0), (6, "", 1), (6, None, 1), (None, long[0], 9), (None, long[0], 9)]
    got = [tuple(r) for r in once.collect()]
    assert sorted(map(str, (x for x in got if x[0] != 7))) == sorted(map(str, left)) and len([x for x in got if x[0] == 7]) == 1
    cut = {r.doc_id: r.text for r in suffix_dedup.cut_documents(once.where("doc_id < 4")).collect()}
    assert cut == {1: long[0], 2: long[1], 3: long[2]}


def without_repeats(raws):
    size = suffix_dedup.LENGTH
    seen = collections.Counter(r[k : k + size] for r in raws for k in range(len(r) - size + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - size + 1):
            if seen[r[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        out.append((bytes(x for x, g in zip(r, gone, strict=True) if not g), len([p for p in bytes(gone).split(b"\0") if p])))
    return out


@pytest.mark.parametrize("piece", [1 << 20, 128])
def test_repeated_strings_equal_brute_force(monkeypatch, documents, texts, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    raws = [(r.text or "").encode() for r in documents.orderBy("doc_id").collect()]
    got = sorted(suffix_dedup.digests(documents).collect(), key=lambda r: r.doc_id)
    expected = [(len(r), len(r) - len(k), n, sha(k)) for r, (k, n) in zip(raws, without_repeats(raws), strict=True)]
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == expected


def without_later_copies(rows, size):
    """Texts by (id, text) without what strings cover that start at an earlier place too."""
    first, out = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - size + 1):
            if first.setdefault(raw[k : k + size], (doc, k)) != (doc, k):
                gone[k : k + size] = b"\1" * size
        out[doc, text] = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("size", [144, 250])
def test_first_copies_stay(spark, documents, texts, size):
    more = [(500, "ab" * 300 + texts[11]), (501, "x" + "ab" * 200), (502, "one more " + texts[11] + texts[12]), (None, texts[12]), (None, None)]
    docs = documents.select("doc_id", "text", F.lit(1).alias("my key")).union(spark.createDataFrame([(*r, 1) for r in more], "doc_id long, text string, k int"))
    found = suffix_dedup.remove_repeats(docs, size, keep_first=True)
    expected = without_later_copies([(r.doc_id, r.text) for r in docs.collect()], size)
    rows = found.collect()
    assert len(rows) == docs.count() and found.select("row.*").columns == docs.columns
    assert all(bytes(r.kept) == expected[r.row.doc_id, r.row.text] for r in rows)
    assert sum(r.n_removed > 0 for r in rows) > 10


def test_cut_documents_keep_their_columns(documents):
    cut = suffix_dedup.cut_documents(documents)
    assert cut.columns == documents.columns and cut.count() == documents.count()
    assert cut.where("text IS NOT NULL AND n_chars <> length(text)").count() == 0


def test_spans_over_repeated_rows_and_clashing_columns(documents):
    got = span_dedup.remove_repeated_spans(documents).select("row.*", "n_sentences", "removed", "kept_text")
    assert got.count() == documents.count()
    assert got.where("size(removed) = 0 AND kept_text <> coalesce(text, '')").count() == 0


def test_spans_of_a_passage_in_two_long_sentences(spark):
    first, second = "one " * 26 + "one.", "two " * 26 + "two."
    rows = [(1, f"A start. {first} {second} An end."), (2, f"Another. {first} {second} Other end."), (3, f"Third. {second}"), (4, f"It goes on, {first} {second}")]
    found = by_id(span_dedup.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), width=2).select("row.doc_id", "kept_text"))
    assert [found[k].kept_text for k in (1, 2, 3, 4)] == [rows[0][1], "Another. Other end.", rows[2][1], "It goes on,"]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .!,;:\n\t\x0bé", max_size=60))
def test_pieces_of_any_text(text):
    cut = span_dedup.cutter()
    own = span_dedup.pieces(text.encode(), cut)
    assert all(p == p.strip() and p for p in own)
    assert b"".join(b"".join(own).split()) == b"".join(text.encode().split())


# Benchmark


def distance_in(pattern, text):
    """Least edits between the pattern and any part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc ", min_size=1, max_size=24), st.text(alphabet="abc ", max_size=60))
def test_bit_parallel_distance(pattern, text):
    masks = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    best = decontaminate.best_match(pattern, masks, text, len(pattern))
    assert (best[0] if best else len(pattern)) == distance_in(pattern, text)


@pytest.mark.parametrize("block", [1_000_000, 150])
def test_edited_items_are_found(spark, block):
    import random

    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz "
    items = [(k, "".join(rng.choice(letters) for _ in range(90))) for k in range(12)] + [(50, None), (51, "?"), (3, None)]
    docs, expected = [], []
    for k, item in items[:12]:
        edited, pattern = list(item), decontaminate.normal(item)
        for place in rng.sample(range(90), k % 6):
            edited[place] = rng.choice("xyz")
        text = "Begin " + "".join(rng.choice(letters) for _ in range(200)) + "; " + "".join(edited).upper() + "! end"
        docs.append((k, text))
        distance = distance_in(pattern, decontaminate.normal(text))
        if distance <= len(pattern) // decontaminate.SHARE:
            expected.append((k, k, distance))
    docs += [(100, None), (101, ""), (102, "clean text"), (0, docs[0][1])]
    expected.append(expected[0])
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(d, b, block=block).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == sorted(expected) and len(expected) > 8
    left = decontaminate.drop_contaminated(d, b, block=block)
    assert sorted(r.doc_id for r in left.collect()) == sorted(x for x, _ in docs if x not in {e[0] for e in expected})


# Sharding


def test_shards(documents, texts):
    rows = sharding.assign(documents).collect()
    assert len(rows) == documents.count() and {r.law for r in rows} == {"key"}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_a_weight_moves_rows_of_its_subtree_only(spark):
    def tree(weight):
        leaf = lambda s: sharding.Node(f"s{s}", shard=s, own_weight=weight if s == 2 else 1.0)
        rack = lambda k: sharding.Node(f"r{k}", (leaf(2 * k), leaf(2 * k + 1)))
        return sharding.Node("root", (sharding.Node("a", (rack(0), rack(1))), sharding.Node("b", (rack(2), rack(3)))))

    key = F.col("id").cast("string")
    both = spark.range(20_000).select(sharding.descend(key, tree(1.0)).alias("x"), sharding.descend(key, tree(3.0)).alias("y"))
    moves = {(r.x, r.y): r["count"] for r in both.groupBy("x", "y").count().collect()}
    # Outside region a, no row moves between other shards, and none leaves the heavier shard.
    assert all(x == y or y < 4 for x, y in moves) and all(y == 2 for x, y in moves if x == 2)
    assert all(not (x in (0, 1) and y in (0, 1) and x != y) for x, y in moves)
    share = sum(n for (_, y), n in moves.items() if y == 2) / 20_000
    assert abs(share - 0.3) < 0.02


# URL filters


def test_entries_hold_from_their_day_on(spark):
    captures = spark.createDataFrame(
        [
            (1, "https://User@Shop.Example.org:80/a", "2024-01-05 23:59:59"), (2, "http://shop.example.org./", "2024-01-10 00:00:00"),
            (3, "http://example.org", "2024-01-31 12:00:00"), (4, "not a url", "2024-01-31 12:00:00"), (5, None, None),
            (5, "http://other.net/x", "2024-01-31 12:00:00"), (6, "http://shop.example.org/a", None),
        ],
        "page_id long, url string, fetched string",
    ).withColumn("fetched", F.to_timestamp("fetched"))
    entries = spark.createDataFrame(
        [
            ("x", "shop.example.org", "2024-01-02", "block"), ("x", "shop.example.org", "2024-01-10", "allow"),
            ("y", "example.org", "2024-01-06", "allow"), ("y", "example.org", "2024-01-06", "block"), ("y", None, "2024-01-01", "block"),
            ("z", "example.org", "2024-01-20", "block"), ("z", "example.org", "2024-01-20", "block"), ("z", "org", None, "block"),
        ],
        "list string, key string, day string, action string",
    ).withColumn("day", F.to_date("day"))
    got = sorted((r.page_id, r.host, r.n_active, r.blocked, r.blocking_lists) for r in url_filters.evaluate(captures, entries).collect() if r.host)
    assert got == [
        (1, "shop.example.org", 1, True, "x"), (2, "shop.example.org", 2, True, "y"), (3, "example.org", 2, True, "y,z"),
        (5, "other.net", 0, False, ""), (6, "shop.example.org", 0, False, ""),
    ]
    assert url_filters.evaluate(captures, entries).count() == 7
    assert url_filters.evaluate(captures, entries.limit(0)).where("blocked").count() == 0


# Language model


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (1_000, 10**6), (5_000, 3_000), (2_000, 2**63), (300, 301)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        own = elias_fano.EliasFano.build(values)
        assert (own.at(np.arange(n)) == values).all()
        asked = np.r_[values, rng.integers(0, top, 500, dtype=np.uint64)]
        if n:
            assert (own.successor(asked) == np.searchsorted(values, asked)).all()
        assert ((own.find(asked) >= 0) == np.isin(asked, values)).all()


@pytest.mark.parametrize(("words", "successors"), [(500_000, 1_000_000), (20, 40)])
def test_scores(monkeypatch, documents, texts, words, successors):
    monkeypatch.setattr(ngram_lm, "WORDS", words)
    monkeypatch.setattr(ngram_lm, "SUCCESSORS", successors)
    every = [(r.doc_id, [*(r.text or "").encode().lower().split(), b"\n"]) for r in documents.collect()]
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    c, pairs = collections.Counter(), collections.Counter()
    for k, w in every:
        if not held(k):
            c.update(w)
            pairs.update(zip([b"\n", *w], w, strict=False))
    total, kinds = sum(c.values()), len(c)
    rest = collections.Counter({v: 1.0 for v in c})
    for (v, _), n in pairs.items():
        rest[v] -= (n - ngram_lm.DISCOUNT) / c[v] if n > 1 else 0
    got = by_id(ngram_lm.train_and_score(documents))
    for k, w in every:
        base = [(c[x] + 1) / (total + kinds + 1) for x in w]
        p = [(pairs[v, x] - ngram_lm.DISCOUNT) / c[v] * (pairs[v, x] > 1) + rest.get(v, 1.0) * b if c[v] else b for v, x, b in zip([b"\n", *w], w, base, strict=False)]
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(k), len(w), sum(c[x] > 0 for x in w), total)
        assert math.isclose(r.base_score, sum(map(math.log10, base)), rel_tol=1e-9)
        # A byte rounds each of the two terms down by a step at most.
        assert -2 * len(w) / ngram_lm.STEPS <= r.score - sum(map(math.log10, p)) <= 1e-6


def test_query_scores_with_pairs_seen_once(spark, documents, tmp_path):
    from trendloom.llm import queries

    documents.write.parquet(f"{tmp_path}/documents.parquet")
    every = [(r.doc_id, [*(r.text or "").encode().lower().split(), b"\n"]) for r in documents.collect()]
    c, pairs = collections.Counter(), collections.Counter()
    for k, w in every:
        if zlib.crc32(str(k).encode()) % 7 != 2:
            c.update(w)
            pairs.update(zip([b"\n", *w], w, strict=False))
    assert 1 in pairs.values()
    total, kinds = sum(c.values()), len(c)
    stored = collections.Counter()
    for (v, _), n in pairs.items():
        stored[v] += (n - ngram_lm.DISCOUNT) / c[v]
    got = by_id(queries.QUERIES["op7_ngram_trie"](spark, str(tmp_path)))
    for k, w in every:
        p = []
        for v, x in zip([b"\n", *w], w, strict=False):
            seen = (pairs[v, x] - ngram_lm.DISCOUNT) / c[v] if pairs[v, x] else 0
            p.append(seen + (1 - stored[v]) * (c[x] + 1) / (total + kinds + 1))
        assert -2 * len(w) / ngram_lm.STEPS <= got[k].score - sum(map(math.log10, p)) <= 1e-6


# Empty tables


def test_empty_tables(spark, nothing):
    items = spark.createDataFrame([], "item_id long, text string")
    for found in (
        piece_codec.digest_documents(nothing, PIECES), token_counts.count_tokens(nothing, BYTES), near_dedup.find_groups(nothing),
        suffix_dedup.digests(nothing), span_dedup.remove_repeated_spans(nothing), quality_rules.judge(nothing), sharding.assign(nothing),
        ngram_lm.train_and_score(nothing), decontaminate.find_leaks(nothing, items), decontaminate.drop_contaminated(nothing, items),
        near_dedup.keep_one_of_each(nothing), suffix_dedup.cut_documents(nothing),
    ):
        assert found.count() == 0


# All items against all documents


def test_leaks_equal_all_pairs(spark):
    """By the full table of distances; short items as whole words only. Clashing columns, a very long text."""
    import random

    rng = random.Random(9)
    words = ["cat", "con", "the", "river", "bank", "a", "über", "3rd"]
    phrase = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, phrase(rng.randint(1, 7))) for k in range(25)] + [(90, "cat"), (91, "a"), (92, None), (93, " -- "), (94, "cat")]
    docs = [(k, phrase(rng.randint(1, 25))) for k in range(60)]
    docs += [(100, "concatenate banks"), (101, "The CAT!"), (102, "a-3rd"), (103, None), (104, ""), (105, "zz " * 30_000 + "cat"), (101, "The CAT!")]
    for k in range(20):  # with an edit or two
        t = list(phrase(4) + " " + (items[k][1] or "") + " " + phrase(3))
        t[rng.randrange(len(t))] = "x"
        docs.append((200 + k, "".join(t)))
    expected = collections.Counter()
    for d, text in docs:
        own = decontaminate.normal(text or "")
        for i, item in items:
            pattern = decontaminate.normal(item or "")
            k = len(pattern) // decontaminate.SHARE
            hit = f" {pattern} " in f" {own} " if not k else len(own) < 1000 and distance_in(pattern, own) <= k
            if pattern and own and hit:
                expected[d, i] += 1
    frame = spark.createDataFrame([(d, t, 0, 0) for d, t in docs], "doc_id long, text string, item_id int, distance int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (40, 1_000_000):
        found = decontaminate.find_leaks(frame, bench, block=block).collect()
        assert collections.Counter((r.doc_id, r.item_id) for r in found) == expected
        left = decontaminate.drop_contaminated(frame, bench, block=block)
        assert left.columns == frame.columns
        assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in docs if not any(p[0] == d for p in expected))


# What a worker holds


def test_later_tasks_of_a_worker_find_what_earlier_ones_made(spark):
    import os

    import pyarrow as pa

    from trendloom.llm.common import worker_wide

    def work(batches):
        made = []
        for _ in batches:
            pass
        worker_wide(("test", "tasks"), lambda: made.append(1) or [])
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([len(made)])], ["pid", "made"])

    rows = spark.range(12).repartition(12).mapInArrow(work, "pid long, made long").collect()
    assert len(rows) > len({r.pid for r in rows}) >= sum(r.made for r in rows)
