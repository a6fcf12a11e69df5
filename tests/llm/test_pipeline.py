"""The pipeline's stages on a small table, each against what its operator must do."""

import hashlib

import public_tokenizers
import sentencepiece

import corpus_pipeline
from test_text_operators import without_later_copies
from trendloom.llm import decontaminate, quality_rules


def test_stages(spark, documents, texts, tmp_path):
    docs = documents.select("doc_id", "text", "lang", "source", "n_chars")
    clean = "The man of the house was in the garden with a friend and it is not for the dog to say. "
    more = [(1000 + k, clean.replace("dog", f"dog{k}") + " ".join(f"{w * 4}{k * j} stands" for j, w in enumerate("abcdefghijklmnop"))) for k in range(5)]
    leak = "what is the capital of the northern province in the year of the great flood"
    more += [(2000, more[0][1] + " " + leak), (2001, more[0][1])]
    # Two texts of their own that share a passage of 55 words.
    passage = " ".join(f"shared{k}" for k in range(55))
    more += [(3000 + j, more[j + 1][1] + " " + " ".join(f"and{j}x{k} the" for k in range(60)) + " " + passage) for j in range(2)]
    extra = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in more], docs.schema)
    docs.union(extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = [own]
    for _, stage in corpus_pipeline.STAGES:
        found.append(stage(spark, found[-1], str(tmp_path)))
    ids = [sorted(r.doc_id for r in f.collect()) for f in found]
    for f in found[1:-1]:
        assert sorted(f.columns) == sorted(own.columns)
    good = {r.row.doc_id for r in quality_rules.judge(own).where("kept").select("row").collect()}
    assert set(ids[1]) == good and set(range(1000, 1005)) <= good
    assert set(ids[2]) <= set(ids[1]) and 2001 not in ids[2] and 1000 in ids[2]
    assert ids[3] == ids[2]
    before = [(r.doc_id, r.text) for r in found[2].collect()]
    expected = without_later_copies(before, corpus_pipeline.REPEATED_BYTES)
    after = {r.doc_id: r for r in found[3].collect()}
    for k, t in before:
        assert after[k].text == (None if t is None else expected[k, t].decode("utf-8", "ignore"))
        assert after[k].n_chars == (None if t is None else len(after[k].text))
    assert passage in after[3000].text and passage not in after[3001].text
    cut = {r.doc_id: r.text for r in found[3].collect()}
    held = decontaminate.Leaks([(1, leak)])
    assert set(ids[4]) == {k for k in ids[3] if not held.find(cut[k] or "")} and 2000 not in ids[4]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in found[5].collect():
        expected = " ".join(map(str, [*model.encode(cut[r.doc_id] or ""), 2]))
        assert r.ids_sha256 == hashlib.sha256(expected.encode()).hexdigest()
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == ids[5]
