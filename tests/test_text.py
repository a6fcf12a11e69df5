import json

import pytest
from pyspark.sql import functions as F

from trendloom.functions import answers, labels, text
from trendloom.functions.ids import document_key, id_kind, join_key, source_tag
from trendloom.operators.keywords import emergence_rate, keyword_match
from trendloom.schemas import EMERGING_FAMILIES, LABELS, SHORT_LABELS, VOCABULARY

FENCE = "```"
OBJECT = '{"is_genuine_ai": true, "ai_technique": "classical_ml", "confidence": "high"}'
ANSWERS = [
    OBJECT,
    f"{FENCE}\n{OBJECT}\n{FENCE}",
    f"{FENCE}json\n{OBJECT}\n{FENCE}",
    f"Sure.\n{FENCE}json\n{OBJECT}\n{FENCE}\nDone {{ok}}",
    f"Here it is: {OBJECT} I hope this helps.",
    OBJECT.replace('"', "'"),
    "{}",
    " { } ",
    f"{OBJECT} {OBJECT}",
    f"{OBJECT}, {OBJECT}",
    f'{OBJECT}, "x": {{}}',
    f"{OBJECT}}} {{\"x\": {OBJECT}",
    OBJECT[:30],
    OBJECT + "}",
    "",
    None,
    "   ",
    OBJECT.replace("true", "null"),
    OBJECT.replace("true", '"True"'),
    OBJECT.replace("true", '" false "'),
    OBJECT.replace("true", "1"),
    OBJECT.replace("}", ', "doc_id": "other", "more": {"a": [1, {"b": "}"}]}}'),
    OBJECT.replace("high", "Größe é 中 😀"),
    OBJECT.replace("}", ",}"),
    "{is_genuine_ai: true}",
    "no braces at all",
    "} reversed {",
    f"[{OBJECT}]",
    "42",
    "null",
    '"text"',
    "[]",
    f"\n\t {OBJECT} \n",
    f"{FENCE}{FENCE}",
    f"text {FENCE} {OBJECT}",
    '{"is_genuine_ai": false, "ai_technique": "a", "is_genuine_ai": true, "ai_technique": null}',
    '{"is_genuine_ai": true, "ai_technique": "b", "score": NaN, "more": {"x": -Infinity, "x": 2}}',
    '{"is_genuine_ai": true}, "answer": {"ai_technique": "c"}',
    '{"is_genuine_ai": true, "complete": false}',
    '{"is_genuine_ai": true,}',
]


def by_hand(answer, style):
    """(status, genuine word, technique) as the rules say, with the standard JSON reader."""
    t = (answer or "").strip()
    try:
        if style == "braces":
            if FENCE in t:
                t = t.split(FENCE)[1]
                t = t[4:] if t.startswith("json") else t
            a, b = t.find("{"), t.rfind("}") + 1
            found = json.loads(t[a:b]) if a >= 0 and b > 0 else None
            if not found:
                return "parse_error", None, None
        else:
            if t.startswith(FENCE):
                t = t.split(FENCE)[1]
                t = t[4:] if t.startswith("json") else t
            found = json.loads(t)
    except ValueError:
        return ("json_error" if style == "pilot" else "parse_error"), None, None
    if not isinstance(found, dict):
        return ("error" if style == "pilot" else "parse_error"), None, None
    word = str(found.get("is_genuine_ai")).strip().lower()
    return "success", {"true": True, "false": False}.get(word), found.get("ai_technique")


@pytest.mark.parametrize("style", ["braces", "prefix", "pilot"])
def test_parse_labels_against_plain_python(rows, style):
    df = rows("doc_id string, answer string", [(str(i), a) for i, a in enumerate(ANSWERS)])
    found = {int(r.doc_id): r for r in answers.parse_labels(df, "answer", style).collect()}
    assert len(found) == len(ANSWERS)
    for i, answer in enumerate(ANSWERS):
        r = found[i]
        assert (r.status, r.is_genuine_ai, r.ai_technique) == by_hand(answer, style), (style, answer)
        assert r.raw_response == (None if r.status == "success" else (answer or "")[:200])


def test_label_schemas(rows):
    df = rows("doc_id string, answer string", [("a", OBJECT)])
    assert answers.parse_labels(df).columns == ["doc_id", *LABELS.names, "status", "raw_response"]
    assert len(LABELS) == 12 and len(SHORT_LABELS) == 9
    assert {k: len(v) for k, v in VOCABULARY.items()} == {
        "ai_technique": 11, "application_domain": 21, "data_modality": 6, "innovation_orientation": 3,
        "core_ai_task": 7, "contribution_type": 5, "training_paradigm": 5, "confidence": 3,
    }
    with pytest.raises(ValueError):
        answers.parse_labels(df, "answer", "loose")


def test_text_helpers(rows):
    df = rows("t string", [("  a b\n",), (None,), (" \t",), ("x" * 301,)])
    found = df.select(
        text.clean_text(F.col("t")), text.blank_to_null(F.col("t")), text.longer_than(F.col("t"), 2), text.ellipsize(F.col("t"))
    ).collect()
    assert [tuple(r)[:3] for r in found[:3]] == [("a b", "a b", True), ("", None, False), ("", None, False)]
    assert found[3][3] == "x" * 300 + "..." and found[0][3] == "  a b\n"


def test_prompts(rows):
    df = rows("t string, a string, c string", [(" T ", "A" * 700, "C" * 900), (None, " ", ""), (None, "B" * 900, None)])
    full = [r[0] for r in df.select(text.prompt_full("S", F.col("t"), F.col("a"), F.col("c"))).collect()]
    head, tail = "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"
    assert full[0] == f"{head}Title: T\n\nAbstract: {'A' * 600}\n\nFirst Independent Claim: {'C' * 800}{tail}"
    assert full[1] == f"{head}No text available.{tail}"
    short = [r[0] for r in df.select(text.prompt_short("S", F.col("t"), F.col("a"))).collect()]
    assert short[0] == f"{head}Title: T\nAbstract: {'A' * 700}{tail}"
    assert short[1] == f"{head}Abstract: {tail}" and short[2] == f"{head}Abstract: {'B' * 800}{tail}"
    pilot = [r[0] for r in df.select(text.prompt_pilot(F.col("t"), F.col("a"))).collect()]
    assert pilot[2] == f"Title: \n\nAbstract: {'B' * 900}"
    assert "one of high, medium, low" in text.label_instructions(VOCABULARY)


def test_labels(rows):
    df = rows("v string", [("True",), (" false ",), ("TRUE\n",), ("yes",), (None,)])
    assert [r[0] for r in df.select(labels.normalise_bool(F.col("v"))).collect()] == [True, False, True, None, None]
    codes = rows("c string", [("a",), ("z",), (None,)])
    mapping = {"a": "A"}
    found = codes.select(
        labels.recode(F.col("c"), mapping), labels.recode_nullable(F.col("c"), mapping), labels.caption(F.col("c"), mapping)
    ).collect()
    assert [tuple(r) for r in found] == [("A", "A", "A"), ("other", None, "z"), ("other", None, None)]


def test_ids(rows):
    cases = {
        "123456": "granted", "12345678": "granted", "12345": "unknown", "123456789": "unknown", "20100157034": "pregrant",
        "19991234567": "unknown", "RE43918": "reissue", "RE43918x": "unknown", " 7778441 ": "granted", "D123": "unknown",
    }
    df = rows("id string", [(k,) for k in cases])
    found = df.select("id", id_kind(F.col("id")), join_key(F.col("id")), source_tag(F.col("id")), document_key(F.col("id")))
    for doc, kind, key, source, document in found.collect():
        assert kind == cases[doc], doc
        assert key == doc.strip().removeprefix("RE")
        assert source == ("granted" if kind in ("granted", "reissue") else "pregrant")
        assert (document == key) == (kind != "unknown")


def test_keywords(rows):
    texts = [
        (2010, "A Large-Language model"), (2010, "agency"), (2010, "an AGENT, planning"), (2011, None),
        (2011, "distilled"), (2011, "pre-trained" + "x" * 20 + "model"), (2011, "pre-trained" + "x" * 21 + "model"),
        (2011, "Agentenverhalten ohne ägent"), (2011, "split\nlearning"),
    ]
    df = rows("year int, t string", texts)
    hits = df.select(*[keyword_match(F.col("t"), p).alias(str(i)) for i, p in enumerate(EMERGING_FAMILIES.values())]).collect()
    assert [tuple(h) for h in hits] == [
        (True, False, False, False), (False, False, False, False), (False, False, True, False), (False,) * 4,
        (False, False, False, True), (True, False, False, False), (False,) * 4, (False,) * 4, (False,) * 4,
    ]
    rates = {(r.family, r.year): (r.hits, r.per_thousand) for r in emergence_rate(df, "t").collect()}
    assert rates[("Foundation models / LLMs", 2010)][0] == 1
    assert rates[("Model distillation", 2011)] == (1, pytest.approx(1000 / 6))


def test_packed_texts(spark, monkeypatch):
    monkeypatch.setattr(text, "UNPACKED_BYTES", 1000)  # several pieces a batch
    texts = [None, "", "x", "0", "1", "Größe é 中\n", "a line of prose, a line\n" * 90, "".join(map(chr, range(1, 3000)))] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    bad = df.limit(1).select(F.lit(-1).alias("id"), F.expr("CAST(X'61ff62' AS STRING)").alias("text"))
    stored = df.union(bad).select("*", text.packed(F.col("text")).alias("packed"))
    found = stored.select("id", "text", "packed", text.unpacked(F.col("packed")).alias("back"))
    assert found.where(~F.col("text").cast("binary").eqNullSafe(F.col("back").cast("binary"))).count() == 0
    size = {r.id: (r.n, r.m) for r in found.select("id", F.octet_length("text").alias("n"), F.octet_length("packed").alias("m")).collect()}
    assert len(size) == len(texts) + 1 and size[0] == (None, None) and size[2] == (1, 2) and size[6][1] < 100 < size[6][0]
