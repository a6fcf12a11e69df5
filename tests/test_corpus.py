import pytest

from trendloom.operators import corpus
from trendloom.schemas import CLAIMS_RAW  # noqa: F401

UNIVERSE = [
    ("7000001", 2010), ("7000001", 2010), ("20100000010", 2011), ("RE0000020", 2012), ("X9", 2013), ("7000002", 2014),
    ("20100000011", 2015), ("RE0000040", 2016),
]
TITLES = [("7000001", " First "), ("0000020", "Reissue"), ("7000001", "Zweiter"), ("7000002", "  "), ("X9", "none")]
GRANTED = [("7000001", None), ("7000001", "granted abstract"), ("RE0000040", "kept its prefix"), ("7000002", "short")]
PREGRANT = [("20100000010", "pre-grant abstract"), ("20100000011", "\t\n")]
CLAIMS = [
    # 2010 granted counts from 0; 2011 granted from 1; pre-grant always from 1.
    ("7000001", "granted", 2010, "0", " 1. A device"), ("7000001", "granted", 2010, "1", "2. The device"),
    ("7000001", "granted", 2010, "0", "1. Another copy"), ("7000002", "granted", 2011, "0", "Claims:"),
    ("7000002", "granted", 2011, " 1 ", "1. A method"), ("7000002", "granted", 2010, "0", "1. An earlier method"),
    ("0000020", "granted", 2012, "1", "1. Of a reissue"), ("0000020", "granted", 2012, "0", "no number"),
    ("20100000010", "pregrant", 2011, "1", "1. Published"), ("20100000010", "pregrant", 2011, "2", "2. Also"),
    ("20100000010", "granted", 2010, "0", "1. In the wrong file"), ("7000001", "pregrant", 2009, "1", "1. Outside"),
    ("9999999", "granted", 2010, "0", "1. Unknown document"), ("X9", "pregrant", 2011, "1", "1. Unknown shape"),
]


@pytest.fixture
def t(rows):
    class Inputs:
        universe = rows("doc_id string, year int", UNIVERSE)
        titles = rows("patent_id string, patent_title string", TITLES)
        granted = rows("patent_id string, patent_abstract string", GRANTED)
        pregrant = rows("pgpub_id string, application_abstract string", PREGRANT)
        claims = rows("patent_id string, claim_type string, year int, seq string, text string", CLAIMS)

    return Inputs


@pytest.mark.parametrize("hot_rows", [1, None])
def test_assemble_text(t, hot_rows):
    df = corpus.assemble_text(t.universe, t.titles, t.granted, t.pregrant, hot_rows)
    found = sorted(tuple(r) for r in df.collect())
    assert found == sorted([
        ("7000001", "First", "granted abstract", "granted", True, True),
        ("7000001", "First", "granted abstract", "granted", True, True),
        ("20100000010", "", "pre-grant abstract", "pregrant", False, True),
        ("RE0000020", "Reissue", "", "granted", True, False),
        ("X9", "", "", "pregrant", False, False),
        ("7000002", "", "short", "granted", False, False),
        ("20100000011", "", "", "pregrant", False, False),
        ("RE0000040", "", "kept its prefix", "granted", False, True),
    ])


def test_first_claims(t):
    picked = corpus.first_claim(t.claims)
    assert sorted((r.year, r.seq, r.text) for r in picked.collect() if r.claim_type == "granted") == [
        (2010, "0", " 1. A device"), (2010, "0", "1. An earlier method"), (2010, "0", "1. Another copy"),
        (2010, "0", "1. In the wrong file"), (2010, "0", "1. Unknown document"), (2011, "1", "1. A method"),
        (2012, "1", "1. Of a reissue"),
    ]
    records = corpus.claim_records(t.claims, t.universe)
    found = sorted(tuple(r) for r in corpus.first_claim_dedup(records).collect())
    assert found == [
        ("20100000010", "1. Published", "pregrant", 2011), ("7000001", "1. A device", "granted", 2010),
        ("7000002", "1. An earlier method", "granted", 2010), ("RE0000020", "1. Of a reissue", "granted", 2012),
    ]
    coverage = corpus.claim_coverage(records, t.universe).first()
    assert coverage[:4] == (4, 1, 4, 6) and coverage.coverage_pct == pytest.approx(400 / 6)


def test_first_claims_straight_from_bulk_rows(spark, t):
    steps = corpus.first_claim_dedup(corpus.claim_records(t.claims, t.universe))
    as_rows = lambda df: sorted(map(repr, df.collect()))
    twice = t.universe.union(t.universe)
    direct = corpus.first_claims(t.claims, twice)
    assert as_rows(direct) == as_rows(steps) and direct.columns == steps.columns
    assert corpus.first_claims(t.claims.where("false"), t.universe).count() == 0
    assert corpus.first_claims(t.claims, t.universe.where("false")).count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = corpus.first_claims(t.claims, t.universe)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # Claims once, universe once; the third is the small table of claim files.
    assert plan.count("hashpartitioning(key") == 2 and plan.count("Exchange hashpartitioning") == 3


@pytest.mark.parametrize("hot_rows", [1, None])
def test_one_plan_equals_the_steps(t, hot_rows):
    texts = corpus.assemble_text(t.universe, t.titles, t.granted, t.pregrant)
    claims = corpus.first_claim_dedup(corpus.claim_records(t.claims, t.universe))
    steps = corpus.corpus_left_join(t.universe, texts, claims, hot_rows)
    plan = corpus.model_corpus(t.universe, t.titles, t.granted, t.pregrant, t.claims, hot_rows).select(steps.columns)
    as_rows = lambda df: sorted(map(repr, df.collect()))
    assert as_rows(plan) == as_rows(steps)
    first = steps.where("doc_id = '7000001'").first()
    assert first.has_both and steps.count() == len(UNIVERSE)
    missing = steps.where("doc_id = 'X9'").first()
    assert (missing.title, missing.abstract, missing.has_abstract, missing.has_claim) == (None, None, False, False)


@pytest.mark.parametrize("hot_rows", [1, None])
def test_universe(t, hot_rows):
    assert {r.kind: r.n for r in corpus.universe_counts(t.universe).collect()} == {
        "granted": 3, "pregrant": 2, "reissue": 2, "unknown": 1, "total": 8,
    }
    kept = corpus.restrict_to_universe(t.claims, t.universe, "patent_id", hot_rows=hot_rows)
    assert sorted({r.patent_id for r in kept.collect()}) == ["0000020", "20100000010", "7000001", "7000002"]
    only = corpus.restrict_to_universe(t.claims, t.universe, "patent_id", "pregrant", hot_rows)
    assert {r.patent_id for r in only.collect()} == {"20100000010"}


def test_sample_ids(rows):
    """Shapes of the published validation sample: 63 pre-grant, 31 seven- and 18 eight-digit ids."""
    ids = [f"2010{i:07d}" for i in range(63)] + [f"77784{i:02d}" for i in range(31)] + [f"107784{i:02d}" for i in range(18)]
    counts = corpus.universe_counts(rows("doc_id string", [(i,) for i in ids]))
    assert {r.kind: r.n for r in counts.collect()} == {"pregrant": 63, "granted": 49, "total": 112}


def test_text_flags(rows):
    df = rows("title string, abstract string", [("ab ", "1234567890"), ("abc", " 12345678901 "), (None, None), ("nan", "")])
    flags = [(r.has_title, r.has_abstract) for r in corpus.text_flags(df).collect()]
    assert flags == [(False, False), (True, True), (False, False), (True, False)]


def test_first_claims_of_any_year_and_kind(rows):
    data = [("1", "granted", 2005, "0", "1. A"), ("2", "granted", 2024, "1", "B"), ("3", "design", 2012, "1", "C"), ("3", "design", 2012, "2", "D")]
    picked = corpus.first_claim(rows("patent_id string, claim_type string, year int, seq string, text string", data))
    assert sorted(r.text for r in picked.collect()) == ["1. A", "B", "C"]
