import pytest

from trendloom.operators import agreement as A

# Published cells of the second batch: (second rater, first labels) -> documents.
CELLS = {(True, True): 40, (True, False): 4, (False, True): 16, (False, False): 52}


@pytest.fixture
def pairs(rows):
    data, i = [], 0
    for (rater, first), n in CELLS.items():
        for _ in range(n):
            joint = rater and first
            data.append((rater, first, "a", "a" if joint and i < 20 else "b", "x", "x" if joint and i < 34 else "y"))
            i += 1
    return rows("rater boolean, first boolean, t1 string, t2 string, o1 string, o2 string", data)


def test_published_agreement(pairs):
    assert {(r.rater, r.first): r.n for r in A.confusion(pairs, "rater", "first").collect()} == CELLS
    k = A.cohen_kappa(pairs, "rater", "first").first()
    assert (round(k.po, 6), round(k.pe, 6), round(k.kappa, 6)) == (0.821429, 0.5, 0.642857)
    f = A.recall_f1(pairs, "first", "rater").first()
    assert (round(f.recall, 6), round(f.precision, 6), round(f.f1, 6)) == (0.714286, 0.909091, 0.8)
    other = A.recall_f1(pairs, "rater", "first").first()
    assert round(other.recall, 6) == round(40 / 44, 6)
    rates = {r.dimension: r.pct for r in A.agreement_rate(pairs, ["rater", "first"], {"t": ("t1", "t2"), "o": ("o1", "o2")}).collect()}
    assert rates == {"t": 50.0, "o": 85.0}


def test_weighted_and_pooled(rows, pairs):
    batches = rows("batch string, n bigint, kappa double", [("1", 100, 0.82), ("2", 112, 0.642857)])
    assert A.weighted_mean(batches).first().kappa == pytest.approx(0.726415, abs=1e-6)
    twice = pairs.selectExpr("*", "1 AS batch").unionByName(pairs.selectExpr("*", "2 AS batch"))
    found = {r.batch: (r.n, round(r.kappa, 6)) for r in A.combine_batches(twice, "rater", "first", "batch").collect()}
    assert found == {"1": (112, 0.642857), "2": (112, 0.642857), "weighted": (224, 0.642857), "pooled": (224, 0.642857)}


def test_kappa_many_classes(rows):
    data = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 4 + [("c", "a")] + [("c", "c")] * 3 + [("c", None)]
    k = A.cohen_kappa(rows("x string, y string", data), "x", "y").first()
    po, pe = 12 / 15, (7 * 6 + 4 * 6 + 4 * 3) / 225
    assert (k.n, k.kappa) == (15, pytest.approx((po - pe) / (1 - pe)))
    single = A.cohen_kappa(rows("x string, y string", [("a", "a")] * 3), "x", "y").first()
    assert single.po == 1 and single.kappa is None


def test_label_checks(rows):
    schema = "is_genuine_ai boolean, confidence string, innovation_orientation string"
    df = rows(schema, [(True, "high", "applied"), (True, "sure", None), (False, None, "applied"), (False, None, None), (None, "low", "x")])
    vocabulary = {"confidence": ["high", "medium", "low"], "innovation_orientation": ["applied"]}
    found = {r.dimension: (r.n_null, r.n_outside, r.total) for r in A.schema_conformance(df, vocabulary).collect()}
    assert found == {"confidence": (2, 1, 5), "innovation_orientation": (2, 1, 5)}
    filled = {r.field: (r.n_filled, r.rows) for r in A.null_rule_check(df, ["confidence", "innovation_orientation"]).collect()}
    assert filled == {"confidence": (0, 2), "innovation_orientation": (1, 2), "any": (1, 2)}
