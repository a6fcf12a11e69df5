import hashlib
import random

import pytest

from trendloom.operators import sampling


@pytest.fixture
def docs(rows):
    draw = random.Random(1)
    data = []
    for i in range(900):
        year = 2010 if i < 300 else 2010 + draw.randrange(14)
        genuine = draw.random() < 0.5
        orientation = draw.choice(["fundamental", "applied", "applied", "both"]) if genuine else None
        technique = draw.choice(["a", "b", "c", None]) if genuine else None
        data.append((f"d{i:04d}", year, genuine, technique, orientation, None if genuine else f"r{i % 5}"))
    schema = "doc_id string, year int, is_genuine_ai boolean, ai_technique string, innovation_orientation string, false_positive_reason string"
    return rows(schema, data), data


def place(doc, seed=42):
    return hashlib.md5(f"{doc}:{seed}".encode()).hexdigest(), doc


def allocate(counts, size):
    total = sum(counts.values())
    alloc = {y: round(n / total * size) for y, n in sorted(counts.items())}
    gap = size - sum(alloc.values())
    for y in sorted(alloc, key=lambda y: (-alloc[y], y))[: abs(gap)]:
        alloc[y] += 1 if gap > 0 else -1
    return alloc


@pytest.mark.parametrize("size", [7, 100, 113, 250])
def test_allocation(docs, size):
    df, data = docs
    counts = {y: sum(r[1] == y for r in data) for y in {r[1] for r in data}}
    found = {r.year: r.alloc for r in sampling.proportional_alloc(df, size).collect()}
    assert found == allocate(counts, size) and sum(found.values()) == size


def test_stratified_sample(docs):
    df, data = docs
    found = sorted(r.doc_id for r in sampling.stratified_sample(df, "doc_id", 100).collect())
    again = sorted(r.doc_id for r in sampling.stratified_sample(df.repartition(7), "doc_id", 100).collect())
    counts = {y: sum(r[1] == y for r in data) for y in {r[1] for r in data}}
    expected = []
    for year, n in allocate(counts, 100).items():
        expected += sorted((r[0] for r in data if r[1] == year), key=place)[:n]
    assert found == again == sorted(expected) and len(found) == 100
    other = sorted(r.doc_id for r in sampling.stratified_sample(df, "doc_id", 100, seed=1).collect())
    assert other != found and len(other) == 100


def test_balanced_sample(docs):
    df, data = docs
    found = sampling.balanced_sample(df, "doc_id").collect()
    assert len(found) == 14 * 2 * 4 == 112
    for year in range(2010, 2024):
        for flag in (True, False):
            pool = sorted((r[0] for r in data if r[1] == year and r[2] == flag), key=place)[:4]
            assert sorted(r.doc_id for r in found if r.year == year and r.is_genuine_ai == flag) == sorted(pool)


def test_diverse_sample(docs):
    df, _ = docs
    found = sampling.diverse_sample(df, "doc_id").collect()
    parts = [r.part for r in found]
    assert parts == ["fundamental"] * 5 + ["applied"] * 4 + ["both"] * 2 + ["non_genuine"] * 3
    assert {r.ai_technique for r in found if r.part == "applied"} == {"a", "b", "c", None}
    few = df.where("innovation_orientation != 'fundamental' OR doc_id < 'd0012' OR innovation_orientation IS NULL")
    small = [r.part for r in sampling.diverse_sample(few, "doc_id").collect()]
    assert "fundamental" not in small and small.count("both") == 2


def test_review_sample(docs):
    df, data = docs
    twelve = df.where("doc_id < 'd0012'")
    n_genuine = sum(r[2] for r in data[:12])
    found = sampling.review_sample(twelve, "doc_id", 10).collect()
    assert [r.is_genuine_ai for r in found[:n_genuine]] == [True] * n_genuine
    reasons = [r.false_positive_reason for r in found[n_genuine:]]
    assert len(set(reasons)) == len(reasons) == min(10 - n_genuine, len({r[5] for r in data[:12] if not r[2]}))
    assert len(sampling.review_sample(df, "doc_id", 10).collect()) == 10


def test_samples_read_their_rows_once(spark, docs, tmp_path):
    docs[0].write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    samples = [
        sampling.stratified_sample(df, "doc_id"), sampling.balanced_sample(df, "doc_id"),
        sampling.diverse_sample(df, "doc_id"), sampling.review_sample(df, "doc_id"),
    ]
    for sample in samples:
        plan = sample._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1
        raw = plan[plan.index("MapInArrow"):]
        assert "Window" not in raw and "Exchange" not in raw and "Sort" not in raw


def test_samples_of_nothing_and_of_clashing_columns(docs):
    df, data = docs
    nothing = df.where("false")
    for draw in (sampling.stratified_sample, sampling.balanced_sample, sampling.diverse_sample, sampling.review_sample):
        assert draw(nothing, "doc_id").count() == 0
    clash = df.withColumnRenamed("false_positive_reason", "n")
    assert sampling.stratified_sample(clash, "doc_id").columns == [*clash.columns, "rank"]
    unknown = df.selectExpr("doc_id", "CASE WHEN doc_id < 'd0450' THEN year END AS year")
    known = {y: sum(r[1] == y and r[0] < "d0450" for r in data) for y in {r[1] for r in data}}
    found = {r.year: r["count"] for r in sampling.stratified_sample(unknown, "doc_id").groupBy("year").count().collect()}
    wanted = {y: round(n / 900 * 100) for y, n in sorted(known.items())}
    gap = 100 - sum(wanted.values())
    for y in sorted(wanted, key=lambda y: (-wanted[y], y))[:gap]:
        wanted[y] += 1
    assert found == {y: min(n, known[y]) for y, n in wanted.items() if min(n, known[y])}
