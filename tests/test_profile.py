import pytest
from pyspark.sql import functions as F

from golden import EPO_COUNTS, EU10_BY_YEAR, EU10_TOTALS
from trendloom.operators import compare, profile
from trendloom.schemas import EU10, YEARS


@pytest.fixture
def eu10(spark):
    """One row per counted document."""
    cells = [(c, y, n) for c, counts in EU10_BY_YEAR.items() for y, n in zip(YEARS, counts) if n]
    df = spark.createDataFrame(cells, "country string, year int, n int")
    return df.select("country", "year", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))


def test_country_tables(eu10):
    matrix = {r.country: r for r in profile.country_year_matrix(eu10, "country", EU10).collect()}
    assert {c: [matrix[c][f"y{y}"] for y in YEARS] for c in EU10} == EU10_BY_YEAR
    table = profile.country_breakdown(eu10, "country", 3).collect()
    assert [(r.country, r.total) for r in table] == [("DE", 2369), ("FR", 1085), ("NL", 912)]
    assert round(table[0].slope, 2) == 33.95
    assert table[0].share == pytest.approx(2369 / sum(EU10_TOTALS.values()) * 100)
    assert round(2369 / 20387 * 100, 2) == 11.62 and sum(EPO_COUNTS.values()) == 42801


LABELS = [
    ("1", 2010, "success", True, "classical_ml", "nlp_text", "applied"),
    ("2", 2010, "success", True, "speech_audio", "nlp_text", "both"),
    ("3", 2010, "success", True, "ai_hardware", None, None),
    ("4", 2012, "success", True, None, "robotics", "fundamental"),
    ("5", 2012, "success", False, None, None, "applied"),
    ("6", 2012, "parse_error", None, None, None, None),
]
SCHEMA = "doc_id string, year int, status string, is_genuine_ai boolean, ai_technique string, application_domain string, innovation_orientation string"


@pytest.fixture
def rowset(rows):
    return profile.with_tech_groups(rows(SCHEMA, LABELS))


def test_counts_and_shares(rowset):
    kept = profile.genuine(rowset)
    assert {r.year: r.n for r in profile.count_by_year(kept).collect()} == {2010: 3, 2012: 1}
    dense = {r.year: r.n for r in profile.count_by_year_dense(kept).collect()}
    assert len(dense) == 14 and dense[2010] == 3 and dense[2011] == 0
    assert [tuple(r) for r in profile.value_counts_topk(kept, "application_domain", 1).collect()] == [("nlp_text", 2)]
    shares = {r.application_domain: r.share for r in profile.share_of_total(kept, "application_domain").collect()}
    assert shares == {"nlp_text": 50.0, "robotics": 25.0}
    cells = profile.row_share(profile.crosstab_long(kept, "year", "innovation_orientation"), "year").collect()
    assert {(r.year, r.innovation_orientation): r.share for r in cells} == {
        (2010, "applied"): 50.0, (2010, "both"): 50.0, (2012, "fundamental"): 100.0,
    }
    by_year = {r.year: r.share for r in profile.conditional_share_by_year(kept, F.col("innovation_orientation") == "applied").collect()}
    assert by_year[2010] == pytest.approx(100 / 3) and by_year[2012] == 0 and by_year[2011] is None
    matrix = {r.year: (r.applied, r.both) for r in profile.crosstab(kept, "year", "innovation_orientation", ["applied", "both"]).collect()}
    assert matrix == {2010: (1, 1), 2012: (0, 0)}


def test_fixed_table(rowset):
    table = profile.fixed_crosstab(profile.genuine(rowset)).orderBy("row_pos", "col_pos").collect()
    assert len(table) == 64 and sum(r.n for r in table) == 2
    speech = [r for r in table if r.tech_grouped2 == "speech_audio_tech"]
    assert {r.application_domain: r.share for r in speech if r.n} == {"nlp_text": 100.0}
    assert all(r.share is None for r in table if r.tech_grouped2 == "optimization")


def test_summaries(rowset):
    s = profile.label_summary(rowset).first()
    assert (s.total, s.success, s.genuine, s.non_genuine) == (6, 5, 4, 1)
    assert (s.genuine_pct, s.non_genuine_pct) == (80.0, 20.0)
    empty = profile.label_summary(rowset.where("false")).first()
    assert empty.total == 0 and empty.success_pct is None
    missing = {r["column"]: r.n_missing for r in profile.missing_count(rowset, "ai_technique", "year").collect()}
    assert missing == {"ai_technique": 3, "year": 0}
    top = profile.all_dimension_profile(rowset, 1, ["ai_technique", "application_domain"]).collect()
    assert {(r.dimension, r.value, r.n) for r in top} == {("ai_technique", "ai_hardware", 1), ("application_domain", "nlp_text", 2)}


def test_half_even_rounding(rows):
    df = rows("year int, ok boolean", [(2010, i < 1) for i in range(16)] + [(2011, i < 3) for i in range(16)])
    # 6.25 and 18.75 percent.
    assert {r.year: r.pct for r in profile.coverage_by_year(df, "ok").collect()} == {2010: 6.2, 2011: 18.8}
    report = profile.coverage_report(df, "ok").first()
    assert (report.flag, report.n_true, report.total, report.pct) == ("ok", 4, 32, 12.5)


def test_two_offices(rows):
    data = [("USPTO", y, "applied" if i < y - 2008 else "both", "classical_ml") for y in (2010, 2011, 2013) for i in range(8)]
    data += [("EPO", 2012, "applied", None)]
    df = rows("office string, year int, innovation_orientation string, ai_technique string", data)
    table = {r.year: r for r in compare.side_by_side(compare.yearly_comparison(df)).collect()}
    assert len(table) == 14 and table[2010].uspto_n == 8 and table[2012].uspto_n == 0 and table[2012].epo_n == 1
    assert table[2012].uspto_applied_share is None
    assert table[2012].uspto_fitted == pytest.approx(50.0) and table[2012].epo_fitted is None
    shares = {(r.office, r.technique): r.share for r in compare.technique_comparison(df).collect()}
    assert shares[("USPTO", "Classical ML")] == 100.0 and shares[("EPO", "Classical ML")] == 0.0 and len(shares) == 12


def test_crosstab_keeps_unlisted_values(rows):
    table = profile.crosstab(rows("year int, o string", [(2010, "a"), (2010, "z"), (2011, None), (2011, "y")]), "year", "o", ["a"])
    assert sorted(tuple(r) for r in table.collect()) == [(2010, 1, 1), (2011, 0, 1)]
