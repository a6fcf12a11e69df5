import math

import pytest
from pyspark.sql import functions as F

from golden import EPO_COUNTS, EU10_BY_YEAR, EU10_SLOPES, EU10_TOTALS
from trendloom import schemas as S
from trendloom.operators import trends
from trendloom.schemas import YEARS


@pytest.fixture
def counts(rows):
    return rows("year int, n bigint", list(EPO_COUNTS.items()))


def test_exponential_fit(counts, rows):
    fit = trends.exp_growth_fit(counts).first()
    assert round(fit.a, 2) == pytest.approx(546.51) and round(fit.b, 6) == 0.212524
    assert fit.growth_pct == pytest.approx(23.6796, abs=1e-3) and round(fit.r2, 6) == 0.977205
    curve = trends.fit_curve_points(trends.exp_growth_fit(counts)).orderBy("point").collect()
    assert len(curve) == 300 and curve[0].x == 2010 and curve[-1].x == 2023
    assert curve[0].fitted == pytest.approx(fit.a)
    log_slope = trends.group_slope(counts.select("year", F.ln("n").alias("n"))).first().slope
    assert round(log_slope, 6) == 0.199703


def test_fit_per_group(rows):
    exact = [("down", y, float(1000 * 2.718281828459045 ** (-0.3 * (y - 2010)))) for y in YEARS]
    data = exact + [("two", 2010, 1.0), ("two", 2011, 2.0)] + [("flat", y, 5.0) for y in YEARS]
    fits = {r.g: r for r in trends.exp_growth_fit(rows("g string, year int, n double", data), "g").collect()}
    assert fits["down"].b == pytest.approx(-0.3, abs=1e-6) and fits["down"].a == pytest.approx(1000, abs=1e-2)
    assert fits["two"].a is None and fits["two"].n_years == 2
    assert fits["flat"].b == pytest.approx(0, abs=1e-6) and fits["flat"].r2 is None


def test_slopes(rows):
    data = [(c, y, n) for c, counts in EU10_BY_YEAR.items() for y, n in zip(YEARS, counts) if n]
    found = {r.c: round(r.slope, 2) for r in trends.group_slope(rows("c string, year int, n int", data), "c").collect()}
    assert found == EU10_SLOPES


def test_scatter(rows):
    points = rows("total int, inv double", [(EU10_TOTALS[c], v) for c, v in S.EU10_INVESTMENT_2023.items()] + [(5, None)])
    fit = trends.scatter_fit(points, "inv", "total").first()
    assert (fit.n, round(fit.r, 6), round(fit.slope, 7), round(fit.intercept, 4)) == (10, 0.816992, 0.0618216, -189.3846)


def test_investment_regression(counts, spark):
    amounts = trends.literal_dimension(spark, S.EU10_INVESTMENT, "year", "int")
    rows = trends.regression_features(counts.join(amounts, "year"))
    both = rows.withColumn("office", F.lit("EPO")).unionByName(
        rows.where("covid = 0").withColumn("office", F.lit("no pandemic years"))
    )
    model = trends.log_log_ols(both, "office")
    found = {r.term: r for r in model.where("office = 'EPO'").collect()}
    assert [round(found[t].coef, 6) for t in ("const", "covid", "log_inv")] == [-4.506944, 0.086584, 1.14291]
    assert [round(found[t].se, 6) for t in ("const", "covid", "log_inv")] == [0.43586, 0.051582, 0.039713]
    assert (round(found["covid"].ci_low, 6), round(found["covid"].ci_high, 6)) == (-0.039634, 0.212802)
    assert (round(found["log_inv"].ci_low, 6), round(found["log_inv"].ci_high, 6)) == (1.045736, 1.240084)
    assert round(found["const"].r2, 6) == 0.994068 and found["const"].n == 9
    singular = model.where("office = 'no pandemic years'").collect()
    assert len(singular) == 3 and all(r.coef is None and r.se is None for r in singular)
    fitted = trends.log_log_fitted(both.where("office = 'EPO'"), model, "office")
    logs = fitted.select("office", F.ln("n").alias("observed"), F.ln("fitted").alias("fitted"))
    assert round(trends.r_squared(logs, "observed", "fitted", "office").first().r2, 6) == 0.994068


def test_student_quantiles():
    known = {1: 12.706205, 2: 4.302653, 3: 3.182446, 6: 2.446912, 10: 2.228139, 11: 2.200985}
    assert {d: round(trends.t_quantile_975(d), 6) for d in known} == known


def test_changes(counts):
    jump = trends.yoy_jump(counts).first()
    assert (jump.jump, round(jump.pct_jump, 4)) == (1594, round(1594 / 3579 * 100, 4))
    change = trends.avg_annual_change(counts).first()
    assert change.pre_avg == pytest.approx((3579 - 766) / 9) and change.post_avg == pytest.approx((8032 - 3579) / 4)


def test_stack_and_ends(rows):
    matrix = rows("year int, a bigint, b bigint", [(2010, 1, 3), (2011, 0, 0), (2012, 2, 0)])
    edges = {(r.year, r.category): (r.lower, r.upper) for r in trends.stack_bounds(matrix, ["a", "b"]).collect()}
    assert edges[(2010, "a")] == (0, 25) and edges[(2010, "b")] == (25, 100) and edges[(2011, "a")] == (None, None)
    shares = rows("year int, c string, share double", [(2010, "a", 1.0), (2012, "a", 3.0), (2011, "a", 2.0), (2011, "b", 9.0)])
    ends = {r.c: (r.first_year, r.first_value, r.last_year, r.last_value) for r in trends.first_last_value(shares, "c").collect()}
    assert ends == {"a": (2010, 1.0, 2012, 3.0), "b": (2011, 9.0, 2011, 9.0)}


def test_linear_trend_skips_empty_years(rows):
    df = rows("year int, v double", [(2010, 1.0), (2011, None), (2012, 3.0)])
    found = trends.linear_trend(df, "v").orderBy("year").collect()
    assert [r.slope for r in found] == [1.0] * 3 and found[1].fitted == pytest.approx(2.0)


@pytest.mark.parametrize("b", [1.5, -1.5, 6.0])
def test_steep_growth_is_found(rows, b):
    data = [(2010 + x, 3.0 * math.exp(b * x)) for x in range(8)]
    fit = trends.exp_growth_fit(rows("year int, n double", data)).first()
    assert math.isclose(fit.b, b, abs_tol=1e-5) and fit.r2 > 0.999999


def test_growth_takes_all_years(rows):
    data = [(2001 + x, 50.0 * math.exp(0.2 * x)) for x in range(24)]
    fit = trends.exp_growth_fit(rows("year int, n double", data)).first()
    assert fit.n_years == 24 and math.isclose(fit.b, 0.2, abs_tol=1e-6)


def test_interval_for_many_rows(rows):
    data = [("x", k % 2, float(k), 1.0 + 0.5 * (k % 2) + 0.3 * k + (k * 7 % 5) / 10) for k in range(60)]
    terms = trends.log_log_ols(rows("g string, covid int, log_inv double, log_patents double", data), "g").collect()
    assert len(terms) == 3 and all(t.ci_low < t.coef < t.ci_high for t in terms)
    # The published quantile for 57 degrees of freedom.
    assert all(math.isclose((t.ci_high - t.coef) / t.se, 2.002465, abs_tol=1e-5) for t in terms)


def test_jump_needs_the_year_before(rows):
    assert trends.yoy_jump(rows("year int, n long", [(2018, 5), (2020, 9)])).first().jump is None


@pytest.mark.parametrize("b", [1.5, -1.5, 0.7, -0.01, 3.0])
def test_growth_agrees_with_halving(rows, b):
    """Counts off the curve: the exponent is where the slope of the error changes sign."""
    data = [(2010 + x, round(1000 * math.exp(b * x) * (1 + 0.1 * (x % 3 - 1)), 3)) for x in range(9)]
    w = lambda c, k: sum(n * (y - 2010) ** k * math.exp(c * (y - 2010)) for y, n in data)
    u = lambda c, k: sum((y - 2010) ** k * math.exp(2 * c * (y - 2010)) for y, _ in data)
    low, high = b - 0.3, b + 0.3
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if w(mid, 1) * u(mid, 0) - w(mid, 0) * u(mid, 1) > 0 else (low, mid)
    fit = trends.exp_growth_fit(rows("year int, n double", data)).first()
    assert math.isclose(fit.b, mid, abs_tol=1e-9) and math.isclose(fit.a, w(mid, 0) / u(mid, 0), rel_tol=1e-9)
