"""Year-over-year measures and trend fits on per-year tables.

Inputs are aggregated first (one row per group and year of the period), so the unpartitioned
windows and per-group arrays below hold a handful of rows whatever the size of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.schemas import COVID_YEARS, FIRST_YEAR, LAST_YEAR, STACK_ORDER


def year_over_year(counts: DataFrame) -> DataFrame:
    """Difference to the year before, absolute and in percent; NULL where that year has no row."""
    order = Window.orderBy("year")
    previous = F.when(F.lag("year").over(order) == F.col("year") - 1, F.lag("n").over(order))
    jump = counts.withColumn("previous", previous).withColumn("jump", F.col("n") - F.col("previous"))
    return jump.withColumn("pct_jump", F.col("jump") * 100 / F.nullif(F.col("previous"), F.lit(0)))


def yoy_jump(counts: DataFrame, year: int = 2020) -> DataFrame:
    return year_over_year(counts).where(F.col("year") == year)


def avg_annual_change(counts: DataFrame, turn: int = 2019) -> DataFrame:
    """Mean yearly change up to the turning year, and from it on."""
    changes = year_over_year(counts)
    return changes.agg(
        F.avg(F.when(F.col("year") <= turn, F.col("jump"))).alias("pre_avg"),
        F.avg(F.when(F.col("year") > turn, F.col("jump"))).alias("post_avg"),
    )


def stack_bounds(matrix: DataFrame, order: Sequence[str] = STACK_ORDER) -> DataFrame:
    """Lower and upper edge of every category in a stacked share chart.

    ``matrix`` has one row per year and one count column per category.
    """
    long = matrix.unpivot("year", list(order), "category", "n")
    total = F.sum("n").over(Window.partitionBy("year"))
    position = F.array_position(F.array(*map(F.lit, order)), F.col("category")).cast("int")
    shares = long.withColumn("position", position).withColumn(
        "share", F.col("n") * 100 / F.nullif(total, F.lit(0))
    )
    below = Window.partitionBy("year").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return shares.withColumn("upper", F.sum("share").over(below)).withColumn("lower", F.col("upper") - F.col("share"))


def first_last_value(shares: DataFrame, category: str, value: str = "share") -> DataFrame:
    return shares.groupBy(category).agg(
        F.min("year").alias("first_year"), F.min_by(value, "year").alias("first_value"),
        F.max("year").alias("last_year"), F.max_by(value, "year").alias("last_value"),
    )


# --- exponential growth ----------------------------------------------------

#: Points on each side of the first grid; how often it may widen, and by what; steps behind it.
GRID, WIDENINGS, WIDEN, STEPS = 20, 6, 4, 60


def exp_growth_fit(counts: DataFrame, *by: str, origin: int = FIRST_YEAR) -> DataFrame:
    """Least squares of n = a * exp(b * (year - origin)) on the raw counts, per group.

    For a given b the best a is W / B, with W = sum(n e^bx) and B = sum(e^2bx), and the squared
    error is sum(n^2) - W^2 / B. Its slope in b vanishes with h = W' B - W C, C = sum(x e^2bx). A
    coarse grid over [-1, 1], widened as long as its best point lies on the edge, gives a bracket;
    Newton's steps on h, replaced by halving where they leave the bracket, close it. All that runs on the
    group's own short array of years, inside one projection, so the input must have one row per
    group and year; all years given count. Fewer than three years: NULL.
    """
    points = counts.where(F.col("year").isNotNull()).groupBy(*by).agg(
        F.collect_list(F.struct((F.col("year") - origin).cast("double").alias("x"), F.col("n").cast("double").alias("n"))).alias("points"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("sum_sq"),
        (F.var_pop("n") * F.count("n")).alias("sst"),
        F.count("n").alias("n_years"),
    )

    def sums(b: Column, *terms) -> Column:
        """An array of sums over the years, each of a term of (year, e^bx, e^2bx)."""
        def add(acc: Column, p: Column) -> Column:
            e, e2 = F.exp(b * p["x"]), F.exp(b * p["x"] * 2)
            return F.array(*[F.get(acc, k) + t(p["x"], p["n"], e, e2) for k, t in enumerate(terms)])

        return F.aggregate("points", F.array(*[F.lit(0.0)] * len(terms)), add)

    def explained(b: Column) -> Column:
        """W^2 / B, which is greatest where the error is least."""
        return F.element_at(F.transform(
            F.array(sums(b, lambda x, n, e, e2: n * e, lambda x, n, e, e2: e2)), lambda s: F.get(s, 0) * F.get(s, 0) / F.get(s, 1)
        ), 1)

    def wider(best: Column, _round: Column) -> Column:
        grid = F.transform(
            F.sequence(F.lit(-GRID), F.lit(GRID)),
            lambda i: F.struct(
                explained(best["half"] * i / GRID).alias("fit"), (best["half"] * i / GRID).alias("b"),
                F.when(F.abs(i) == GRID, best["half"] * WIDEN).otherwise(best["half"]).alias("half"), (F.abs(i) == GRID).alias("edge"),
            ),
        )
        return F.when(best["edge"], F.array_max(grid)).otherwise(best)

    def step(now: Column, _round: Column) -> Column:
        b = now["b"]
        w, w1, w2, basis, c, c1 = range(6)
        found = sums(
            b, lambda x, n, e, e2: n * e, lambda x, n, e, e2: n * x * e, lambda x, n, e, e2: n * x * x * e,
            lambda x, n, e, e2: e2, lambda x, n, e, e2: x * e2, lambda x, n, e, e2: x * x * e2 * 2,
        )

        def move(s: Column) -> Column:
            v = lambda k: F.get(s, k)
            h = v(w1) * v(basis) - v(w) * v(c)
            slope = v(w2) * v(basis) + v(w1) * v(c) - v(w) * v(c1)
            low, high = F.when(h > 0, b).otherwise(now["low"]), F.when(h > 0, now["high"]).otherwise(b)
            newton = b - h / F.nullif(slope, F.lit(0.0))
            # The lower end may be met exactly: Newton has arrived there.
            inside = (newton >= low) & (newton <= high)
            return F.struct(low.alias("low"), high.alias("high"), F.when(inside, newton).otherwise((low + high) / 2).alias("b"))

        return F.element_at(F.transform(F.array(found), move), 1)

    enough = F.col("n_years") >= 3
    start = F.struct(F.lit(0.0).alias("fit"), F.lit(0.0).alias("b"), F.lit(1.0).alias("half"), F.lit(True).alias("edge"))
    coarse = points.select("*", F.when(enough, F.aggregate(F.sequence(F.lit(1), F.lit(WIDENINGS)), start, wider)).alias("best"))
    width = F.col("best.half") / GRID
    bracket = F.struct((F.col("best.b") - width).alias("low"), (F.col("best.b") + width).alias("high"), F.col("best.b").alias("b"))
    solved = F.when(enough, F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), bracket, step)["b"])
    fits = coarse.select(*by, "n_years", "sum_sq", "sst", "points", solved.alias("b"))
    last = sums(F.col("b"), lambda x, n, e, e2: n * e, lambda x, n, e, e2: e2)
    fits = fits.select(*by, "n_years", "sum_sq", "sst", "b", F.when(F.col("b").isNotNull(), last).alias("s"))
    w, basis = F.get("s", 0), F.get("s", 1)
    return fits.select(
        *by, "n_years", (w / basis).alias("a"), "b", ((F.exp("b") - 1) * 100).alias("growth_pct"),
        (1 - (F.col("sum_sq") - w * w / basis) / F.nullif("sst", F.lit(0.0))).alias("r2"),
    )


def fit_curve_points(fits: DataFrame, *by: str, n_points: int = 300) -> DataFrame:
    """The fitted curve on an even axis over the period."""
    span = float(LAST_YEAR - FIRST_YEAR)
    curve = fits.select(*by, "a", "b", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("point"))
    x = F.lit(float(FIRST_YEAR)) + F.col("point") * span / (n_points - 1)
    fitted = F.col("a") * F.exp(F.col("b") * (F.col("x") - FIRST_YEAR))
    return curve.withColumn("x", x).select(*by, "point", "x", fitted.alias("fitted"))


# --- linear fits -----------------------------------------------------------


def linear_trend(series: DataFrame, value: str, *by: str) -> DataFrame:
    """Slope, intercept and fitted value per year; years without a value do not count."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    slope = F.regr_slope(F.col(value), F.col("year")).over(group)
    intercept = F.regr_intercept(F.col(value), F.col("year")).over(group)
    fits = series.withColumn("slope", slope).withColumn("intercept", intercept)
    return fits.withColumn("fitted", F.col("intercept") + F.col("slope") * F.col("year"))


def group_slope(counts: DataFrame, *by: str) -> DataFrame:
    """Slope of yearly counts over the years that occur."""
    return counts.groupBy(*by).agg(F.regr_slope("n", "year").alias("slope"), F.count("n").alias("n_years"))


def scatter_fit(points: DataFrame, x: str, y: str) -> DataFrame:
    both = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"),
    )


def r_squared(df: DataFrame, observed: str, fitted: str, *by: str) -> DataFrame:
    """1 - SSE / SST per group."""
    error = F.sum((F.col(observed) - F.col(fitted)) ** 2)
    spread = F.var_pop(observed) * F.count(observed)
    return df.groupBy(*by).agg((1 - error / F.nullif(spread, F.lit(0.0))).alias("r2"))


# --- investment regression -------------------------------------------------


def regression_features(counts: DataFrame, investment: str = "amount") -> DataFrame:
    """Logarithms and the pandemic flag of a per-year table."""
    return counts.withColumns(
        {
            "log_patents": F.ln(F.nullif(F.col("n").cast("double"), F.lit(0.0))),
            "log_inv": F.ln(F.nullif(F.col(investment), F.lit(0.0))),
            "covid": F.col("year").isin(COVID_YEARS).cast("int"),
        }
    )


def t_quantile_975(df: int) -> float:
    """Two-sided 95 % Student quantile for whole degrees of freedom, by bisection."""

    def inside(t: float) -> float:
        theta = math.atan2(t, math.sqrt(df))
        cos, sin = math.cos(theta), math.sin(theta)
        term, total = (cos, 0.0) if df % 2 else (1.0, 0.0)
        for j in range(1 + df % 2, df, 2):
            total += term
            term *= cos * cos * j / (j + 1)
        return (theta + sin * total) * 2 / math.pi if df % 2 else sin * total

    low, high = 0.0, 20.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if inside(middle) < 0.95 else (low, middle)
    return low


# Quantiles up to here come from a table, later ones from their expansion in 1 / df, whose error is
# below 1e-8 by then.
TABLE_DF = 40
NORMAL_975 = 1.959963984540054


def t_quantile_expansion(df: Column) -> Column:
    z = NORMAL_975
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    return sum((F.lit(c) / F.pow(df, F.lit(k)) for k, c in enumerate(terms, 1)), F.lit(z))


def log_log_ols(features: DataFrame, *by: str) -> DataFrame:
    """log n ~ 1 + covid + log investment per group, one row per term with 95 % interval.

    The normal equations are solved in closed form from centred sums, one aggregate for any
    number of groups. A group in which a regressor is constant gives NULL.
    """
    rows = features.where(
        F.col("log_patents").isNotNull() & F.col("log_inv").isNotNull() & F.col("covid").isNotNull()
    )
    y, c, v = F.col("log_patents"), F.col("covid"), F.col("log_inv")
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("my"), F.avg(c).alias("mc"), F.avg(v).alias("mv"),
        *[
            (F.covar_pop(left, right) * F.count(F.lit(1))).alias(name)
            for name, left, right in (
                ("scc", c, c), ("svv", v, v), ("scv", c, v), ("scy", c, y), ("svy", v, y), ("syy", y, y),
            )
        ],
    )
    det = F.col("scc") * F.col("svv") - F.col("scv") * F.col("scv")
    solvable = det > F.col("scc") * F.col("svv") * 1e-12
    solved = sums.withColumn("det", F.when(solvable, det)).withColumns(
        {
            "b_covid": F.expr("(scy * svv - svy * scv) / det"),
            "b_log_inv": F.expr("(svy * scc - scy * scv) / det"),
        }
    )
    quantiles = F.create_map(*[F.lit(x) for d in range(1, TABLE_DF + 1) for x in (d, t_quantile_975(d))])
    solved = solved.withColumns(
        {
            "b_const": F.expr("my - b_covid * mc - b_log_inv * mv"),
            "sse": F.expr("syy - b_covid * scy - b_log_inv * svy"),
            "t": F.when(F.col("n") - 3 <= TABLE_DF, F.element_at(quantiles, (F.col("n") - 3).cast("int"))).otherwise(
                t_quantile_expansion(F.col("n") - 3)
            ),
        }
    ).withColumn("s2", F.expr("sse / nullif(greatest(n - 3, 0), 0)"))
    terms = F.array(
        *[
            F.struct(F.lit(term).alias("term"), F.expr(coef).alias("coef"), F.expr(f"sqrt({variance})").alias("se"))
            for term, coef, variance in (
                ("const", "b_const", "s2 * (1 / n + (mc * mc * svv - 2 * mc * mv * scv + mv * mv * scc) / det)"),
                ("covid", "b_covid", "s2 * svv / det"),
                ("log_inv", "b_log_inv", "s2 * scc / det"),
            )
        ]
    )
    r2 = F.expr("1 - sse / nullif(syy, 0D)").alias("r2")
    long = solved.select(*by, "n", r2, "t", F.explode(terms).alias("e"))
    margin = F.col("t") * F.col("e.se")
    return long.select(
        *by, "e.term", "e.coef", "e.se", (F.col("e.coef") - margin).alias("ci_low"),
        (F.col("e.coef") + margin).alias("ci_high"), "r2", "n",
    )


def log_log_fitted(features: DataFrame, model: DataFrame, *by: str) -> DataFrame:
    """Fitted counts per year from the model's terms; the model has one row per group and term."""
    terms = ["const", "covid", "log_inv"]
    wide = model.groupBy(*by).pivot("term", terms).agg(F.first("coef"))
    wide = wide.select(*by, *[F.col(t).alias(f"b_{t}") for t in terms])
    joined = features.join(wide, list(by))
    exponent = F.col("b_const") + F.col("b_covid") * F.col("covid") + F.col("b_log_inv") * F.col("log_inv")
    return joined.withColumn("fitted", F.exp(exponent)).drop(*[f"b_{t}" for t in terms])


def literal_dimension(spark, values: dict, key: str, key_type: str, value: str = "amount") -> DataFrame:
    """A small literal table, e.g. yearly investment; its size is that of the literal."""
    return spark.createDataFrame(list(values.items()), f"{key} {key_type}, {value} double")
