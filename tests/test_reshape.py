import random

import pytest
from pyspark.sql import functions as F

from trendloom.operators import reshape
from trendloom.operators.reshape import hot_keys, keep_first, lookup_join, membership_join, split_by_keys, top_n


@pytest.fixture(scope="module")
def skewed():
    """A third of all rows share one key, and many of those are copies of one row."""
    draw = random.Random(7)
    data = [("hot", 1, "same")] * 100 + [("hot", draw.randrange(9), f"t{i}") for i in range(100)]
    data += [(f"k{draw.randrange(60)}", draw.randrange(9), f"t{draw.randrange(30)}") for _ in range(400)]
    draw.shuffle(data)
    return data


SCHEMA = "key string, year int, text string"


def test_keep_first(spark, skewed):
    df = spark.createDataFrame(skewed, SCHEMA).repartition(5)
    found = {r.key: (r.year, r.text) for r in keep_first(df, ["key"], ["year", "text"]).collect()}
    best = {}
    for key, year, text in skewed:
        best[key] = min(best.get(key, (99, "")), (year, text))
    assert found == best
    last = {r.key: r.year for r in keep_first(df, ["key"], [-F.col("year")]).collect()}
    assert last == {k: max(y for q, y, _ in skewed if q == k) for k in best}
    assert keep_first(df, ["key"], ["year"]).columns == ["key", "year", "text"]


@pytest.mark.parametrize("parts", [1, 3, 70])
def test_top_n(spark, skewed, parts):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(skewed)], SCHEMA + ", i int").repartition(parts)
    found = sorted((r.key, r.rank, r.i) for r in top_n(df, ["key"], ["year", "i"], 3).collect())
    expected = []
    for key in {r[0] for r in skewed}:
        place = sorted((r[1], i) for i, r in enumerate(skewed) if r[0] == key)[:3]
        expected += [(key, rank, i) for rank, (_, i) in enumerate(place, start=1)]
    assert found == sorted(expected)
    assert [r.i for r in top_n(df, [], ["i"], 4).orderBy("rank").collect()] == [0, 1, 2, 3]


@pytest.mark.parametrize("held", [0, 7, 100_000])
def test_top_n_counts_groups_and_passes_on(spark, monkeypatch, held):
    """Also when a task can hold next to nothing: more rows are passed on, the result is the same."""
    monkeypatch.setattr(reshape, "HELD_ROWS", held)
    draw = random.Random(5)
    data = [(draw.choice(["hot", "hot", None, "a", "b", ""]), draw.choice([None, 1, 2, 3]), i, [i], f"r{i}") for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.createDataFrame(data, "key string, year int, id long, more array<long>, rank string").repartition(7)
        found = top_n(df, ["key"], [F.col("year"), "id"], 4, "place", "size").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = []
    for key in {r[0] for r in data}:
        group = sorted((r for r in data if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        expected += [(*r, place, len(group)) for place, r in enumerate(group[:4], start=1)]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def test_top_n_refuses_orders_that_tasks_would_not_share(spark):
    df = spark.range(3).select("id", (F.col("id") / 2).alias("half"))
    with pytest.raises(TypeError, match="double"):
        top_n(df, [], ["half"], 1)


@pytest.mark.parametrize("hot_rows", [1, 50, 10**6, None])
def test_lookup_join_splits_hot_keys(spark, skewed, hot_rows):
    left = spark.createDataFrame(skewed, SCHEMA).repartition(6)
    draw = random.Random(3)
    table = [("hot", "b"), ("hot", "a"), (None, "n")] + [(f"k{draw.randrange(90)}", f"v{i}") for i in range(80)]
    right = spark.createDataFrame(table, "key string, value string")
    other = right.select("key", F.upper("value").alias("more"))
    found = lookup_join(left, ["key"], [(right, ["value"]), (other, [F.col("more").isNull(), "more"])], hot_rows=hot_rows)
    first = {}
    for key, value in table:
        first[key] = min(first.get(key, "zz"), value)
    expected = sorted((k, y, t, str(first.get(k)), str(first.get(k, "None")).upper() if k in first else "None") for k, y, t in skewed)
    assert sorted((r.key, r.year, r.text, str(r.value), str(r.more)) for r in found.collect()) == expected
    assert found.columns == ["key", "year", "text", "value", "more"]


@pytest.mark.parametrize("hot_rows", [1, 50, 10**6, None])
def test_membership_join(spark, skewed, hot_rows):
    left = spark.createDataFrame(skewed, SCHEMA).repartition(6)
    members = {"hot", "k1", "k2", "k77"}
    right = spark.createDataFrame([(m,) for m in members], "key string")
    semi = membership_join(left, right, ["key"], "left_semi", hot_rows)
    anti = membership_join(left, right, ["key"], "left_anti", hot_rows)
    as_rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert as_rows(semi) == sorted(r for r in skewed if r[0] in members)
    assert as_rows(anti) == sorted(r for r in skewed if r[0] not in members)


def test_hot_rows_are_spread(spark):
    df = spark.range(2000, numPartitions=8).select(F.lit("hot").alias("key"), F.col("id") % 2)
    assert [r.key for r in hot_keys(df, ["key"], 1000).collect()] == ["hot"]
    from trendloom.operators.reshape import _salted

    salts = _salted(df, hot_keys(df, ["key"], 100), ["key"]).select("_salt").distinct().count()
    assert salts > 8


@pytest.mark.parametrize("bits", [reshape.BITMAP_BITS, reshape.KEY_BITS])
def test_split_by_keys(spark, bits):
    """Every row is in one part; rows with a partner are in the first, whatever the bits hold."""
    left = spark.createDataFrame([(k % 3000 - 100, f"t{k}") for k in range(4000)] + [(None, "x"), (5, "t105"), (5, "t105")], "key long, text string")
    right = spark.createDataFrame([(k,) for k in range(-50, 900, 3)] * 2 + [(None,), (10**12,)], "key long")
    some, none = split_by_keys(left, right, "key", bits)
    assert some.columns == none.columns == left.columns
    assert sorted(map(repr, some.collect() + none.collect())) == sorted(map(repr, left.collect()))
    partners = {r.key for r in right.collect()} - {None}
    apart = {r.key for r in none.collect()}
    assert not apart & partners and None in apart
    # Few keys collide in many bits.
    assert bits == reshape.BITMAP_BITS or {r.key for r in some.collect()} <= partners


def test_split_by_no_keys(spark):
    left = spark.createDataFrame([(1,), (None,)], "key long")
    some, none = split_by_keys(left, left.where("key is null"), "key")
    assert not some.collect() and none.count() == 2
