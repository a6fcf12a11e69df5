import pytest
from pyspark.sql import functions as F

from trendloom.functions import arrays as A
from trendloom.operators import publications
from trendloom.schemas import PUBLICATIONS
from trendloom.sources import sinks
from trendloom.sources.delimited import read_publications

LONG = "x" * 51


def record(number="EP1A1", country="EP", date=20150102, titles=None, abstracts=((LONG, "en"),), priorities=(("DE1", "DE1", 20140101),),
           codes=("G06N3/04",), assignees=("DE",), inventors=("FR",)):
    return (
        number, number, country, 20140101, date, titles if titles is None else list(titles),
        None if abstracts is None else list(abstracts), None if priorities is None else list(priorities),
        None if codes is None else [(c,) for c in codes], None if assignees is None else [(c,) for c in assignees],
        None if inventors is None else [(c,) for c in inventors],
    )


CASES = {
    # number: (record fields, in the candidate query, in the country query)
    "EP1": ({}, True, True),
    "EP2": ({"abstracts": [("x" * 50, "en")]}, False, False),
    "EP3": ({"abstracts": [(None, "en"), (LONG, "de")]}, False, False),
    "EP4": ({"abstracts": [(LONG, "de"), (None, "en"), (LONG, "en")]}, True, True),
    "EP5": ({"abstracts": None}, False, False),
    "EP6": ({"codes": ["H04L9/00", "G06F9/50"]}, False, True),
    "EP7": ({"codes": ["G10L15/22"]}, True, True),
    "EP8": ({"codes": ["G10L3/00"]}, False, True),
    "EP9": ({"codes": []}, False, False),
    "EP10": ({"date": 20151340}, False, True),
    "EP11": ({"date": 20091231}, False, False),
    "EP12": ({"date": 20231231}, True, True),
    "EP13": ({"priorities": None}, False, True),
    "EP14": ({"priorities": []}, False, True),
    "EP15": ({"priorities": [("DE1", "DE1", 20140101), ("US2", "US2", 20130101)]}, False, False),
    "EP16": ({"priorities": [("DE1", "DE1", 20130101), ("US2", "US2", 20140101)]}, True, False),
    "EP17": ({"priorities": [("JP1", None, 20130101), ("US2", None, None)]}, False, True),
    "EP18": ({"country": "WO"}, False, True),
    "WO19": ({"country": "EP"}, True, False),
    "EP20": ({"priorities": [(None, "DE", 20130101)]}, False, True),
    "EP21": ({"assignees": None, "inventors": [None]}, True, True),
    "EP22": ({"date": 20240101}, False, False),
    "EP23": ({"date": 20231399}, False, True),
}


@pytest.fixture
def records(spark):
    return spark.createDataFrame([record(n, **kw) for n, (kw, _, _) in CASES.items()], PUBLICATIONS)


def test_candidate_query(records):
    found = publications.european_candidates(records).collect()
    assert {r.ep_id for r in found} == {n for n, (_, hit, _) in CASES.items() if hit}
    by_id = {r.ep_id: r for r in found}
    assert by_id["EP4"].abstract == LONG and by_id["EP7"].cpc == "G10L15/22" and by_id["EP16"].priority_country == "DE"
    assert [r.year for r in publications.ordered_candidates(records).collect()] == sorted(r.year for r in found)


def test_country_query(records):
    found = {r.ep_id: r for r in publications.applicant_countries(records).collect()}
    assert set(found) == {n for n, (_, _, hit) in CASES.items() if hit}
    assert (found["EP1"].applicant_country, found["EP1"].inventor_country) == ("DE", "FR")
    assert (found["EP21"].applicant_country, found["EP21"].inventor_country) == (None, None)
    assert found["EP10"].year == 2015


def test_elements(records):
    titles = [("a", "de"), (None, "en"), ("b", "en")]
    df = records.limit(1).withColumn(
        "title_localized", F.array(*[F.struct(F.lit(t).cast("string").alias("text"), F.lit(la).alias("language")) for t, la in titles])
    )
    row = df.select(
        A.pick_localized(F.col("title_localized")), A.pick_localized(F.col("title_localized"), require_text=True),
        A.pick_localized(F.col("title_localized"), "fr"), A.collect_codes(F.col("cpc")),
        A.first_code(F.array(F.lit("X"), F.lit("G06Q1"), F.lit("G06N1")), "^G06"),
        A.year_of_date(F.lit(20160229)), A.year_of_date(F.lit(20150229)), A.year_of_number(F.lit(20150229)),
    ).first()
    assert tuple(row) == (None, "b", None, ["G06N3/04"], "G06Q1", 2016, None, 2015)


def test_scan_reads_needed_fields_only(records, spark, tmp_path):
    from trendloom.sources.delimited import read_publications

    path = str(tmp_path / "p")
    records.write.parquet(path)
    df = publications.applicant_countries(read_publications(spark, path))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(publication_date,20100101)" in plan and "StringStartsWith(publication_number,EP)" in plan
    schema = plan.split("ReadSchema")[1]
    assert "priority_claim:array<struct<application_number:string>>" in schema and "title_localized" not in schema
    assert "Exchange" not in plan
    earliest = read_publications(spark, path).select(A.earliest_priority_country(F.col("priority_claim")))
    assert "application_number" not in earliest._jdf.queryExecution().executedPlan().toString()


def scanned_rows(spark, df):
    """Result rows, and the rows the one scan of ``df`` passed on."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        execution = df._jdf.queryExecution()
        found = execution.executedPlan().executeCollect()
        scan = execution.executedPlan().collectLeaves().apply(0)
        return len(found), scan.metrics().apply("numOutputRows").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_landed_records_are_read_by_row_group(spark, tmp_path):
    """Two years of one office: files and row groups of other years and offices are not read."""
    data = [
        record(f"{office}{year}{i}A1", office, year * 10000 + 101 + i % 28)
        for year in range(2010, 2024) for office in ("EP", "US", "WO") for i in range(100)
    ]
    df = spark.createDataFrame(data, PUBLICATIONS).repartition(5)
    sinks.land_publications(df, str(tmp_path / "sorted"), row_group_bytes=1 << 14)  # one file, many row groups
    df.write.parquet(str(tmp_path / "plain"))
    spark.conf.set("spark.sql.shuffle.partitions", "42")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.land_publications(df, str(tmp_path / "many"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = {}
    for name in ("plain", "sorted", "many"):
        stored = read_publications(spark, str(tmp_path / name))
        assert sorted(map(repr, stored.collect())) == sorted(map(repr, df.collect()))
        hits, read[name] = scanned_rows(spark, publications.european_candidates(stored, 2015, 2016))
        assert hits == 200
    assert read["many"] <= 400 < read["plain"] == len(data)
    assert len(list((tmp_path / "sorted").glob("*.parquet"))) == 1 and read["sorted"] < 1000


def test_records_are_built_after_the_shuffle(spark, tmp_path, monkeypatch):
    """What is shuffled and sorted are the plain columns of the tables; copies and missing values stay."""
    from datetime import datetime

    from trendloom.plans import views

    lines = [(k, 7 * k + n, 3 * k + n, n, datetime(1995 + k % 7, 1 + k % 12, 1 + n)) for k in range(1, 60) for n in range(1, 8)]
    lines += [lines[5], (None, 97, 25, 2, datetime(1996, 1, 1)), (3, None, None, 1, None)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp"
    spark.createDataFrame(lines, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    texts = [(k, f"line {k}\n\nlonger line {k}") for k in range(1, 30)] + [(4, "copy"), (5, None), (None, "no id")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    handed, land = [], views.land_publications
    monkeypatch.setattr(views, "land_publications", lambda df, *a, **k: (handed.append(df), land(df, *a, **k)))
    t = views.Tables(spark, str(tmp_path))
    stored = t.publications()
    whole = t.publication_rows.select(stored.columns)
    assert sorted(map(repr, stored.collect())) == sorted(map(repr, whole.collect()))
    assert not any("array" in kind for _, kind in handed[0].dtypes)
    # Files hold ranges of the order, sorted inside.
    order = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sinks.PUBLICATION_ORDER]
    kept = stored.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.struct(*order).alias("key"))
    files = {}
    for r in kept.orderBy("at").collect():
        files.setdefault(r.file, []).append(tuple(r.key))
    assert all(keys == sorted(keys) for keys in files.values())
    spans = sorted((keys[0], keys[-1]) for keys in files.values())
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_texts_are_packed_before_the_shuffle(spark, tmp_path, monkeypatch):
    """What the landing shuffles and sorts holds texts compressed, and only lines with a document are joined."""
    from datetime import datetime

    from trendloom.plans import views

    lines = [(k, k, k, 1 + k % 7, datetime(1996, 1, 1, 23, 59)) for k in range(2000)] + [(None, 1, 1, 1, None)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp"
    spark.createDataFrame(lines, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    texts = [(k, "\n".join(f"the method of step {k * i} uses the result of step {i}" for i in range(40))) for k in range(0, 500, 5)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    handed, split = [], []
    land, by_keys = views.land_publications, views.split_by_keys
    monkeypatch.setattr(views, "land_publications", lambda df, *a, **k: (handed.append(df), land(df, *a, **k)))
    monkeypatch.setattr(views, "split_by_keys", lambda *a, **k: split.append(by_keys(*a, **k)) or split[-1])
    t = views.Tables(spark, str(tmp_path))
    stored = t.publications()
    assert handed[0].agg(F.sum(F.octet_length("text"))).first()[0] < 0.5 * sum(len(x) for _, x in texts)
    assert split[0][0].count() == len(texts) and split[0][1].count() == len(lines) - len(texts)
    whole = t.publication_rows.select(stored.columns)
    assert sorted(map(repr, stored.collect())) == sorted(map(repr, whole.collect()))
