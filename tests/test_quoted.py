"""Parallel reading of quoted files: the rows of the one-task reader, whatever the slices."""

import random

import pytest

from trendloom import schemas as S
from trendloom.sources import delimited, quoted


@pytest.fixture
def tiny_slices(spark):
    """slice_bytes(n): Spark cuts files every n bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def set_to(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 0)
        spark.conf.set(names[2], 1)

    yield set_to
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def field(rng, sep):
    text = "".join(rng.choice(["a", "b", "é", " ", sep, "\n", '"', "\r\n", "xyz"]) for _ in range(rng.randint(0, 12)))
    if rng.random() < 0.5 or any(c in text for c in (sep, "\n", '"')):
        return '"' + text.replace('"', '""') + '"'
    return text


def whole(spark, path, sep, n):
    """The rows by Spark's reader with one task per file."""
    schema = ", ".join(f"_c{k} string" for k in range(n))
    read = spark.read.schema(schema).csv(path, sep=sep, header=True, multiLine=True, quote='"', escape='"', lineSep="\n")
    return sorted((tuple(r) for r in read.collect()), key=repr)


@pytest.mark.parametrize(("sep", "size"), [("\t", 7), ("\t", 40), (",", 64), (",", 1 << 20)])
def test_rows_of_the_one_task_reader(spark, tmp_path, tiny_slices, sep, size):
    rng = random.Random(size)
    for name in "ab":
        rows = [sep.join(field(rng, sep) for _ in range(3)) for _ in range(60)]
        rows[10] = sep.join(['"' + "long\n" * 60 + '"', "over many", "slices"])
        (tmp_path / f"{name}.txt").write_text("\n".join([sep.join(("x", '"the ""y"""', "z")), *rows]) + "\n", newline="", encoding="utf-8")
    expected = whole(spark, str(tmp_path), sep, 3)
    tiny_slices(size)
    read = delimited._parsed(spark, str(tmp_path), sep, [S.STRING] * 3)
    assert sorted((tuple(r) for r in read.drop("file_path").collect()), key=repr) == expected
    assert size > 100 or quoted.slices(spark, str(tmp_path), sep).count() > 20


def test_slices_know_what_they_start_in(spark, tmp_path, tiny_slices):
    """Quotes inside unquoted fields count for nothing; a slice may lie inside one field as a whole."""
    lines = ["h1\th2", '5" pipe\tplain', '"open', "still open", 'open "" here', 'closed now"\tx', "plain\tline", 'a\t"b', 'c"', "end\t1"]
    (tmp_path / "a.tsv").write_text("\n".join(lines) + "\n")
    tiny_slices(8)
    found = quoted.slices(spark, str(tmp_path), "\t").orderBy("start").collect()
    starts, at = {}, 0
    for k, line in enumerate(lines):
        starts.setdefault(max(0, -(-at // 8) - 1) * 8, k)  # a line that starts on a border is the slice before it
        at += len(line) + 1
    inside = {3, 4, 5, 8}
    assert [(r.start, r.open) for r in found] == [(s, k in inside) for s, k in sorted(starts.items())]
    rows = delimited.read_bulk_tsv(spark, str(tmp_path), S.struct(h1=S.STRING, h2=S.STRING)).drop("file_path").collect()
    assert sorted(tuple(r) for r in rows) == sorted([
        ('5" pipe', "plain"), ('open\nstill open\nopen " here\nclosed now', "x"), ("plain", "line"), ("a", "b\nc"), ("end", "1"),
    ])


def test_a_field_left_open_and_carriage_returns(spark, tmp_path, tiny_slices):
    (tmp_path / "a.csv").write_bytes(b'id,text\r\n1,"two\r\nlines"\r\n2,x\r\n\r\n3,"never closed\r\nto the end')
    tiny_slices(9)
    rows = delimited.read_csv_strings(spark, str(tmp_path / "a.csv")).collect()
    assert sorted(tuple(r) for r in rows) == [("1", "two\r\nlines"), ("2", "x"), ("3", "never closed\r\nto the end")]


def test_clean_slices_stay_in_the_jvm(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("h\n" + "x\n" * 9)
    plan = quoted.quoted_records(spark, str(tmp_path), "\t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 2 and "BroadcastHashJoin" in plan  # one reading for whole records, one for fragments


def test_headers_in_one_job(spark, tmp_path):
    for k in range(200):
        names = "patent_id\tclaim_sequence\tclaim_text" if k % 2 else "claim_text\tpatent_id\tclaim_sequence"
        (tmp_path / f"g_claims_{1900 + k}.tsv").write_text(f"{names}\n1\t2\t3\n")
    (tmp_path / "g_claims_3000.tsv").write_text("")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    found = delimited.files_by_header(spark, f"{tmp_path}/*.tsv")
    jobs = len(tracker.getJobIdsForGroup("headers"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [len(v) for v in found.values()] == [100, 100] and jobs <= 3
    (tmp_path / "g_claims_3001.tsv").write_text("number\ttext\n")
    with pytest.raises(ValueError, match=r"g_claims_3001.tsv: no column for \['patent_id', 'seq'\]; found \['number', 'text'\]"):
        delimited.read_yearly_claims(spark, {"granted": f"{tmp_path}/*.tsv"})
