"""The result table: whole states, merged files, two states kept; and the stream's keyed state."""

import re

import pytest
from pyspark.sql import functions as F

from trendloom import schemas as S
from trendloom.operators import results, scoring
from trendloom.streaming import incremental

ROWS = S.struct(doc_id=S.STRING, status=S.STRING)


def some(spark, *ids):
    return spark.createDataFrame([(i, "success") for i in ids], "doc_id string, status string")


def found(spark, path, number=None):
    return sorted((r.doc_id, r.run, r.batch) for r in results.read(spark, path, ROWS, number).collect())


def test_a_batch_done_again_is_replaced(spark, tmp_path):
    out = str(tmp_path / "out")
    assert found(spark, out) == []
    results.append(some(spark, "a", "b"), out, 0, "r")
    results.append(some(spark, "c"), out, 1, "r")
    results.append(some(spark, "d"), out, 1, "r")
    results.append(some(spark, "a"), out, 0, "other")
    assert found(spark, out) == [("a", "other", 0), ("a", "r", 0), ("b", "r", 0), ("d", "r", 1)]


def test_files_follow_the_size_and_two_states_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(results, "GATHER", 4)
    out = str(tmp_path / "out")
    for k in range(13):
        results.append(some(spark, f"d{k}").repartition(3), out, k, "r")
    assert [i for i, _, _ in found(spark, out)] == sorted(f"d{k}" for k in range(13))
    number, folders = results.state(spark, out)
    assert number == 13 and len(folders) <= 5 and results.state_numbers(spark, out) == [12, 13]
    assert [i for i, _, _ in found(spark, out, 12)] == sorted(f"d{k}" for k in range(12))
    # A batch merged with others is still replaced when it is done again.
    results.append(some(spark, "new"), out, 2, "r")
    assert ("new", "r", 2) in found(spark, out) and "d2" not in [i for i, _, _ in found(spark, out)]
    results.compact(spark, out, ROWS)
    assert sum(f["files"] for f in results.state(spark, out)[1]) == 1 and len(found(spark, out)) == 13
    named = {f["folder"] for n in results.state_numbers(spark, out) for f in results.state(spark, out, n)[1]}
    assert {p.name for p in (tmp_path / "out" / "data").iterdir()} == named


@pytest.mark.parametrize("step", ["_write", "_swap"])
def test_broken_off_while_merging(spark, tmp_path, monkeypatch, step):
    """The state before stays readable, and the next call does the work."""
    out = str(tmp_path / "out")
    for k in range(5):
        results.append(some(spark, f"d{k}"), out, k, "r")
    before, own = found(spark, out), getattr(results, step)

    def dies(*args):
        if step == "_write":
            own(*args)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(results, step, dies)
        with pytest.raises(RuntimeError, match="lost"):
            results.compact(spark, out, ROWS)
    assert found(spark, out) == before and results.state(spark, out)[0] == 5
    results.compact(spark, out, ROWS)
    assert found(spark, out) == before and sum(f["files"] for f in results.state(spark, out)[1]) == 1
    assert results.sweep_strays(spark, out) == 1 and found(spark, out) == before


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path, monkeypatch):
    out, own = str(tmp_path / "out"), results._swap
    results.append(some(spark, "a"), out, 0, "r")

    def late(spark_, path, base, folders):
        monkeypatch.setattr(results, "_swap", own)
        results.append(some(spark, "b"), out, 0, "other")
        own(spark_, path, base, folders)

    monkeypatch.setattr(results, "_swap", late)
    with pytest.raises(results.Conflict):
        results.append(some(spark, "c"), out, 1, "r")
    assert [i for i, _, _ in found(spark, out)] == ["a", "b"]


def test_landed_documents_go_with_the_run(spark, tmp_path):
    root = spark.conf.get("spark.checkpoint.dir", None)
    label = lambda part, tasks: part.select("doc_id", F.lit("success").alias("status"))
    seen, own = [], scoring.scratch_dir
    scoring.scratch_dir = lambda *a: seen.append(own(*a)) or seen[-1]
    try:
        done = scoring.run_resumable(some(spark, "a", "b"), label, str(tmp_path / "out"))
    finally:
        scoring.scratch_dir = own
    assert done.count() == 2 and len(seen) == 1 and not scoring.exists(spark, seen[0]) and root is None or root


# The stream


DOCS = S.struct(doc_id=S.STRING, text=S.STRING)


def texts(spark, ids):
    return spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id string, text string").coalesce(1)


def label(batch):
    return batch.select("doc_id", F.lit("success").alias("status"))


def test_stream_reads_no_result(spark, tmp_path, monkeypatch):
    landing, out, log = (str(tmp_path / n) for n in ("landing", "out", "log"))
    plans = []

    def watched(batch):
        plans.append(batch._jdf.queryExecution().executedPlan().toString())
        return label(batch)

    for k in range(3):  # ids 0-9, 5-14, 10-19, and copies inside a file
        texts(spark, [f"d{i:02d}" for i in [*range(5 * k, 5 * k + 10), 5 * k]]).write.mode("append").parquet(landing)
        incremental.score_landing(spark, landing, DOCS, out, log, watched, ROWS, files_per_batch=1)
    assert [i for i, _, _ in found(spark, out)] == [f"d{i:02d}" for i in range(20)]
    assert plans and not any("FileScan" in p and "/out/" in p for p in plans) and not any("Join" in p for p in plans)


def test_replayed_batch_gives_its_rows_once(spark, tmp_path):
    landing, out, log = (str(tmp_path / n) for n in ("landing", "out", "log"))
    texts(spark, ["a", "b"]).write.parquet(landing)
    incremental.score_landing(spark, landing, DOCS, out, log, label, ROWS)
    texts(spark, ["b", "c"]).write.mode("append").parquet(landing)
    own = incremental.append_results

    def dies(*args):
        own(*args)
        raise RuntimeError("lost after writing")

    incremental.append_results = dies
    try:
        with pytest.raises(Exception, match="lost after writing"):
            incremental.score_landing(spark, landing, DOCS, out, log, label, ROWS)
    finally:
        incremental.append_results = own
    incremental.score_landing(spark, landing, DOCS, out, log, label, ROWS)
    assert [i for i, _, _ in found(spark, out)] == ["a", "b", "c"]


def test_fresh_stream_reads_only_the_parts_of_its_ids(spark, tmp_path):
    landing, out, log = (str(tmp_path / n) for n in ("landing", "out", "log"))
    scoring.append_results(some(spark, *[f"d{i}" for i in range(2000)]), out, 0, "earlier")
    texts(spark, ["d7", "new"]).write.parquet(landing)
    plans = []

    def watched(batch):
        plans.append(batch._jdf.queryExecution().executedPlan().toString())
        return label(batch)

    incremental.score_landing(spark, landing, DOCS, out, log, watched, ROWS)
    assert [i for i, run, _ in found(spark, out) if run != "earlier"] == ["new"]
    assert len([n for n in results.names(spark, f"{log}/earlier-ids") if n.startswith("part=")]) > 200
    filters = re.search(r"PartitionFilters: \[([^\]]*part#[^\]]*)\]", plans[0]).group(1)
    assert 1 <= len(set(re.findall(r"\b\d+\b", re.sub(r"#\d+", "", filters)))) <= 2
    # Two micro-batches later the landed ids are still those of the start.
    texts(spark, ["new", "d8", "newer"]).write.mode("append").parquet(landing)
    incremental.score_landing(spark, landing, DOCS, out, log, watched, ROWS)
    assert [i for i, run, _ in found(spark, out) if run != "earlier"] == ["new", "newer"]


def test_next_part_is_planned_while_one_is_written(spark, tmp_path, monkeypatch):
    """A part's results are written before the next is run, but that one's plan is made meanwhile."""
    import time

    calls, seen, own = [], [], scoring.append_results

    def label(part, tasks):
        calls.append(tasks)
        return part.select("doc_id", F.lit("success").alias("status"))

    def append(rows, path, batch, run):
        until = time.time() + 20
        while len(calls) < min(batch + 3, 4) and time.time() < until:
            time.sleep(0.05)
        seen.append((batch, len(calls)))
        own(rows, path, batch, run)

    monkeypatch.setattr(scoring, "append_results", append)
    docs = texts(spark, ["a", "b", "c"])
    done = scoring.run_resumable(docs, label, str(tmp_path / "out"), rows_per_task=1, tasks_per_write=1)
    # The columns and the first part, then always one part more than is written.
    assert seen == [(0, 3), (1, 4), (2, 4)] and sorted(r.doc_id for r in done.collect()) == ["a", "b", "c"]
