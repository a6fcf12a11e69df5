import pytest
from pyspark.sql import functions as F

from trendloom import schemas as S
from trendloom.operators import scoring
from trendloom.plans.catalog import RESULTS, label_texts
from trendloom.plans.stub import make_stub
from trendloom.streaming.incremental import score_landing

DOCS = "doc_id string, text string"


def docs(spark, start, stop):
    return spark.createDataFrame([(f"d{i:03d}", f"text {i}") for i in range(start, stop)], DOCS)


def test_batches_carry_their_keys(spark):
    def make():
        sizes = []

        def score(prompts):
            sizes.append(len(prompts))
            assert len(prompts) <= 256
            return [f"{p}|{len(sizes)}" for p in prompts]

        return score

    df = spark.range(700, numPartitions=1).select(F.col("id").alias("k"), F.concat(F.lit("p"), "id").alias("prompt"))
    found = scoring.score_batches(df, make, tasks=1).collect()
    assert len(found) == 700 and all(r.answer.split("|")[0] == f"p{r.k}" for r in found)
    assert max(int(r.answer.split("|")[1]) for r in found) == 3
    spread = scoring.score_batches(df, make, tasks=5)
    assert spread.rdd.getNumPartitions() == 5 and spread.count() == 700
    balanced = scoring.score_batches(df, make)._jdf.queryExecution().analyzed().toString()
    assert "RebalancePartitions" in balanced


def test_short_answers_are_refused(spark):
    df = spark.range(3).select(F.lit("p").alias("prompt"))
    with pytest.raises(Exception, match="answers for"):
        scoring.score_batches(df, lambda: lambda prompts: []).collect()


def test_resume_adds_only_new(spark, tmp_path):
    out = str(tmp_path / "out")
    scoring.append_results(label_texts(docs(spark, 0, 40)), out, 0)
    done = scoring.read_results(spark, out, RESULTS)
    everything = docs(spark, 0, 100)
    rest = scoring.unprocessed(everything, done)
    assert rest.count() == 60
    assert rest.count() + everything.join(done, "doc_id", "left_semi").count() == 100
    scoring.append_results(label_texts(rest), out, 1)
    assert scoring.unprocessed(everything, scoring.read_results(spark, out, RESULTS)).count() == 0
    scoring.append_results(label_texts(rest.where("doc_id >= 'd040'")), out, 2)
    latest = scoring.latest_results(scoring.read_results(spark, out, RESULTS))
    assert latest.count() == 100


def test_retry_of_failures(spark):
    done = spark.createDataFrame([("a", "success"), ("b", "parse_error"), ("b", "parse_error")], "doc_id string, status string")
    todo = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "doc_id string")
    names = lambda df: sorted(r.doc_id for r in df.collect())
    for hot_rows in (1, None):
        assert names(scoring.unprocessed(todo, done, hot_rows=hot_rows)) == ["c", "c"]
        assert names(scoring.unprocessed(todo, done, retry_failed=True, hot_rows=hot_rows)) == ["b", "c", "c"]
    results = spark.createDataFrame(
        [("a", "parse_error", 1, "0"), ("a", "success", 0, "0"), ("b", "parse_error", 0, "0"), ("b", "parse_error", 2, "0"),
         ("c", "error", 9, "1000-ff"), ("c", "error", 1, "20000-aa")],
        "doc_id string, status string, batch int, run string",
    )
    found = sorted(tuple(r)[:3] for r in scoring.latest_results(results).collect())
    assert found == [("a", "success", 0), ("b", "parse_error", 2), ("c", "error", 1)]


def test_failing_documents_get_a_row(spark):
    def make():
        def score(prompts):
            if any(p in ("p3", "p7") for p in prompts):
                raise RuntimeError("no answer")
            return [p.upper() for p in prompts]

        return score

    df = spark.range(20, numPartitions=1).select(F.concat(F.lit("p"), "id").alias("k"), F.concat(F.lit("p"), "id").alias("prompt"))
    found = scoring.score_batches(df, make, batch_rows=5, tasks=1, error="problem").collect()
    assert {r.k: r.answer for r in found} == {f"p{i}": None if i in (3, 7) else f"P{i}" for i in range(20)}
    assert {r.k for r in found if r.problem == "RuntimeError: no answer"} == {"p3", "p7"}
    with pytest.raises(Exception, match="no answer"):
        scoring.score_batches(df, make, tasks=1).collect()


def test_broken_run_goes_on(spark, tmp_path):
    out, calls = str(tmp_path / "out"), []

    def label(part, tasks):
        if len(calls) == 3:
            raise RuntimeError("broken off")
        calls.append(tasks)
        return part.select("doc_id", F.lit("success").alias("status"), F.lit(len(calls)).alias("call"))

    everything = docs(spark, 0, 50).coalesce(1)
    with pytest.raises(RuntimeError):
        scoring.run_resumable(everything, label, out, rows_per_task=10, tasks_per_write=2)
    assert calls[1:] == [2, 2]  # the first call is asked for its columns only
    calls[:] = [0] * 4
    found = scoring.run_resumable(everything, label, out, rows_per_task=10, tasks_per_write=2)
    assert sorted(r.doc_id for r in found.collect()) == [f"d{i:03d}" for i in range(50)]
    assert calls[4:] == [1, 1]  # columns, then the ten documents left
    assert found.where("call = 6").count() == 10
    assert scoring.read_results(spark, out, S.struct(doc_id=S.STRING)).count() == 50
    empty = scoring.run_resumable(everything.limit(0), label, str(tmp_path / "none"))
    assert empty.count() == 0


def test_stream_scores_each_document_once(spark, tmp_path):
    landing, out, log = (str(tmp_path / n) for n in ("landing", "out", "log"))
    schema = S.struct(doc_id=S.STRING, text=S.STRING)

    def run():
        score_landing(spark, landing, schema, out, log, label_texts, RESULTS, files_per_batch=1)
        return sorted(r.doc_id for r in scoring.read_results(spark, out, RESULTS).collect())

    docs(spark, 0, 30).coalesce(1).write.parquet(landing)
    assert run() == [f"d{i:03d}" for i in range(30)]
    docs(spark, 20, 50).repartition(2).write.mode("append").parquet(landing)
    assert run() == [f"d{i:03d}" for i in range(50)]
    assert run() == [f"d{i:03d}" for i in range(50)]
    # A stream begun afresh sees every file again, yet each document keeps its one result.
    docs(spark, 50, 55).coalesce(1).write.mode("append").parquet(landing)
    score_landing(spark, landing, schema, out, log + "2", label_texts, RESULTS)
    found = scoring.read_results(spark, out, RESULTS)
    assert sorted(r.doc_id for r in found.collect()) == [f"d{i:03d}" for i in range(55)]
    assert found.select("run").distinct().count() == 2


def test_trained_labeller(spark):
    data = [(f"d{i}", "neural network learning weights" if i % 2 else "metal bracket screw housing", bool(i % 2)) for i in range(80)]
    df = spark.createDataFrame(data, DOCS + ", is_genuine_ai boolean")
    model = scoring.train_labeller(df)
    found = {r.doc_id: r for r in scoring.apply_labeller(model, df).collect()}
    assert all(found[d].is_genuine_ai == flag and found[d].confidence == "high" for d, _, flag in data)


def test_stub_is_deterministic():
    assert make_stub()(["a", "b"]) == make_stub()(["a", "b"])


def test_tasks_do_not_import_the_package():
    """Executors need not have the package: what runs there is pickled by value."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    blob = cloudpickle.dumps(make_stub).hex()
    code = f"from pyspark import cloudpickle; print(cloudpickle.loads(bytes.fromhex('{blob}'))()(['a'])[0])"
    out = subprocess.run([sys.executable, "-c", code], cwd="/", capture_output=True, text=True, check=True)
    assert out.stdout.strip() == make_stub()(["a"])[0].strip()


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_tasks_cost_the_same(spark, partitions):
    """Prompt lengths over four orders of magnitude, the long ones side by side."""
    lengths = [int(10 ** (4 * (k / 3000) ** 3)) for k in range(3000)] + [None]
    rows = [(k, None if n is None else "x" * n) for k, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "k long, prompt string").repartition(partitions, F.expr("k div 100"))
    dealt = scoring.dealt_by_cost(df, F.length("prompt"), 8)
    found = dealt.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(F.length("prompt")).alias("cost"), F.count("k").alias("n")).collect()
    costs, sizes = sorted(r.cost for r in found), [r.n for r in found]
    assert len(found) == 8 and costs[-1] <= 1.3 * costs[4] and max(sizes) - min(sizes) <= 2 * partitions
    assert sorted(r.k for r in dealt.select("k").collect()) == list(range(3001))
    # Rows met in another order are dealt alike.
    where = {r.k: r.task for r in dealt.select("k", F.spark_partition_id().alias("task")).collect()}
    turned = scoring.dealt_by_cost(df.sortWithinPartitions(F.desc("k")), F.length("prompt"), 8)
    assert {r.k: r.task for r in turned.select("k", F.spark_partition_id().alias("task")).collect()} == where
