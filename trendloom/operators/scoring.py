"""Batch scoring with a pluggable model, resumable runs, and a trainable stand-in model."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.operators import results
from trendloom.operators.reshape import keep_first, membership_join
from trendloom.session import scratch_dir

BATCH_ROWS = 256
Scorer = Callable[[Sequence[str]], Sequence[str]]


def dealt_by_cost(df: DataFrame, cost: Column, tasks: int) -> DataFrame:
    """The rows over ``tasks`` tasks of nearly equal total cost, and of equal numbers of rows.

    Every input partition sorts its rows by cost and deals them out there and back, so that each
    task gets its share of dear and cheap rows from each. The order depends on the rows alone, so a
    task that is run again deals them alike.
    """
    rows = df.withColumn("_cost", F.coalesce(cost, F.lit(0))).sortWithinPartitions(F.desc("_cost"), F.xxhash64(*df.columns))
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    # Partitions start at different tasks; the number's upper bits are the partition.
    turn = F.pmod(F.col("_at").bitwiseAND((1 << 33) - 1) + F.shiftright("_at", 33), F.lit(2 * tasks))
    target = F.when(turn < tasks, turn).otherwise(2 * tasks - 1 - turn)
    return rows.repartitionById(tasks, target.cast("int")).select(*df.columns)


def score_batches(
    df: DataFrame, make_scorer: Callable[[], Scorer], prompt: str = "prompt", answer: str = "answer",
    batch_rows: int = BATCH_ROWS, tasks: int | None = None, error: str | None = None,
) -> DataFrame:
    """Replace the prompt column by the model's answers.

    ``make_scorer`` runs once per task, where it may load a model. The other columns travel with
    the prompt, so answers and rows cannot get out of step. A model is far dearer than a shuffle,
    so the rows are evened out first: over ``tasks`` tasks of equal prompt length in all, or by bytes
    as Spark balances them.

    A scorer that raises ends the job, unless a column ``error`` is named: then the prompts of the
    failing batch are tried one by one, and those that fail again get no answer but the message.
    """
    keys = [f for f in df.schema.fields if f.name != prompt]
    added = [T.StructField(name, T.StringType()) for name in (answer, error) if name]
    schema = T.StructType([*keys, *added])

    def attempt(scorer: Scorer, prompts: list[str]) -> tuple[list, list]:
        try:
            return list(scorer(prompts)), [None] * len(prompts)
        except Exception as problem:
            if not error:
                raise
            if len(prompts) == 1:
                return [None], [f"{type(problem).__name__}: {problem}"]
        parts = [attempt(scorer, [p]) for p in prompts]
        return [a for found, _ in parts for a in found], [m for _, failed in parts for m in failed]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for frame in frames:
            for start in range(0, len(frame), batch_rows):
                batch = frame.iloc[start : start + batch_rows]
                answers, messages = attempt(scorer, batch[prompt].tolist())
                if len(answers) != len(batch):
                    raise ValueError(f"scorer gave {len(answers)} answers for {len(batch)} prompts")
                yield batch.drop(columns=prompt).assign(**{answer: answers}, **({error: messages} if error else {}))

    spread = dealt_by_cost(df, F.length(prompt), tasks) if tasks else df.hint("rebalance")
    return spread.mapInPandas(run, schema)


def unprocessed(
    docs: DataFrame, done: DataFrame, id_col: str = "doc_id", retry_failed: bool = False, hot_rows: int | None = None
) -> DataFrame:
    """Documents without a result. A failed answer counts as one unless it is to be retried."""
    finished = done.where(F.col("status") == "success") if retry_failed else done
    return membership_join(docs, finished.select(id_col).distinct(), [id_col], "left_anti", hot_rows)


def append_results(out: DataFrame, path: str, batch: int, run: str = "0") -> None:
    """Add one batch to the result table. Doing it again replaces the batch, so a run broken off
    half-way can simply be repeated; batches of other numbers or runs stay as they are."""
    results.append(out, path, batch, run)


def read_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The result table with the columns ``run`` and ``batch``."""
    return results.read(spark, path, schema)


def latest_results(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One result per document: a success if there is one, then the newest run's newest batch."""
    started = F.split_part(F.col("run"), F.lit("-"), F.lit(1)).try_cast("bigint")
    order = [F.col("status") != "success", -F.coalesce(started, F.lit(0)), -F.col("batch")]
    return keep_first(found, [id_col], order)


def new_run() -> str:
    """Name of a run: its start in milliseconds, by which runs are ordered, and a random part."""
    return f"{time.time_ns() // 1_000_000}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def run_resumable(
    docs: DataFrame, label: Callable[[DataFrame, int], DataFrame], path: str, id_col: str = "doc_id",
    retry_failed: bool = False, rows_per_task: int = 10_000, tasks_per_write: int = 1000,
) -> DataFrame:
    """Label the documents that have no result below ``path`` yet; the newest result of each.

    What is to be done is landed in the shared folder, ``rows_per_task`` rows a file, and labelled
    ``tasks_per_write`` files at a time by ``label(part, tasks)``. Each part's results are written
    before the next is begun, so a run broken off loses one part, and calling again does the rest;
    only ``label`` is called one part ahead.
    What was landed goes when all is done; the result table merges its small files.
    Don't join the frames of two calls: Spark takes two readings of one folder for the same rows.
    """
    spark = docs.sparkSession
    schema = label(docs.limit(0), 1).schema
    todo = unprocessed(docs, read_results(spark, path, schema), id_col, retry_failed) if exists(spark, path) else docs
    landed, run = scratch_dir(spark, "todo"), new_run()
    todo.write.option("maxRecordsPerFile", rows_per_task).parquet(landed)
    read = spark.read.schema(docs.schema)
    files = sorted(read.parquet(landed).inputFiles())
    parts = [files[start : start + tasks_per_write] for start in range(0, len(files), tasks_per_write)]
    # Small parts take the driver as long to plan as the tasks to label: the next is planned meanwhile.
    with ThreadPoolExecutor(1) as ahead:
        plan = lambda part: ahead.submit(inheritable_thread_target(spark)(lambda: label(read.parquet(*part), len(part))))
        planned = plan(parts[0]) if parts else None
        for batch, following in enumerate([*parts[1:], None][: len(parts)]):
            now, planned = planned.result(), following and plan(following)
            append_results(now, path, batch, run)
    if not exists(spark, path):
        append_results(label(docs.limit(0), 1), path, 0, run)
    results.compact(spark, path, schema)
    delete(spark, landed)
    return latest_results(read_results(spark, path, schema), id_col)


def train_labeller(labelled: DataFrame, text: str = "text", label: str = "is_genuine_ai"):
    """Learn a yes/no label from labelled texts: the model-free stand-in for a language model.

    Hashed term counts keep the feature space fixed whatever the vocabulary of the corpus.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("text"), F.col(label).cast("double").alias("label")
    )
    steps = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+", minTokenLength=2),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=1 << 14),
        IDF(inputCol="counts", outputCol="features", minDocFreq=2),
        LogisticRegression(maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=steps).fit(rows)


def apply_labeller(model, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Label and confidence band of every document."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(docs.select(id_col, F.coalesce(text, F.lit("")).alias("text")))
    sure = F.abs(vector_to_array("probability")[1] - 0.5)
    band = F.when(sure >= 0.4, "high").when(sure >= 0.2, "medium").otherwise("low")
    return scored.select(id_col, (F.col("prediction") == 1.0).alias("is_genuine_ai"), band.alias("confidence"))
