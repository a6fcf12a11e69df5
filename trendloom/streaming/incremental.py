"""Scoring of files as they land."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.operators import results
from trendloom.operators.scoring import append_results, exists, new_run, read_results, unprocessed
from trendloom.session import scratch_dir

#: Parts that the ids of earlier results are landed in.
PARTS = 256


def settled(batch: DataFrame, label: str) -> DataFrame:
    """A micro-batch read from the shared folder: its ids are looked at twice, its state once."""
    path = scratch_dir(batch.sparkSession, label)
    batch.write.parquet(path)
    return batch.sparkSession.read.schema(batch.schema).parquet(path)


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """The run's name, drawn once and kept beside the checkpoint's own files."""
    kept = f"{checkpoint.rstrip('/')}/run-name"
    if not exists(spark, kept):
        spark.createDataFrame([(new_run(),)], "run string").coalesce(1).write.parquet(kept)
    return spark.read.schema("run string").parquet(kept).first().run


def score_landing(
    spark: SparkSession,
    landing: str,
    schema: T.StructType,
    out: str,
    checkpoint: str,
    label: Callable[[DataFrame], DataFrame],
    result_schema: T.StructType,
    id_col: str = "doc_id",
    files_per_batch: int = 1000,
) -> None:
    """Label every new document below ``landing`` once, then stop.

    The checkpoint remembers the files taken and, in a keyed state store, the ids taken: a
    micro-batch looks up its own ids there and reads no result. Of several copies of an id in one
    micro-batch any one is taken. A batch that is replayed replaces its results.

    A stream begun afresh beside earlier results skips their ids. They are landed beside the
    checkpoint once, by a hash of the id, and a micro-batch reads the parts its ids fall into.
    """
    run = _run_of(spark, checkpoint)
    earlier = _earlier_ids(spark, out, result_schema, run, checkpoint, id_col)

    def handle(batch: DataFrame, number: int) -> None:
        fresh = batch
        if earlier:
            kept = settled(batch, f"fresh-{number}")
            parts = [r.part for r in kept.select(_part(id_col).alias("part")).distinct().collect()]
            ids = spark.read.parquet(earlier).where(F.col("part").isin(parts)).select(id_col)
            fresh = unprocessed(kept, ids.withColumn("status", F.lit("success")), id_col)
        append_results(label(fresh), out, number, run)

    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    with _rocksdb(spark):
        query = (
            arrivals.dropDuplicates([id_col]).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
    query.awaitTermination()


@contextmanager
def _rocksdb(spark: SparkSession):
    """Ids are kept on disk, so that their number is not bound by memory."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _part(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(PARTS)).cast("int")


def _earlier_ids(spark: SparkSession, out: str, schema: T.StructType, run: str, checkpoint: str, id_col: str) -> str | None:
    """The folder of ids with results of other runs, landed when the stream first starts; None without any."""
    kept = f"{checkpoint.rstrip('/')}/earlier-ids"
    if not exists(spark, f"{kept}/_SUCCESS"):
        done = read_results(spark, out, T.StructType([schema[id_col]])).where(F.col("run") != run)
        ids = done.select(id_col).distinct().withColumn("part", _part(id_col))
        ids.repartition("part").write.mode("overwrite").partitionBy("part").parquet(kept)
    return kept if any(n.startswith("part=") for n in results.names(spark, kept)) else None
