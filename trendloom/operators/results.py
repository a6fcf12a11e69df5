"""A result table that is always whole: data folders named by a manifest, swapped in one step.

Every change writes new folders and then a new manifest; the newest manifest is the table. A writer
that dies leaves the table as it was, and what it wrote is swept up later. Two states are kept, so
whoever read the one before can finish. Small folders are merged as they gather, so the number of
files follows the size of the table and not the number of batches.

    <path>/_states/<number>   one JSON line: the folders, with rows' runs and batches, files, bytes
    <path>/data/<name>        Parquet files, with the columns run and batch
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: States kept; small folders that may gather before they are merged; bytes of a file after merging.
KEEP, GATHER, FILE_BYTES = 2, 32, 128 << 20
_MARKS = [T.StructField("run", T.StringType()), T.StructField("batch", T.IntegerType())]


class Conflict(RuntimeError):
    """Another writer changed the table in between."""


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def names(spark: SparkSession, path: str) -> list[str]:
    files, target = _fs(spark, path)
    return [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []


def _delete(spark: SparkSession, path: str) -> None:
    files, target = _fs(spark, path)
    files.delete(target, True)


def state_numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in names(spark, f"{path}/_states") if n.isdigit())


def state(spark: SparkSession, path: str, number: int | None = None) -> tuple[int, list[dict]]:
    """Number and folders of the newest state, or of the one asked for; 0 and none without any."""
    known = state_numbers(spark, path)
    if not known:
        return 0, []
    number = known[-1] if number is None else number
    files, target = _fs(spark, f"{path}/_states/{number}")
    reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(files.open(target), "UTF-8"))
    try:
        return number, json.loads(reader.readLine())
    finally:
        reader.close()


def _swap(spark: SparkSession, path: str, base: int, folders: list[dict]) -> None:
    """Make ``folders`` the state behind ``base``: written aside, then renamed, which fails if it is there."""
    files, draft = _fs(spark, f"{path}/_states/.{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray((json.dumps(folders) + "\n").encode()))
    out.close()
    _, final = _fs(spark, f"{path}/_states/{base + 1}")
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise Conflict(f"state {base + 1} of {path} is there already")


def _write(rows: DataFrame, path: str, runs: dict[str, list[int]]) -> dict:
    """A new folder of rows, as the manifest names it."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    folder = f"{path}/data/{name}"
    rows.write.parquet(folder)
    files, target = _fs(spark, folder)
    size = files.getContentSummary(target)
    parts = sum(n.startswith("part-") for n in names(spark, folder))
    return {"folder": name, "runs": runs, "files": parts, "bytes": size.getLength()}


def _read(spark: SparkSession, path: str, folders: list[dict], schema: T.StructType) -> DataFrame:
    fields = [f for f in schema if f.name not in ("run", "batch")]
    whole = T.StructType([*fields, *_MARKS])
    if not folders:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(*[f"{path}/data/{f['folder']}" for f in folders])


def _holds(folder: dict, run: str, batch: int) -> bool:
    low, high = folder["runs"].get(run, (1, 0))
    return low <= batch <= high


def _merged_runs(folders: list[dict]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for f in folders:
        for run, (low, high) in f["runs"].items():
            out[run] = [min(low, out[run][0]), max(high, out[run][1])] if run in out else [low, high]
    return out


def append(results: DataFrame, path: str, batch: int, run: str) -> None:
    """Add a batch to the table, in place of an earlier try of the same batch."""
    spark, path, schema = results.sparkSession, path.rstrip("/"), results.schema
    added = _write(results.withColumn("run", F.lit(run)).withColumn("batch", F.lit(batch).cast("int")), path, {run: [batch, batch]})
    number, folders = state(spark, path)
    kept, rewritten = [], False
    for f in folders:
        if not _holds(f, run, batch):
            kept.append(f)
        elif f["runs"] != {run: [batch, batch]}:  # merged with others before it was tried again
            rest = _read(spark, path, [f], schema).where(~((F.col("run") == run) & (F.col("batch") == batch)))
            kept.append(_write(rest, path, f["runs"]))
            rewritten = True
    small = [f for f in kept if f["bytes"] < FILE_BYTES]
    if len(small) >= GATHER and not rewritten:
        kept = [f for f in kept if f["bytes"] >= FILE_BYTES] + [merge(spark, path, small, schema)]
    _swap(spark, path, number, [*kept, added])
    sweep(spark, path)


def merge(spark: SparkSession, path: str, folders: list[dict], schema: T.StructType) -> dict:
    """One folder with the rows of several, in files of about ``FILE_BYTES``."""
    files = max(1, -(-sum(f["bytes"] for f in folders) // FILE_BYTES))
    return _write(_read(spark, path, folders, schema).repartition(files), path, _merged_runs(folders))


def compact(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Merge all folders that are small or made of small files."""
    path = path.rstrip("/")
    number, folders = state(spark, path)
    small = [f for f in folders if f["bytes"] < FILE_BYTES * f["files"]]
    if sum(f["files"] for f in small) > max(1, -(-sum(f["bytes"] for f in small) // FILE_BYTES)):
        merged = merge(spark, path, small, schema)
        _swap(spark, path, number, [*[f for f in folders if f not in small], merged])
        sweep(spark, path)


def sweep(spark: SparkSession, path: str) -> None:
    """Forget all but the last ``KEEP`` states and delete folders that no kept state names.

    Folders of a writer at work are in no state yet: only those that a forgotten state named go.
    """
    numbers = state_numbers(spark, path)
    kept = {f["folder"] for n in numbers[-KEEP:] for f in state(spark, path, n)[1]}
    for n in numbers[:-KEEP]:
        for name in {f["folder"] for f in state(spark, path, n)[1]} - kept:
            _delete(spark, f"{path}/data/{name}")
        _delete(spark, f"{path}/_states/{n}")


def sweep_strays(spark: SparkSession, path: str) -> int:
    """Delete folders that no state names, left by writers that died; to be called while none writes."""
    path = path.rstrip("/")
    named = {f["folder"] for n in state_numbers(spark, path) for f in state(spark, path, n)[1]}
    strays = [n for n in names(spark, f"{path}/data") if n not in named]
    for name in strays:
        _delete(spark, f"{path}/data/{name}")
    return len(strays)


def read(spark: SparkSession, path: str, schema: T.StructType, number: int | None = None) -> DataFrame:
    """The table as of its newest state (or the one asked for): ``schema`` with ``run`` and ``batch``."""
    path = path.rstrip("/")
    return _read(spark, path, state(spark, path, number)[1], schema)
