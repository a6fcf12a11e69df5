"""Zip archives of bulk tables, landed as Parquet."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.sources.delimited import resolve_columns

CHUNK_ROWS = 50_000


def list_archives(spark: SparkSession, root: str, pattern: str = "*.zip") -> DataFrame:
    """Paths and sizes; the contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length")


def arrow_location(path: str):
    """Arrow's file system and name for a path as Spark writes it (file:/x, hdfs://..., /x)."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def _open(path: str):
    filesystem, name = arrow_location(path)
    return filesystem.open_input_file(name)


def read_archives(paths: DataFrame, roles: Mapping[str, Sequence[Sequence[str]]] | Sequence[str]) -> DataFrame:
    """Columns of the first .tsv member of every archive, plus status rows.

    ``roles`` are resolved by each archive's own header, as in ``resolve_columns``; plain names must
    be there as they are. An archive without one of them fails and names the headers it has.

    A deflated member can only be read from its start, so one archive is one unit of work; it is
    streamed in chunks and never held whole. A broken archive yields one row with its ``error``
    and no fields instead of failing the job. Lines with too many fields are skipped.
    """
    names = list(roles)
    schema = ", ".join(["archive string", "error string", *[f"`{c}` string" for c in names]])

    def failure(path: str, why: Exception | str) -> pd.DataFrame:
        return pd.DataFrame([{"archive": path, "error": str(why), **dict.fromkeys(names)}])

    def source(header: list[str]) -> dict[str, str]:
        if isinstance(roles, Mapping):
            return resolve_columns(header, roles)
        if missing := [n for n in names if n not in header]:
            raise ValueError(f"no column for {missing}; found {header}")
        return {n: n for n in names}

    def chunks(path: str) -> Iterator[pd.DataFrame]:
        with _open(path) as handle, zipfile.ZipFile(handle) as archive:
            member = next((n for n in archive.namelist() if n.endswith(".tsv")), None)
            if member is None:
                yield failure(path, "no .tsv member")
                return
            text = io.TextIOWrapper(archive.open(member), encoding="utf-8", errors="replace")
            frames = pd.read_csv(
                text, sep="\t", dtype=str, chunksize=CHUNK_ROWS, on_bad_lines="skip", keep_default_na=False, na_values=[""]
            )
            for frame in frames:
                frame.columns = [c.strip() for c in frame.columns]
                kept = frame[[source(list(frame.columns))[n] for n in names]].set_axis(names, axis=1).astype(object)
                kept = kept.where(kept.notna(), None)
                kept.insert(0, "error", None)
                kept.insert(0, "archive", path)
                yield kept

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                try:
                    yield from chunks(path)
                except (zipfile.BadZipFile, OSError, EOFError, ValueError) as why:
                    yield failure(path, why)

    return paths.select("path").mapInPandas(run, schema)


def land_archives(
    spark: SparkSession, root: str, out: str, roles: Mapping[str, Sequence[Sequence[str]]] | Sequence[str]
) -> DataFrame:
    """Unpack all archives of a folder into Parquet; returns one status row per archive.

    A member that breaks off half-way keeps the rows before the break and its error row, so the
    caller sees that the archive is incomplete.
    """
    paths = list_archives(spark, root)
    # About one archive per task: inflation is serial, so the number of archives sets the parallelism.
    read_archives(paths.repartitionByRange(max(1, paths.count()), "path"), roles).write.mode("overwrite").parquet(out)
    landed = spark.read.parquet(out)
    per_archive = landed.groupBy("archive").agg(
        F.count_if(F.col("error").isNull()).alias("rows"), F.max("error").alias("error")
    )
    return per_archive.select("archive", "rows", F.when(F.col("error").isNull(), "landed").otherwise("failed").alias("status"), "error")
