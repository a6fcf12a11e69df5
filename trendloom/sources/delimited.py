"""Delimited files, yearly file sets and nested publication tables."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.functions.text import blank_to_null, strip
from trendloom.schemas import FIRST_YEAR, LAST_YEAR, PUBLICATIONS
from trendloom.sources import quoted


def _parsed(spark: SparkSession, path: str | list[str], sep: str, kinds: Sequence[T.DataType]) -> DataFrame:
    """Columns ``file_path, _c0, _c1, ...`` of files with a header, read in parallel (see ``quoted``)."""
    schema = ", ".join(f"_c{k} {kind.simpleString()}" for k, kind in enumerate(kinds))
    options = {"sep": sep, "quote": quoted.QUOTE, "escape": quoted.QUOTE}
    return quoted.quoted_records(spark, path, sep).select("file_path", F.from_csv("record", schema, options).alias("r")).select("file_path", "r.*")


def read_csv_strings(spark: SparkSession, path: str, ids: Sequence[str] = (), multi_line: bool = True) -> DataFrame:
    """CSV with a header, all strings. Header names and ids are trimmed, blanks are NULL.

    Quoted line breaks are read right, in parallel and in two passes; for files known to have none
    turn ``multi_line`` off, which saves the first pass.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, quote='"', escape='"')
    names = raw.columns
    if multi_line:
        raw = _parsed(spark, path, ",", [T.StringType()] * len(names)).drop("file_path")
    columns = []
    for position, name in enumerate(names):
        value = F.col(f"`{raw.columns[position]}`")
        value = blank_to_null(value) if name.strip() in ids else F.when(strip(value) != "", value)
        columns.append(value.alias(name.strip() or f"_c{position}"))
    return raw.select(*columns)


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """CSV with a header and a declared schema; a value of the wrong type is NULL."""
    if not multi_line:
        return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"')
    raw = _parsed(spark, path, ",", [f.dataType for f in schema])
    return raw.select(*[F.col(f"_c{k}").alias(f.name) for k, f in enumerate(schema)])


def read_bulk_tsv(spark: SparkSession, path: str | list[str], schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """Large tab-separated files with a header, string columns in schema order.

    Records with too many fields are skipped, short ones are filled with NULL, blanks are NULL and
    undecodable bytes become the replacement character. Quoted line breaks are read right, in
    parallel and in two passes; for files known to have none turn ``multi_line`` off, which saves
    the first. The path of the file is kept as ``file_path``.
    """
    # A surplus field lands in one more column. Counting the fields of rejected lines instead would
    # fail as soon as a query needs no other column. An empty surplus field does no harm.
    if multi_line:
        raw = _parsed(spark, path, "\t", [*[f.dataType for f in schema], T.StringType()])
        names = [f"_c{k}" for k in range(len(schema) + 1)]
    else:
        names = [*schema.names, "_surplus"]
        wide = T.StructType([*schema.fields, T.StructField("_surplus", T.StringType())])
        raw = spark.read.schema(wide).csv(path, sep="\t", header=True, quote='"', escape='"')
        raw = raw.withColumn("file_path", F.col("_metadata.file_path"))
    kept = raw.where(F.col(names[-1]).isNull())
    columns = [F.nullif(F.col(f"`{c}`"), F.lit("")).alias(name) for c, name in zip(names[:-1], schema.names, strict=True)]
    return kept.select(*columns, "file_path")


def resolve_columns(columns: Sequence[str], roles: Mapping[str, Sequence[Sequence[str]]]) -> dict[str, str]:
    """Find the column of each role by parts of its name.

    A role lists alternatives in order of preference; an alternative is the words a header must
    contain. Raises with the headers found if a role stays open.
    """
    found, missing = {}, []
    for role, alternatives in roles.items():
        for words in alternatives:
            match = next((c for c in columns if all(w in c.lower() for w in words)), None)
            if match is not None:
                found[role] = match
                break
        else:
            missing.append(role)
    if missing:
        raise ValueError(f"no column for {missing}; found {list(columns)}")
    return found


def select_roles(df: DataFrame, roles: Mapping[str, Sequence[Sequence[str]]]) -> DataFrame:
    return df.select(*[F.col(f"`{name}`").alias(role) for role, name in resolve_columns(df.columns, roles).items()])


#: Tasks that look into files for their headers.
HEADER_TASKS = 32

CLAIM_ROLES = {
    "patent_id": [["patent_id"], ["document_number"], ["patent"], ["doc"], ["id"]],
    "seq": [["sequence"]],
    "text": [["text"]],
}
TEXT_ROLES = {"lens_id": [["lens", "id"]], "title": [["title"]], "abstract": [["abstract"]]}


def claim_files(root: str) -> dict[str, str]:
    """Yearly claim files of a folder by kind, under their published names."""
    return {"granted": f"{root.rstrip('/')}/g_claims_*.tsv", "pregrant": f"{root.rstrip('/')}/pg_claims_*.tsv"}


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from trendloom.sources.archives import arrow_location

    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            files, name = arrow_location(path)
            with files.open_input_stream(name) as raw:
                first = next(io.TextIOWrapper(raw, "utf-8", "replace"), "")
            found.append([c.strip() for c in next(csv.reader([first], delimiter="\t"), [])])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["path", "header"])


def files_by_header(spark: SparkSession, pattern: str) -> dict[tuple[str, ...], list[str]]:
    """Paths of tab-separated files by their header: one job, in which tasks read first lines only."""
    paths = spark.createDataFrame([(p,) for p in sorted(spark.read.text(pattern).inputFiles())], "path string")
    headers = paths.repartition(HEADER_TASKS, "path").mapInArrow(_headers, "path string, header array<string>")
    found: dict[tuple[str, ...], list[str]] = {}
    # A row per file, as in the listing above.
    for path, header in sorted((r.path, tuple(r.header)) for r in headers.collect()):
        if header:
            found.setdefault(header, []).append(path)
    return found


def read_yearly_claims(
    spark: SparkSession, files: Mapping[str, str], first: int = FIRST_YEAR, last: int = LAST_YEAR,
    multi_line: bool = True,
) -> DataFrame:
    """All claim files, one path pattern per kind; the year is taken from the file name.

    Columns are named and ordered differently from kind to kind and from year to year, so every
    file's own header counts: files with equal headers are one read. A header without a role is an
    error; a year without a file is simply absent.
    """
    parts = []
    for claim_type, pattern in files.items():
        for header, paths in files_by_header(spark, pattern).items():
            try:
                found = resolve_columns(header, CLAIM_ROLES)
            except ValueError as why:
                raise ValueError(f"{paths[0]}: {why}") from None
            schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
            rows = read_bulk_tsv(spark, paths, schema, multi_line)
            year = F.regexp_extract("file_path", r"_claims_([0-9]{4})\.tsv", 1)
            parts.append(
                rows.select(
                    strip(F.col(f"`{found['patent_id']}`")).alias("patent_id"), F.lit(claim_type).alias("claim_type"),
                    year.cast("int").alias("year"), strip(F.col(f"`{found['seq']}`")).alias("seq"),
                    F.col(f"`{found['text']}`").alias("text"),
                )
            )
    rows = reduce(DataFrame.unionByName, parts)
    return rows.where(F.col("year").between(first, last))


def read_publications(spark: SparkSession, path: str) -> DataFrame:
    """Nested publication records; Spark reads only the struct fields a query touches."""
    return spark.read.schema(PUBLICATIONS).parquet(path)
