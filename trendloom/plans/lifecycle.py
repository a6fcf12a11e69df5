"""The three end-to-end runs: corpus to labels, nested records to labels, labels to trend tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.functions import answers, text
from trendloom.functions.text import truncate
from trendloom.operators import corpus, profile, publications, scoring
from trendloom.schemas import LABELS, RAW_CHARS, SHORT_LABELS
from trendloom.sources.archives import arrow_location


def label_prompts(
    prompts: DataFrame, make_scorer: Callable[[], scoring.Scorer], style: str, schema: T.StructType,
    tasks: int | None = None, results: str | None = None, id_col: str = "doc_id", **resume,
) -> DataFrame:
    """Score and parse the column ``prompt``; the other columns stay.

    Without ``results`` the plan is lazy up to the scorer, and a scorer that raises ends it. With
    such a folder the run is resumable (see ``scoring.run_resumable``, which takes the remaining
    arguments), and a document the scorer fails on gets a row of status ``error`` with the message
    in ``raw_response``.
    """
    if results is None:
        return answers.parse_labels(scoring.score_batches(prompts, make_scorer, tasks=tasks), style=style, schema=schema)

    def label(part: DataFrame, files: int) -> DataFrame:
        scored = scoring.score_batches(part, make_scorer, tasks=tasks or files, error="_error")
        parsed, failed = answers.parse_labels(scored, style=style, schema=schema), F.col("_error").isNotNull()
        return parsed.withColumns({
            "status": F.when(failed, "error").otherwise(F.col("status")),
            "raw_response": F.when(failed, truncate(F.col("_error"), RAW_CHARS)).otherwise(F.col("raw_response")),
        }).drop("_error")

    return scoring.run_resumable(prompts, label, results, id_col, **resume)


def label_corpus(
    universe: DataFrame, granted_titles: DataFrame, granted_abstracts: DataFrame, pregrant_abstracts: DataFrame,
    claims: DataFrame, system: str, make_scorer: Callable[[], scoring.Scorer], tasks: int | None = None,
    results: str | None = None, **resume,
) -> DataFrame:
    """Assemble texts and first claims, render prompts, score and parse; resumable with ``results``."""
    docs = corpus.model_corpus(universe, granted_titles, granted_abstracts, pregrant_abstracts, claims)
    prompt = text.prompt_full(system, F.col("title"), F.col("abstract"), F.col("claim1_text_truncated"))
    prompts = docs.select("doc_id", "year", prompt.alias("prompt"))
    return label_prompts(prompts, make_scorer, "braces", LABELS, tasks, results, "doc_id", **resume)


def label_candidates(
    records: DataFrame, system: str, make_scorer: Callable[[], scoring.Scorer], tasks: int | None = None,
    results: str | None = None, **resume,
) -> DataFrame:
    """Select European candidates, render the short prompt, score and parse; resumable with ``results``."""
    docs = publications.european_candidates(records)
    prompt = text.prompt_short(system, F.col("title"), F.col("abstract"))
    prompts = docs.select("ep_id", "year", "cpc", prompt.alias("prompt"))
    return label_prompts(prompts, make_scorer, "prefix", SHORT_LABELS, tasks, results, "ep_id", **resume)


def technique_share_by_year(classification: DataFrame) -> DataFrame:
    """Share of every technique group among the genuine documents of a year."""
    rows = profile.with_tech_groups(profile.genuine(profile.typed_labels(classification)))
    return profile.row_share(profile.crosstab_long(rows, "year", "tech_grouped"), "year")


def zip_partitions(rows: DataFrame, root: str) -> int:
    """Write every partition as one zipped .tsv below ``root``, row by row; returns the row count."""
    names = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        filesystem, base = arrow_location(root)
        filesystem.create_dir(base, recursive=True)
        part, written = TaskContext.get().partitionId(), 0
        # Written aside and moved into place, so a task that fails and runs again leaves one file.
        temporary = f"{base}/.{part}-{uuid.uuid4().hex}"
        with filesystem.open_output_stream(temporary) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
            with archive.open("part.tsv", "w", force_zip64=True) as member, io.TextIOWrapper(member, "utf-8") as out:
                out.write("\t".join(names) + "\n")
                for frame in frames:
                    frame.to_csv(out, sep="\t", header=False, index=False)
                    written += len(frame)
        filesystem.move(temporary, f"{base}/{part}.zip")
        yield pd.DataFrame({"rows": [written]})

    return rows.mapInPandas(run, "rows bigint").agg(F.sum("rows")).first()[0]
