"""Universe, text assembly and first-claim selection.

Joins here are on document ids, of which no one holds a large share of the rows; ``hot_rows`` makes
them count the rows per id first and split ids beyond it, at the price of a second scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.functions import ids
from trendloom.functions.text import blank_to_null, clean_text, longer_than, strip, truncate
from trendloom.operators.reshape import keep_first, lookup_join, membership_join
from trendloom.schemas import CLAIM_CHARS


# --- universe --------------------------------------------------------------


def universe_counts(universe: DataFrame) -> DataFrame:
    """Documents per id kind, and the total under kind 'total'."""
    kinds = universe.select(ids.id_kind(F.col("doc_id")).alias("kind"))
    counts = kinds.rollup("kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.coalesce("kind", F.lit("total")).alias("kind"), "n")


def bulk_keys(universe: DataFrame, claim_type: str | None = None) -> DataFrame:
    """Distinct keys under which the universe may be listed in bulk files (of one kind)."""
    kind = ids.claim_file_kind(F.col("doc_id"))
    known = universe.where(kind == claim_type if claim_type else kind.isNotNull())
    return known.select(ids.join_key(F.col("doc_id")).alias("key")).distinct()


def restrict_to_universe(
    bulk: DataFrame, universe: DataFrame, id_col: str, claim_type: str | None = None, hot_rows: int | None = None
) -> DataFrame:
    """Bulk rows whose id, with or without the reissue prefix, belongs to the universe."""
    keyed = bulk.withColumn("key", ids.join_key(F.col(id_col)))
    return membership_join(keyed, bulk_keys(universe, claim_type), ["key"], "left_semi", hot_rows).drop("key")


# --- text assembly ---------------------------------------------------------


def _keyed(bulk: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    return bulk.select(ids.join_key(F.col(id_col)).alias("key"), blank_to_null(F.col(text_col)).alias(name))


def _text_lookups(granted_titles: DataFrame, granted_abstracts: DataFrame, pregrant_abstracts: DataFrame) -> list:
    # Text before NULL, then alphabetical: bulk files carry no order of their own.
    return [
        (_keyed(granted_titles, "patent_id", "patent_title", "title"), [F.col("title").isNull()]),
        (_keyed(granted_abstracts, "patent_id", "patent_abstract", "granted"), [F.col("granted").isNull()]),
        (_keyed(pregrant_abstracts, "pgpub_id", "application_abstract", "pregrant"), [F.col("pregrant").isNull()]),
    ]


def assemble_text(
    universe: DataFrame,
    granted_titles: DataFrame,
    granted_abstracts: DataFrame,
    pregrant_abstracts: DataFrame,
    hot_rows: int | None = None,
) -> DataFrame:
    """Title and abstract of every universe row: granted files first, then pre-grant, then ''."""
    docs = universe.select("doc_id", ids.document_key(F.col("doc_id")).alias("key"))
    lookups = _text_lookups(granted_titles, granted_abstracts, pregrant_abstracts)
    joined = lookup_join(docs, ["key"], lookups, hot_rows=hot_rows)
    texts = joined.select(
        "doc_id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("granted", "pregrant", F.lit("")).alias("abstract"),
        ids.source_tag(F.col("doc_id")).alias("source"),
    )
    return text_flags(texts)


def model_corpus(
    universe: DataFrame,
    granted_titles: DataFrame,
    granted_abstracts: DataFrame,
    pregrant_abstracts: DataFrame,
    claims: DataFrame,
    hot_rows: int | None = None,
) -> DataFrame:
    """The merged table straight from the bulk tables.

    Same rows as assembling, selecting claims and merging one after the other, but the universe
    is shuffled once and every bulk table once.
    """
    docs = universe.select("doc_id", "year", ids.document_key(F.col("doc_id")).alias("key"))
    claim1 = first_claim(claims).select(
        ids.join_key(F.col("patent_id")).alias("key"), "claim_type", F.col("year").alias("claim_year"),
        blank_to_null(F.col("text")).alias("claim1_text"),
    ).where(F.col("claim_type") == ids.key_file_kind(F.col("key")))
    lookups = _text_lookups(granted_titles, granted_abstracts, pregrant_abstracts)
    lookups.append((claim1, ["claim_type", "claim_year", "claim1_text"]))
    joined = lookup_join(docs, ["key"], lookups, hot_rows=hot_rows)
    flagged = presence_flags(joined.withColumn("abstract", F.coalesce("granted", "pregrant")))
    return flagged.select(
        "doc_id", "year", "title", "abstract", "claim1_text", "claim_type", "has_abstract", "has_claim", "has_both",
        truncate(F.col("claim1_text"), CLAIM_CHARS).alias("claim1_text_truncated"),
    )


def text_flags(df: DataFrame) -> DataFrame:
    """Length-based flags of the assembled table."""
    return df.withColumn("has_title", longer_than(F.col("title"), 2)).withColumn(
        "has_abstract", longer_than(F.col("abstract"), 10)
    )


def presence_flags(df: DataFrame, abstract: str = "abstract", claim: str = "claim1_text") -> DataFrame:
    """NULL-based flags of the merged table; a blank counts as missing."""
    flagged = df.withColumn("has_abstract", blank_to_null(F.col(abstract)).isNotNull()).withColumn(
        "has_claim", blank_to_null(F.col(claim)).isNotNull()
    )
    return flagged.withColumn("has_both", F.col("has_abstract") & F.col("has_claim"))


def corpus_left_join(
    universe: DataFrame, abstracts: DataFrame, claims: DataFrame, hot_rows: int | None = None
) -> DataFrame:
    """Every universe row with its title, abstract and first claim."""
    texts = abstracts.select(
        "doc_id", blank_to_null(F.col("title")).alias("title"), blank_to_null(F.col("abstract")).alias("abstract")
    )
    claim1 = claims.select("doc_id", blank_to_null(F.col("claim1_text")).alias("claim1_text"), "claim_type")
    joined = lookup_join(
        universe.select("doc_id", "year"),
        ["doc_id"],
        [(texts, [F.col("abstract").isNull()]), (claim1, [F.col("claim1_text").isNull()])],
        hot_rows=hot_rows,
    )
    flagged = presence_flags(joined)
    return flagged.withColumn("claim1_text_truncated", truncate(F.col("claim1_text"), CLAIM_CHARS))


MODEL_INPUT = ["doc_id", "year", "title", "abstract", "claim1_text_truncated", "claim_type", "has_abstract", "has_claim"]


def require_text(df: DataFrame, column: str = "abstract") -> DataFrame:
    return df.where(clean_text(F.col(column)) != "")


# --- first claims ----------------------------------------------------------


def first_claim(claims: DataFrame) -> DataFrame:
    """Rows of the first claim: sequence 0 in files that count from 0, else sequence 1.

    A file, i.e. a claim type and year, counts from 0 if one of its sequence-0 texts opens with
    "1.". That is settled by one small aggregate, one row per claim file, so it is broadcast. All
    years and claim types given take part.
    """
    opening = claims.where(strip(F.col("seq")).isin("0", "1")).withColumn("seq", strip(F.col("seq")))
    from_zero = (F.col("seq") == "0") & strip(F.col("text")).startswith("1.")
    files = opening.groupBy("claim_type", "year").agg(
        F.when(F.max(F.coalesce(from_zero, F.lit(False))), "0").otherwise("1").alias("first_seq")
    )
    picked = opening.join(F.broadcast(files), ["claim_type", "year"]).where(F.col("seq") == F.col("first_seq"))
    return picked.select(*claims.columns)


def _claim_texts(claims: DataFrame) -> DataFrame:
    return first_claim(claims).select(
        ids.join_key(F.col("patent_id")).alias("key"), "claim_type", "year", strip(F.col("text")).alias("claim1_text")
    )


def claim_records(claims: DataFrame, universe: DataFrame) -> DataFrame:
    """First claims of universe documents, one per document and file, under the universe's id.

    Copies are reduced before the join, so no key is left with more than one row per file.
    """
    docs = universe.select(
        "doc_id", ids.join_key(F.col("doc_id")).alias("key"), ids.claim_file_kind(F.col("doc_id")).alias("claim_type")
    ).distinct()
    per_file = keep_first(_claim_texts(claims), ["key", "claim_type", "year"])
    return per_file.join(docs, ["key", "claim_type"]).select("doc_id", "claim1_text", "claim_type", "year")


def first_claim_dedup(records: DataFrame) -> DataFrame:
    """One claim per document: granted before pre-grant, then the earliest year."""
    return keep_first(records, ["doc_id"], ["claim_type", "year", "claim1_text"])


def first_claims(claims: DataFrame, universe: DataFrame) -> DataFrame:
    """One claim per universe document, straight from the bulk rows.

    Same rows as ``first_claim_dedup`` of ``claim_records``. An id's shape fixes the kind of file that
    can hold it, so the first row of a key and kind is the document's; claims and universe are
    reduced by key and kind in one shuffle each, joined there, and not shuffled again.
    """
    first = keep_first(_claim_texts(claims), ["key", "claim_type"], ["year", "claim1_text"])
    listed = universe.select(
        "doc_id", ids.join_key(F.col("doc_id")).alias("key"), ids.claim_file_kind(F.col("doc_id")).alias("claim_type")
    ).where(F.col("claim_type").isNotNull())
    # A set holds the few spellings of an id: with and without prefix or surrounding blanks.
    docs = listed.groupBy("key", "claim_type").agg(F.collect_set("doc_id").alias("doc_ids"))
    joined = first.join(docs, ["key", "claim_type"])
    return joined.select(F.explode("doc_ids").alias("doc_id"), "claim1_text", "claim_type", "year")


def claim_coverage(records: DataFrame, universe: DataFrame) -> DataFrame:
    """Records per kind, documents found, and their share of the known universe.

    Both inputs are reduced per document in one shuffle and summed, which gives the two totals
    in one row without joining them.
    """
    found = records.select(
        "doc_id",
        (F.col("claim_type") == "granted").cast("bigint").alias("granted"),
        (F.col("claim_type") == "pregrant").cast("bigint").alias("pregrant"),
        F.lit(1).alias("saved"),
        F.lit(0).alias("known"),
    )
    known = universe.select(
        "doc_id",
        F.lit(0).cast("bigint").alias("granted"),
        F.lit(0).cast("bigint").alias("pregrant"),
        F.lit(0).alias("saved"),
        (ids.id_kind(F.col("doc_id")) != "unknown").cast("int").alias("known"),
    )
    per_doc = found.unionByName(known).groupBy("doc_id").agg(
        F.sum("granted").alias("granted"), F.sum("pregrant").alias("pregrant"),
        F.max("saved").alias("saved"), F.max("known").alias("known"),
    )
    totals = per_doc.agg(
        F.sum("granted").alias("granted_found"), F.sum("pregrant").alias("pregrant_found"),
        F.sum("saved").alias("documents_found"), F.sum("known").alias("universe_size"),
    )
    share = F.col("documents_found") * 100 / F.nullif(F.col("universe_size"), F.lit(0))
    return totals.withColumn("coverage_pct", share)
