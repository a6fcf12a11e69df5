"""Repair and strict parsing of model answers into typed labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.functions.labels import normalise_bool
from trendloom.functions.text import clean_text, truncate
from trendloom.schemas import LABELS, RAW_CHARS

FENCE = "```"


def _inside_fence(text: Column) -> Column:
    piece = F.split_part(text, F.lit(FENCE), F.lit(2))
    return F.when(piece.startswith("json"), F.substr(piece, F.lit(5))).otherwise(piece)


def strip_fence_any(text: Column) -> Column:
    """Piece between the first two fences, wherever they are."""
    return F.when(text.contains(FENCE), _inside_fence(text)).otherwise(text)


def strip_fence_prefix(text: Column) -> Column:
    """Same, only when the answer opens with a fence."""
    return F.when(text.startswith(FENCE), _inside_fence(text)).otherwise(text)


def slice_braces(text: Column) -> Column:
    """From the first opening to the last closing brace; NULL if there is none."""
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    found = (start > 0) & text.contains("}") & (end > start)
    return F.when(found, F.substr(text, start, end - start + 1))


# Double quotes only; bare NaN and infinities count as values.
JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true"}


def json_members(text: Column) -> Column:
    """The answer as map<string, string> with key 'answer'; NULL unless it is one JSON value.

    The JSON reader ignores whatever follows the first value. Placing the answer inside an outer
    object makes any leftover either a syntax error or an extra member, and both are caught by
    asking for exactly the two members put there.
    """
    wrapped = F.concat(F.lit('{"answer":'), text, F.lit(',"complete":true}'))
    members = F.from_json(wrapped, "map<string,string>", JSON)
    return F.when(F.size(members) == 2, members)


def _member(members: Column, name: str) -> Column:
    """Value of a member; of a repeated key the last one counts."""
    same = F.filter(members, lambda m: m["key"] == name)
    return F.when(F.size(same) > 0, F.element_at(same, -1)["value"])


def _labels(members: Column, schema: T.StructType) -> list[Column]:
    columns = []
    for field in schema:
        value = _member(members, field.name)
        if isinstance(field.dataType, T.BooleanType):
            value = normalise_bool(value)
        columns.append(value.alias(field.name))
    return columns


def parse_labels(
    df: DataFrame, answer: str = "answer", style: str = "braces", schema: T.StructType = LABELS
) -> DataFrame:
    """Replace the answer by the label columns, ``status`` and ``raw_response`` (failures only).

    ``braces``: fence anywhere, cut to the outer braces, an empty object is an error.
    ``prefix``: fence at the start only, the rest must be one JSON object.
    ``pilot``: as prefix, but telling bad JSON (json_error) from JSON that is no object (error).
    Label fields live beside the keys of the row and never overwrite them.
    """
    text = clean_text(F.col(answer))
    if style == "braces":
        body = slice_braces(strip_fence_any(text))
    else:
        body = clean_text(strip_fence_prefix(text))
    staged = df.withColumn("_body", body).withColumn("_members", json_members(F.col("_body")))

    parsed = F.col("_members").isNotNull()
    is_object = parsed & F.col("_body").startswith("{")
    empty = F.col("_body").rlike(r"^\{\s*\}$")
    if style == "braces":
        status = F.when(is_object & ~empty, "success").otherwise("parse_error")
    elif style == "prefix":
        status = F.when(is_object, "success").otherwise("parse_error")
    elif style == "pilot":
        status = F.when(is_object, "success").when(parsed, "error").otherwise("json_error")
    else:
        raise ValueError(f"unknown answer style {style!r}")

    staged = staged.withColumn("status", status).withColumn(
        "_answer",
        F.when(F.col("status") == "success", F.map_entries(F.from_json(F.col("_members")["answer"], "map<string,string>", JSON))),
    )
    added = [*schema.names, "status", "raw_response", answer]
    keys = [c for c in df.columns if c not in added]
    raw = F.when(F.col("status") != "success", truncate(F.coalesce(F.col(answer), F.lit("")), RAW_CHARS))
    return staged.select(*keys, *_labels(F.col("_answer"), schema), "status", raw.alias("raw_response"))


def skip_without_text(df: DataFrame, *texts: str) -> Column:
    """Status for rows that must not be sent to a model, NULL for the others."""
    blank = F.lit(True)
    for name in texts:
        blank = blank & (clean_text(F.col(name)) == "")
    return F.when(blank, "skipped")
