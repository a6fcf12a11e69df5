"""Typed labels and literal recodings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom.functions.text import strip


def normalise_bool(c: Column) -> Column:
    """'True', 'true ', True -> true; 'False' -> false; anything else NULL."""
    word = F.lower(strip(c.cast("string")))
    return F.when(word == "true", True).when(word == "false", False)


def literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def recode_nullable(c: Column, mapping: Mapping[str, str]) -> Column:
    return F.element_at(literal_map(mapping), c)


def recode(c: Column, mapping: Mapping[str, str], default: str = "other") -> Column:
    """Total recoding: unmapped codes and NULL become the default."""
    return F.coalesce(recode_nullable(c, mapping), F.lit(default))


def caption(c: Column, mapping: Mapping[str, str]) -> Column:
    return F.coalesce(recode_nullable(c, mapping), c)
