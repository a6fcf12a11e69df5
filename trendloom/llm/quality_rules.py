"""Quality rules: a table of thresholds compiled into one projection.

Every measure and every rule is a column expression over the row's own text; there is no
shuffle and no user function. A missing text counts as empty and fails for having too few words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import BLANKS, let, whole_text

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"

#: Common words of the languages served, as they stand inside a sentence.
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "au aux dans de des du elle en est et la le les par pour que qui sur un une "
    "auf das dem den der die ein eine ist mit nicht sich und von zu "
    "con como del el ella las los más no para por se su y"
).split()


@dataclass(frozen=True)
class Rule:
    """Fails unless ``at_least <= 100 * part / whole <= at_most``; an empty whole fails nothing."""

    name: str
    part: str
    whole: str
    at_least: int | None = None
    at_most: int | None = None


#: The method's thresholds, in hundredths.
RULES = (
    Rule("word_length", "word_chars", "n_words", at_least=250, at_most=1200),
    Rule("symbols", "n_symbols", "n_words", at_most=10),
    Rule("stop_words", "n_stop_words", "n_words", at_least=5),
    Rule("repeated_lines", "n_dup_lines", "n_lines", at_most=40),
)


def _repeat_words(words: Column) -> Column:
    """Words inside a window of eight words that occurs twice or more in the text.

    Windows are compared by 64-bit hashes of their words. Most texts repeat none, which a set of
    hashes tells; only the others are sorted to find the repeated windows and the words they cover.
    """

    def covered(starts: Column) -> Column:
        step = F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda total, x: total + x)

    def repeated(placed: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(placed, k)["h"] == x["h"], F.lit(False))
        twice = F.filter(placed, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return let(F.array_sort(F.transform(twice, lambda x: x["i"])), covered)

    def among(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(placed, repeated))

    def windows(codes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(codes) - (WINDOW - 1))
        return let(F.transform(starts, lambda i: F.xxhash64(F.slice(codes, i, WINDOW))), among)

    codes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(codes, windows))


def measures(words: Column, lines: Column, text: Column) -> dict[str, Column]:
    """The measures by name, all whole numbers."""
    stops = F.filter(words, lambda w: F.rtrim(w, F.lit(".,;:")).isin(STOP_WORDS))
    found = {
        "n_words": F.size(words),
        "word_chars": F.length(F.regexp_replace(text, BLANKS, "")),
        "n_symbols": F.length(F.regexp_replace(text, "[^" + SYMBOLS[1:], "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeat_words(words),
        "n_stop_words": F.size(stops),
        "n_lines": F.size(lines),
    }
    return {name: c.cast("long") for name, c in found.items()}


def compile_rules(rules: tuple[Rule, ...], value) -> Column:
    """One condition, true where every rule holds; ``value(name)`` gives a measure's column."""
    held = []
    for r in rules:
        part, whole = value(r.part) * 100, value(r.whole)
        bounds = [part >= whole * r.at_least] if r.at_least is not None else []
        bounds += [part <= whole * r.at_most] if r.at_most is not None else []
        held.append((whole == 0) | reduce(Column.__and__, bounds))
    return reduce(Column.__and__, held, F.lit(True))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _base_failed(value) -> Column:
    return (value("n_words") < 20) | (value("n_repeat_words") * 100 > value("n_words") * 30)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Columns ``row`` (the whole input row), the measures, ``base_failed`` and ``kept``.

    Taking the row as one column keeps the names of further columns from clashing with ours.
    """
    text = whole_text()
    cut = docs.select(F.struct("*").alias("row"), text.alias("text"), _words(text).alias("words"), _lines(text).alias("lines"))
    found = cut.select("row", *[c.alias(n) for n, c in measures(F.col("words"), F.col("lines"), F.col("text")).items()])
    failed = _base_failed(F.col)
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & compile_rules(rules, F.col))


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with the columns they came with.

    One condition on the text. Filtering the rows of ``judge`` would push the filter below the
    measures, which are then computed anew wherever it names them.
    """

    def passes(measured: Column) -> Column:
        value = measured.getField
        return ~_base_failed(value) & compile_rules(rules, value)

    def measured(cut: Column) -> Column:
        found = measures(cut["words"], cut["lines"], cut["text"])
        return let(F.struct(*[c.alias(n) for n, c in found.items()]), passes)

    text = whole_text()
    return docs.where(let(F.struct(text.alias("text"), _words(text).alias("words"), _lines(text).alias("lines")), measured))
