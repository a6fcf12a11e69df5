"""Multinomial naive Bayes: a yes/no labeller learned by counting, whose weights are a table.

A word's weight is the logarithm of how much likelier it is in a text labelled yes than in one
labelled no, add-one smoothed; the empty word carries the logarithm of the labels' own odds. A text's
score is the sum over its words. Both learning and scoring are grouped sums that combine before the
shuffle; frequent words meet their weight where they are read, the others are joined.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.operators.reshape import lookup_join

WORD = r"[\p{L}\p{N}]+"
#: Words of fewer texts say more about those texts than about the labels.
LEAST_TEXTS = 3
#: Log odds beyond which a label is of high, and of medium confidence.
HIGH, MEDIUM = 4.0, 1.0
#: Words that are more than one in so many of those learned from are frequent: at most so many words.
FREQUENT = 1_000_000


def words(text: Column) -> Column:
    """The runs of letters and digits, A-Z lower-cased; a missing text has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def train_bayes(labelled: DataFrame, text: str = "text", label: str = "is_genuine_ai", least_texts: int = LEAST_TEXTS) -> DataFrame:
    """Columns ``word, weight, n``: the words of at least ``least_texts`` labelled texts, and the empty
    word; ``n`` is how often they stand there."""
    known = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    # An occurrence counts for a side, a word's first one in a text for its texts: plain sums, which
    # combine before the shuffle, so that a task passes on one row per word.
    found = known.select(F.col(label).cast("boolean").alias("yes"), F.array_append(words(F.col(text)), F.lit("")).alias("words"))
    both = found.select("yes", F.size("words").alias("size"), F.concat("words", F.array_distinct("words")).alias("words"))
    once = (F.col("at") >= F.col("size")).cast("int")
    rows = both.select("yes", "size", F.posexplode("words").alias("at", "word")).select("yes", "word", (1 - once).alias("n"), once.alias("first"))
    side = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    real = F.col("word") != ""
    counts = rows.groupBy("word").agg(
        side(F.col("yes")).alias("yes"), side(~F.col("yes")).alias("no"), F.sum("first").alias("texts")
    ).where(~real | (F.col("texts") >= least_texts))
    sums = counts.agg(F.struct(
        F.sum(F.when(real, F.col("yes"))).alias("yes"), F.sum(F.when(real, F.col("no"))).alias("no"), F.count_if(real).alias("kinds")
    )).scalar()
    total = lambda name: F.when(real, F.coalesce(sums.getField(name), F.lit(0)) + sums.getField("kinds")).otherwise(1)
    share = lambda name: (F.col(name) + 1) / total(name)
    return counts.select("word", (F.ln(share("yes")) - F.ln(share("no"))).alias("weight"), (F.col("yes") + F.col("no")).alias("n"))


def apply_bayes(model: DataFrame, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns of the id, ``log_odds``, ``found`` and ``confidence``, one row per id.

    Words the model does not know count nothing; a text without a known word follows the labels' odds.
    """
    each = docs.select(id_col, F.explode(F.array_append(words(F.col(text)), F.lit(""))).alias("word"))
    often = F.col("n") * FREQUENT > model.agg(F.sum("n").alias("n")).scalar()
    frequent = model.where(often).select("word", "weight")
    odds, nothing = F.col("word") == "", F.lit(0.0)
    # Frequent words are weighed where they are read: a text's sum is one row. Its key holds a blank,
    # which no word does, and its id, so that these rows lie evenly among those of the other words.
    own = F.concat(F.lit(" "), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    summed = each.join(F.broadcast(frequent), "word", "left").groupBy(
        id_col, F.when(F.col("weight").isNull(), F.col("word")).otherwise(own).alias("word")
    ).agg(
        F.sum(F.when(~odds, F.col("weight"))).alias("sum"), F.max(F.when(odds, F.col("weight"))).alias("odds"), F.count(F.lit(1)).alias("times")
    )
    others = model.where(~often).select("word", "weight")
    weighed = lookup_join(summed, ["word"], [(others, [])]).where("sum IS NOT NULL OR odds IS NOT NULL OR weight IS NOT NULL")
    # The labels' odds count once, however many rows an id has.
    scored = weighed.groupBy(id_col).agg((
        F.coalesce(F.sum(F.coalesce("sum", F.when(~odds, F.col("weight") * F.col("times")))), nothing)
        + F.coalesce(F.max(F.coalesce("odds", F.when(odds, F.col("weight")))), nothing)
    ).alias("log_odds"))
    sure = F.abs("log_odds")
    band = F.when(sure >= HIGH, "high").when(sure >= MEDIUM, "medium").otherwise("low")
    return scored.select(id_col, "log_odds", (F.col("log_odds") > 0).alias("found"), band.alias("confidence"))
