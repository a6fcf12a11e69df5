"""URL filters: dated list entries become validity intervals, captures are joined as of their fetch.

An entry (list, key, day, action) puts a host, or all hosts below it, on a list or takes it off
again, and holds from the start of its day until the next entry of the same list and key. A
capture is blocked if any list holds an active ``block`` for its host or a parent of it.

Hosts may hold a third of all captures, so captures are first reduced to distinct (host, day),
partly before the shuffle. Whatever a key then joins is bounded by the days covered: at most one
(key, day) row per day against one interval per list and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; null where there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.rtrim(F.lower(host), F.lit("."))
    return F.when(host != "", host)


def parents_of(host: Column) -> Column:
    """The host and every parent of two labels or more; a single label stands for itself."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    starts = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, n), "."))


def validity(entries: DataFrame) -> DataFrame:
    """Columns ``list, key, action, valid_from, valid_to``; the last interval of a key is open.

    Entries without a list, key, day or action are void. Of entries of one list, key and day a
    block wins; copies count once.
    """
    whole = entries.where("list IS NOT NULL AND key IS NOT NULL AND day IS NOT NULL AND action IN ('block', 'allow')")
    daily = whole.groupBy("list", "key", "day").agg(F.max("action").alias("action"))  # 'block' > 'allow'
    later = Window.partitionBy("list", "key").orderBy("day")
    return daily.select("list", "key", "action", F.col("day").alias("valid_from"), F.lead("day").over(later).alias("valid_to"))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Columns ``page_id, host, day, n_active, blocked, blocking_lists``, one row per capture.

    ``captures`` has ``page_id, url, fetched`` (timestamp). ``n_active`` counts the active entries
    met, ``blocking_lists`` names the lists that block, sorted, comma-separated. A capture without
    a host or a fetch time meets no entry.
    """
    own = captures.select("page_id", host_of(F.col("url")).alias("host"), F.to_date("fetched").alias("day"))
    asked = own.where("host IS NOT NULL AND day IS NOT NULL").select("host", "day").distinct()
    keyed = asked.select("host", "day", F.explode(parents_of(F.col("host"))).alias("key"))
    # Hosts share parents: a (key, day) is looked up once.
    wanted = keyed.select("key", "day").distinct()
    valid = validity(entries)
    active = (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    met = wanted.join(valid, (wanted.key == valid.key) & active).select(wanted.key, "day", "list", "action")
    states = met.groupBy("key", "day").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("action") == "block", F.col("list"))).alias("lists")
    )
    verdicts = keyed.join(states, ["key", "day"]).groupBy("host", "day").agg(
        F.sum("n").alias("n_active"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lists")))), ",").alias("blocking_lists"),
    )
    joined = own.join(verdicts, ["host", "day"], "left")
    lists = F.coalesce("blocking_lists", F.lit(""))
    return joined.select(
        "page_id", "host", "day", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        (lists != "").alias("blocked"), lists.alias("blocking_lists"),
    )
