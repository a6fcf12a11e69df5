"""Registered queries of this package and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import (
    decontaminate, line_dedup, merkle, near_dedup, ngram_lm, piece_codec, prefix_trie, quality_rules, sharding, span_dedup,
    suffix_dedup, token_counts, url_filters,
)
from trendloom.llm.common import table


def captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time: the table has none, so the page's number gives one within 2024."""
    seconds = F.pmod(F.col("page_id") * 7919 * 61, F.lit(366 * 86400))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + seconds).alias("fetched"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for hosts of every fifth page, of parents for every fiftieth, on three lists."""
    host = url_filters.host_of(F.col("url"))
    k = F.col("page_id")
    key = F.when(k % 50 == 0, F.array_join(F.slice(F.split(host, r"\."), -2, 2), ".")).otherwise(host)
    return pages.where(k % 5 == 0).select(
        F.concat(F.lit("list"), (k / 5).cast("long") % 3).alias("list"), key.alias("key"),
        F.date_add(F.lit("2024-01-01").cast("date"), ((k * 37) % 366).cast("int")).alias("day"),
        F.when(k % 4 == 0, "allow").otherwise("block").alias("action"),
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.evaluate(captures(pages), list_entries(pages))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = span_dedup.remove_repeated_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "row.doc_id", F.col("n_sentences").cast("long").alias("n_sentences"), F.size("removed").cast("long").alias("n_removed"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 8)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op7_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.train_and_score(table(spark, sf_dir, "documents"), least=1)


def op8_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find_groups(table(spark, sf_dir, "documents"), size=4)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines"
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    claimed = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.prove(docs, text=claimed).drop("source")


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_benchmark_decontamination, op3_sentence_spans, op4_sentencepiece, op5_hash_tree_shards,
        op6_suffix_dedup, op7_ngram_trie, op8_lsh_forest, op9_quality_rules, op10_token_counts,
        op11_line_dedup, op12_conversation_trie, op13_merkle_manifest,
    )
}

_HOST = r"nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '')"

_OP1 = rf"""
WITH hosts AS (
  SELECT page_id, {_HOST} AS host,
    CAST(make_timestamp((1704067200 + (page_id * 7919 * 61) % (366 * 86400)) * 1000000) AS DATE) AS day
  FROM pages),
raw AS (
  SELECT 'list' || CAST((page_id // 5) % 3 AS VARCHAR) AS list,
    CASE WHEN page_id % 50 = 0 THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END AS key,
    DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS day,
    CASE WHEN page_id % 4 = 0 THEN 'allow' ELSE 'block' END AS action
  FROM hosts WHERE page_id % 5 = 0 AND host IS NOT NULL),
daily AS (SELECT list, key, day, max(action) AS action FROM raw GROUP BY ALL),
keyed AS (
  SELECT page_id, host, day, array_to_string(labels[i:], '.') AS key FROM (
    SELECT *, string_split(host, '.') AS labels,
      unnest(generate_series(1, greatest(len(string_split(host, '.')) - 1, 1))) AS i FROM hosts WHERE host IS NOT NULL)),
latest AS (
  SELECT k.page_id, d.list, d.key, arg_max(d.action, d.day) AS action
  FROM keyed k JOIN daily d ON d.key = k.key AND d.day <= k.day GROUP BY ALL),
verdict AS (
  SELECT page_id, count(*) AS n,
    array_to_string(list_sort(list_distinct(list(list) FILTER (WHERE action = 'block'))), ',') AS lists
  FROM latest GROUP BY page_id)
SELECT h.page_id, h.host, h.day, coalesce(v.n, 0) AS n_active, coalesce(v.lists, '') <> '' AS blocked,
  coalesce(v.lists, '') AS blocking_lists
FROM hosts h LEFT JOIN verdict v USING (page_id)
"""

_OP3 = r"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(list_transform(
    string_split(regexp_replace(coalesce(text, ''), '([.!?,;:])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)),
    lambda s: regexp_replace(s, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda s: s <> '') AS parts
  FROM documents),
starts AS (
  SELECT doc_id, parts, unnest(generate_series(1, greatest(len(parts) - 2, 1))) AS i FROM parts WHERE len(parts) > 0),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY parts[i : i + 2] ORDER BY doc_id, i) AS nth FROM starts),
covered AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS j FROM ranked WHERE nth > 1),
each AS (SELECT doc_id, unnest(parts) AS part, unnest(generate_series(1, len(parts))) AS j FROM parts WHERE len(parts) > 0),
stretches AS (
  SELECT c.doc_id, c.j, len(regexp_split_to_array(e.part, '[\x20\x09-\x0D]+')) AS n,
    c.j - row_number() OVER (PARTITION BY c.doc_id ORDER BY c.j) AS stretch
  FROM covered c JOIN each e ON e.doc_id = c.doc_id AND e.j = c.j),
gone AS (SELECT doc_id, j FROM stretches QUALIFY sum(n) OVER (PARTITION BY doc_id, stretch) >= 35),
kept AS (
  SELECT e.doc_id, count(g.j) AS n_removed, coalesce(string_agg(e.part, ' ' ORDER BY e.j) FILTER (WHERE g.j IS NULL), '') AS left_text
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.j = e.j GROUP BY e.doc_id)
SELECT p.doc_id, CAST(len(p.parts) AS BIGINT) AS n_sentences, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN coalesce(k.n_removed, 0) = 0 THEN p.text ELSE k.left_text END) AS kept_sha256
FROM parts p LEFT JOIN kept k USING (doc_id)
"""


def _rule_sql(r: quality_rules.Rule) -> str:
    bounds = [f"100 * {r.part} >= {r.at_least} * {r.whole}"] if r.at_least is not None else []
    bounds += [f"100 * {r.part} <= {r.at_most} * {r.whole}"] if r.at_most is not None else []
    return f"({r.whole} = 0 OR ({' AND '.join(bounds)}))"


_OP9 = rf"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, words[i : i + 7] AS w FROM (
    SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM cut WHERE len(words) >= 8)),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM counted, generate_series(0, 7) AS g(k) WHERE n > 1 GROUP BY doc_id),
measured AS (
  SELECT c.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(words, lambda w: rtrim(w, '.,;:') IN ({', '.join(f"'{w}'" for w in quality_rules.STOP_WORDS)}))) AS BIGINT) AS n_stop_words,
    CAST(len(lines) AS BIGINT) AS n_lines
  FROM cut c LEFT JOIN covered v USING (doc_id)),
base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND {' AND '.join(_rule_sql(r) for r in quality_rules.RULES)} AS kept FROM base
"""

_OP11 = r"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(generate_series(1, len(parts))) AS i FROM parts),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
lost AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE l.keeper <> k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE l.keeper IS NULL OR l.keeper = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN lost l USING (key) GROUP BY k.doc_id
"""


def _crc32(text: str) -> str:
    step = "lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"lambda crc, b: list_reduce(generate_series(CAST(1 AS BIGINT), 8), {step}, xor(crc, b))"
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS BIGINT))"
    return f"xor(list_reduce({codes}, {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"


_OP12 = rf"""
WITH own AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (SELECT *, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM own),
rebuilt AS (
  SELECT c.conv_id, coalesce(l.turns[1 : c.h], []) || c.turns[c.h + 1 :] AS path
  FROM hashed c LEFT JOIN own l ON l.conv_id = c.conv_id - c.conv_id % 5),
members AS (SELECT conv_id, path[1 : d] AS p, d, len(path) AS n FROM rebuilt, LATERAL (SELECT unnest(generate_series(0, len(path))) AS d)),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends
  FROM members GROUP BY p, d),
kids AS (SELECT p[1 : d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children,
    CASE WHEN d > 0 THEN (n_convs - 1) * strlen(n.p[d].t) ELSE 0 END AS saved
  FROM nodes n LEFT JOIN kids k USING (p)),
below AS (
  SELECT p[1 : k] AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM full_nodes, LATERAL (SELECT unnest(generate_series(0, d)) AS k) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, CAST(n.n_children AS BIGINT) AS n_children,
  b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN below b USING (p) LEFT JOIN nodes up ON n.d > 0 AND up.p = n.p[1 : n.d - 1]
"""


def _leaf_sql(text: str) -> str:
    fields = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


_OP13 = rf"""
WITH RECURSIVE claimed AS (
  SELECT *, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS said FROM documents),
hashed AS (
  SELECT doc_id, source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src, {_leaf_sql("text")} AS leaf, {_leaf_sql("said")} AS claim
  FROM claimed),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY src) AS n FROM hashed),
tree AS (
  SELECT src, 0 AS lvl, idx, n, leaf AS node FROM leaves
  UNION ALL
  SELECT src, lvl + 1, idx // 3, (max(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY src, lvl, idx // 3),
subroots AS (SELECT src, lvl AS height, node AS subroot FROM tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS lvl, src AS idx, (SELECT count(*) FROM subroots) AS n, subroot AS node FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 3, (max(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY idx)) FROM upper_tree WHERE n > 1 GROUP BY lvl, idx // 3),
root AS (SELECT node AS root, lvl AS height FROM upper_tree WHERE n = 1),
runs AS (
  SELECT src, lvl, idx // 3 AS run, list(node ORDER BY idx) AS nodes FROM tree WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT -1, lvl, idx // 3, list(node ORDER BY idx) FROM upper_tree WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT src, lvl, run, nodes, lvl AS step FROM runs WHERE src >= 0
  UNION ALL
  SELECT s.src, u.lvl, u.run, u.nodes, s.height + u.lvl FROM subroots s, runs u WHERE u.src = -1 AND u.run = s.src // CAST(3 ** (u.lvl + 1) AS BIGINT)),
fold AS (
  SELECT l.src, l.idx AS leaf_idx, 0 AS step, s.height, CASE WHEN s.height = 0 THEN l.src ELSE l.idx END AS at, l.claim AS value, '' AS siblings
  FROM leaves l JOIN subroots s USING (src)
  UNION ALL
  SELECT f.src, f.leaf_idx, f.step + 1, f.height, CASE WHEN f.step + 1 = f.height THEN f.src ELSE f.at // 3 END,
    sha256(array_to_string(t.nodes[1 : f.at % 3], '') || f.value || array_to_string(t.nodes[f.at % 3 + 2 :], '')),
    f.siblings || array_to_string(t.nodes[1 : f.at % 3], '') || array_to_string(t.nodes[f.at % 3 + 2 :], '')
  FROM fold f JOIN steps t ON t.src = f.src AND t.step = f.step AND t.run = f.at // 3)
SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(f.siblings) AS proof_sha256, f.value AS folded_root, f.value = r.root AS verified
FROM leaves l JOIN subroots s USING (src) CROSS JOIN root r JOIN fold f ON f.src = l.src AND f.leaf_idx = l.idx AND f.step = s.height + r.height
"""

ORACLE = {
    "op1_url_filters": _OP1, "op3_sentence_spans": _OP3, "op9_quality_rules": _OP9, "op11_line_dedup": _OP11,
    "op12_conversation_trie": _OP12, "op13_merkle_manifest": _OP13,
}
