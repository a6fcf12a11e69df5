"""The same queries in plain SQL for an independent engine."""

from __future__ import annotations

from trendloom import schemas as S
from trendloom.functions.text import WHITESPACE
from trendloom.plans.views import with_views

SQL: dict[str, str] = {}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(text) for name, text in SQL.items()}


def strip(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def blank_to_null(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def quoted(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def recode(column: str, mapping: dict[str, str], default: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {cases} ELSE {default} END"


def values(mapping: dict) -> str:
    return ", ".join(f"('{k}', {v})" if isinstance(k, str) else f"({k}, {v})" for k, v in mapping.items())


KIND = """CASE WHEN regexp_matches(doc_id, '^[0-9]{6,8}$') THEN 'granted'
 WHEN regexp_matches(doc_id, '^20[0-9]{9}$') THEN 'pregrant'
 WHEN regexp_matches(doc_id, '^RE[0-9]+$') THEN 'reissue' ELSE 'unknown' END"""
FILE_KIND = f"CASE WHEN {KIND} IN ('granted', 'reissue') THEN 'granted' WHEN {KIND} = 'pregrant' THEN 'pregrant' END"
LABELLED = "(SELECT * REPLACE (is_genuine_ai = 'True' AS is_genuine_ai, is_llm_related = 'true' AS is_llm_related) FROM <<classification>>)"
GENUINE = f"(SELECT * FROM {LABELLED} WHERE is_genuine_ai)"
GROUPED = f"""(SELECT *, {recode('ai_technique', S.TECH_GROUPS, "'other'")} AS tech_grouped,
 {recode('ai_technique', S.TECH_GROUPS_WITH_SPEECH, "'other'")} AS tech_grouped2 FROM {GENUINE})"""
YEAR_AXIS = "(SELECT CAST(range AS INT) AS year FROM range(2010, 2024))"


def key(column: str) -> str:
    return f"regexp_replace({column}, '^RE', '')"


# --- sources and sinks -----------------------------------------------------
SQL["scan_csv_strings"] = f"""
SELECT doc_id, lang, CASE WHEN {strip('text')} <> '' THEN text END AS text FROM <<texts>>"""
SQL["scan_csv_typed"] = """
SELECT ep_id, year, is_genuine_ai = 'True' AS is_genuine_ai, ai_technique, confidence FROM <<classification>>"""
SQL["scan_bulk_tsv"] = """
SELECT patent_id, seq, CASE WHEN substr(md5(patent_id || text), 1, 1) <> '0' THEN text END AS text
FROM <<claims>> WHERE substr(md5(patent_id || text), 1, 1) <> '1'"""
SQL["scan_bulk_tsv_quoted"] = "SELECT doc_id, lang, nullif(text, '') AS text FROM <<texts>>"
SQL["land_zip_archives"] = "SELECT patent_id, seq, text FROM <<claims>>"
SQL["scan_yearly_files"] = "SELECT patent_id, claim_type, year, seq, text FROM <<claims>>"
SQL["resolve_columns"] = "SELECT patent_id, seq, text FROM <<claims>>"
SQL["scan_publications_nested"] = """
SELECT publication_number, publication_date, array_to_string(list_transform(cpc, lambda x: x.code), '|') AS codes,
       CAST(coalesce(len(priority_claim), 0) AS INT) AS n_priorities FROM <<publication_rows>>"""
SQL["union_variant_rows"] = """
SELECT doc_id, status, CASE WHEN status = 'success' THEN ai_technique END AS ai_technique,
       CASE WHEN status <> 'success' THEN 'no answer' END AS raw_response FROM <<classification>>"""
SQL["write_projected"] = "SELECT ep_id, year, is_genuine_ai, ai_technique, status FROM <<classification>>"

_DIMENSIONS = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS value FROM {GENUINE}" for d in S.SUMMARY_DIMENSIONS
)
_PROFILE = f"""SELECT dimension, value, n, CAST(row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS INT) AS rank
FROM (SELECT dimension, value, count(*) AS n FROM ({_DIMENSIONS}) WHERE value IS NOT NULL GROUP BY 1, 2)
QUALIFY rank <= 10"""
SQL["all_dimension_profile"] = f"SELECT dimension, value, n, rank FROM ({_PROFILE})"
_SUMMARY = f"""SELECT total, success, genuine, non_genuine, round(success * 100 / total, 6) AS success_pct,
 round(genuine * 100 / success, 6) AS genuine_pct, round(non_genuine * 100 / success, 6) AS non_genuine_pct
FROM (SELECT count(*) AS total, count(*) FILTER (status = 'success') AS success,
 count(*) FILTER (status = 'success' AND is_genuine_ai) AS genuine,
 count(*) FILTER (status = 'success' AND NOT is_genuine_ai) AS non_genuine FROM {LABELLED})"""
SQL["label_summary"] = _SUMMARY
SQL["write_summary_report"] = f"""
WITH s AS ({_SUMMARY}), p AS ({_PROFILE})
SELECT 'totals' AS section, CAST(1 AS INT) AS rank, 'classified' AS value, total AS n, CAST(100 AS DOUBLE) AS pct FROM s
UNION ALL SELECT 'totals', 2, 'successful', success, success_pct FROM s
UNION ALL SELECT 'totals', 3, 'genuine', genuine, genuine_pct FROM s
UNION ALL SELECT 'totals', 4, 'non_genuine', non_genuine, non_genuine_pct FROM s
UNION ALL SELECT dimension, rank, value, n, NULL FROM p
UNION ALL SELECT 'year', CAST(year - 2009 AS INT), CAST(year AS VARCHAR), count(*), NULL FROM {GENUINE}
WHERE status = 'success' GROUP BY year"""

# --- ids and universe ------------------------------------------------------
SQL["id_kind"] = f"SELECT doc_id, {KIND} AS kind FROM <<universe>>"
SQL["reissue_join_key"] = f"""
SELECT u.doc_id, {key('u.doc_id')} AS key, t.patent_title FROM <<universe>> u
JOIN <<granted_titles>> t ON {key('u.doc_id')} = {key('t.patent_id')}"""
SQL["universe_counts"] = f"""
SELECT kind, count(*) AS n FROM (SELECT {KIND} AS kind FROM <<universe>>) GROUP BY kind
UNION ALL SELECT 'total', count(*) FROM <<universe>>"""
SQL["restrict_to_universe"] = f"""
SELECT * FROM <<claims>> WHERE {key('patent_id')} IN
 (SELECT {key('doc_id')} FROM <<universe>> WHERE {KIND} <> 'unknown')"""
SQL["first_seen_dedup"] = """
SELECT * FROM <<claims>> QUALIFY row_number() OVER (PARTITION BY patent_id ORDER BY year, seq, text, claim_type) = 1"""
SQL["source_tag"] = f"""
SELECT doc_id, CASE WHEN {KIND} IN ('granted', 'reissue') THEN 'granted' ELSE 'pregrant' END AS source FROM <<universe>>"""

# --- projections and predicates --------------------------------------------
SQL["text_flags"] = f"""
SELECT doc_id, length({strip("split_part(coalesce(text, ''), '.', 1)")}) > 2 AS has_title,
       length({strip("coalesce(text, '')")}) > 10 AS has_abstract FROM documents"""
_HAS_ABSTRACT, _HAS_CLAIM = (f"{blank_to_null(c)} IS NOT NULL" for c in ("abstract", "claim1_text"))
SQL["presence_flags"] = f"""
SELECT doc_id, {_HAS_ABSTRACT} AS has_abstract, {_HAS_CLAIM} AS has_claim,
       {_HAS_ABSTRACT} AND {_HAS_CLAIM} AS has_both FROM <<model_input>>"""
SQL["truncate_text"] = """
SELECT doc_id, substr(text, 1, 800) AS claim, substr(text, 1, 600) AS abstract, substr(text, 1, 200) AS raw,
       CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS shown FROM documents"""
SQL["status_filter"] = "SELECT doc_id, status FROM <<classification>> WHERE status = 'success'"
SQL["genuine_split"] = """
SELECT doc_id, CASE is_genuine_ai WHEN 'True' THEN 'genuine' ELSE 'non_genuine' END AS part
FROM <<classification>> WHERE status = 'success' AND is_genuine_ai IN ('True', 'False')"""
SQL["normalise_bool"] = "SELECT doc_id, is_genuine_ai, is_llm_related FROM " + LABELLED
SQL["require_text"] = f"""
SELECT doc_id, abstract FROM <<model_input>> WHERE {strip("coalesce(abstract, '')")} <> ''"""
SQL["recode_labels"] = f"SELECT doc_id, tech_grouped, tech_grouped2 FROM {GROUPED}"
SQL["recode_nullable"] = f"""
SELECT doc_id, {recode('ai_technique', S.TECH_COMPARISON, 'NULL')} AS tech_cmp FROM {GENUINE}"""
SQL["display_labels"] = f"""
SELECT doc_id, {recode('application_domain', S.DOMAIN_CAPTIONS, 'application_domain')} AS domain,
       {recode('contribution_type', S.CONTRIBUTION_CAPTIONS, 'contribution_type')} AS contribution,
       {recode('tech_grouped', S.TECH_GROUP_CAPTIONS, 'tech_grouped')} AS technique,
       {recode('tech_grouped2', S.HEATMAP_TECH_CAPTIONS, 'tech_grouped2')} AS heat_technique,
       {recode('application_domain', S.HEATMAP_DOMAIN_CAPTIONS, 'application_domain')} AS heat_domain FROM {GROUPED}"""
SQL["country_groups"] = f"""
SELECT ep_id, applicant_country IN ({quoted(S.EU27)}) AS is_eu27,
       applicant_country IN ({quoted(S.EU10)}) AS is_eu10 FROM <<country>>"""
SQL["year_range"] = "SELECT doc_id, year FROM <<universe>> WHERE year BETWEEN 2015 AND 2023"
SQL["rename_prefix"] = """
SELECT r.doc_id, r.second_genuine AS is_genuine_ai, c.is_genuine_ai AS v4_is_genuine_ai,
       c.ai_technique AS v4_ai_technique, c.innovation_orientation AS v4_innovation_orientation
FROM <<rater_pair>> r JOIN <<classification>> c USING (doc_id)"""

# --- first claims and joins ------------------------------------------------
_FIRST = f"""(SELECT c.* FROM <<claims>> c JOIN
 (SELECT claim_type, year, max(CASE WHEN seq = '0' AND starts_with({strip('text')}, '1.') THEN 1 ELSE 0 END) AS zero
  FROM <<claims>> GROUP BY 1, 2) f ON c.claim_type = f.claim_type AND c.year = f.year
 WHERE c.seq = CASE WHEN zero = 1 THEN '0' ELSE '1' END)"""
_RECORDS = f"""(SELECT u.doc_id, min({strip('c.text')}) AS claim1_text, c.claim_type, c.year FROM {_FIRST} c
 JOIN (SELECT DISTINCT doc_id, {key('doc_id')} AS key, {FILE_KIND} AS kind FROM <<universe>>) u
 ON {key('c.patent_id')} = u.key AND c.claim_type = u.kind GROUP BY u.doc_id, c.claim_type, c.year)"""
_CLAIM1 = f"""(SELECT * FROM {_RECORDS} QUALIFY row_number() OVER
 (PARTITION BY doc_id ORDER BY claim_type, year, claim1_text) = 1)"""
SQL["first_claim"] = f"SELECT * FROM {_FIRST}"
SQL["first_claim_dedup"] = f"SELECT * FROM {_CLAIM1}"
SQL["claim_coverage"] = f"""
SELECT *, round(documents_found * 100 / universe_size, 6) AS coverage_pct FROM
 (SELECT (SELECT count(*) FROM {_RECORDS} WHERE claim_type = 'granted') AS granted_found,
         (SELECT count(*) FROM {_RECORDS} WHERE claim_type = 'pregrant') AS pregrant_found,
         (SELECT count(DISTINCT doc_id) FROM {_RECORDS}) AS documents_found,
         (SELECT count(DISTINCT doc_id) FROM <<universe>> WHERE {KIND} <> 'unknown') AS universe_size)"""


def _lookup(table: str, id_col: str, text_col: str, name: str) -> str:
    return f"(SELECT {key(id_col)} AS key, min({blank_to_null(text_col)}) AS {name} FROM <<{table}>> GROUP BY 1)"


_TEXTS = f"""(SELECT u.doc_id, coalesce(title, '') AS title, coalesce(ga, pa, '') AS abstract FROM <<universe>> u
 LEFT JOIN {_lookup('granted_titles', 'patent_id', 'patent_title', 'title')} t ON {key('u.doc_id')} = t.key
 LEFT JOIN {_lookup('granted_abstracts', 'patent_id', 'patent_abstract', 'ga')} g ON {key('u.doc_id')} = g.key
 LEFT JOIN {_lookup('pregrant_abstracts', 'pgpub_id', 'application_abstract', 'pa')} p ON {key('u.doc_id')} = p.key)"""
SQL["assemble_text"] = f"""
SELECT doc_id, title, abstract, CASE WHEN {KIND} IN ('granted', 'reissue') THEN 'granted' ELSE 'pregrant' END AS source,
       length({strip('title')}) > 2 AS has_title, length({strip('abstract')}) > 10 AS has_abstract FROM {_TEXTS}"""
_MERGED = f"""(SELECT u.doc_id, u.year, nullif(title, '') AS title, nullif(abstract, '') AS abstract, claim1_text, claim_type
 FROM <<universe>> u LEFT JOIN {_TEXTS} t ON u.doc_id = t.doc_id LEFT JOIN {_CLAIM1} c ON u.doc_id = c.doc_id)"""
SQL["corpus_left_join"] = f"""
SELECT doc_id, year, title, abstract, substr(claim1_text, 1, 800) AS claim1_text_truncated, claim_type,
       abstract IS NOT NULL AS has_abstract, claim1_text IS NOT NULL AS has_claim FROM {_MERGED}"""
SQL["model_corpus"] = SQL["corpus_left_join"]
SQL["bridge_join"] = """
SELECT c.doc_id, c.ai_technique, u.year FROM <<classification>> c LEFT JOIN <<universe>> u USING (doc_id)"""
SQL["text_join"] = """
SELECT c.doc_id, c.ai_technique, t.text FROM <<classification>> c LEFT JOIN <<texts>> t USING (doc_id)"""
SQL["anti_processed"] = """
SELECT doc_id, year FROM <<universe>> WHERE doc_id NOT IN (SELECT doc_id FROM <<classification>> WHERE year <= 2016)"""
SQL["semi_target"] = "SELECT doc_id, year FROM <<universe>> WHERE doc_id IN (SELECT doc_id FROM <<texts>>)"
SQL["result_input_zip"] = "SELECT doc_id, lang, CAST(length(text) AS VARCHAR) AS answer FROM <<texts>>"
SQL["dim_lookup"] = f"""
SELECT year, n, CAST(amount AS DOUBLE) AS amount FROM (SELECT year, count(*) AS n FROM {GENUINE} GROUP BY 1)
LEFT JOIN (VALUES {values(S.US_INVESTMENT)}) d(year, amount) USING (year)"""
_EPO = f"""(SELECT ep_id, g.year, innovation_orientation, applicant_country FROM {GENUINE} g
 JOIN (SELECT ep_id, applicant_country FROM <<country>>) c USING (ep_id) WHERE office = 'EPO')"""
SQL["label_country_join"] = f"SELECT ep_id, year, innovation_orientation, applicant_country FROM {_EPO}"
SQL["rater_pair_join"] = """
SELECT doc_id, first_genuine, first_technique, second_genuine, second_technique FROM <<rater_pair>>"""

# --- nested arrays ---------------------------------------------------------
_LONG = "len(list_filter(abstract_localized, lambda x: x.language = 'en' AND x.text IS NOT NULL AND length(x.text) > 50)) > 0"
_TITLE = "list_filter(title_localized, lambda x: x.language = 'en')[1].text"
_ABSTRACT = "list_filter(abstract_localized, lambda x: x.language = 'en' AND x.text IS NOT NULL)[1].text"
_EARLIEST = """substr(list_sort(list_transform(priority_claim,
 lambda x: {'d': coalesce(x.filing_date, 0), 'p': x.publication_number}))[1].p, 1, 2)"""


def _codes(pattern: str) -> str:
    return f"list_filter(cpc, lambda x: regexp_matches(x.code, '{pattern}'))"


_NO_US = "len(list_filter(coalesce(priority_claim, []), lambda x: coalesce(x.application_number, '') LIKE 'US%')) = 0"
_PARSED_YEAR = "CAST(year(try_strptime(CAST(publication_date AS VARCHAR), '%Y%m%d')) AS INT)"
_DIVIDED_YEAR = "CAST(floor(publication_date / 10000) AS INT)"
SQL["pick_localized"] = f"SELECT publication_number, {_TITLE} AS title, {_ABSTRACT} AS abstract FROM <<publication_rows>>"
SQL["earliest_priority_country"] = f"SELECT publication_number, {_EARLIEST} AS country FROM <<publication_rows>>"
SQL["collect_codes"] = """
SELECT publication_number, array_to_string(list_transform(cpc, lambda x: x.code), '|') AS codes FROM <<publication_rows>>"""
SQL["exists_text"] = f"SELECT publication_number FROM <<publication_rows>> WHERE {_LONG}"
SQL["exists_code_match"] = f"""
SELECT publication_number, len({_codes(S.CPC_CANDIDATE)}) > 0 AS narrow, len({_codes(S.CPC_COUNTRY)}) > 0 AS wide FROM <<publication_rows>>"""
SQL["first_code_match"] = f"SELECT publication_number, {_codes(S.CPC_CANDIDATE)}[1].code AS cpc FROM <<publication_rows>>"
SQL["not_exists_us_priority"] = f"SELECT publication_number FROM <<publication_rows>> WHERE {_NO_US}"
SQL["first_country"] = """
SELECT publication_number, assignee_harmonized[1].country_code AS applicant_country,
       inventor_harmonized[1].country_code AS inventor_country FROM <<publication_rows>>"""
_CANDIDATES = f"""(SELECT * FROM (SELECT publication_number AS ep_id, {_PARSED_YEAR} AS year, {_TITLE} AS title,
 {_ABSTRACT} AS abstract, {_EARLIEST} AS priority_country, {_codes(S.CPC_CANDIDATE)}[1].code AS cpc
 FROM <<publication_rows>> WHERE country_code = 'EP' AND {_PARSED_YEAR} BETWEEN 2010 AND 2023 AND {_LONG}
 AND len({_codes(S.CPC_CANDIDATE)}) > 0) WHERE priority_country <> 'US' AND abstract IS NOT NULL)"""
SQL["candidate_query"] = f"SELECT * FROM {_CANDIDATES}"
SQL["country_query"] = f"""
SELECT publication_number AS ep_id, {_DIVIDED_YEAR} AS year, assignee_harmonized[1].country_code AS applicant_country,
       inventor_harmonized[1].country_code AS inventor_country FROM <<publication_rows>>
WHERE publication_number LIKE 'EP%' AND {_LONG} AND len({_codes(S.CPC_COUNTRY)}) > 0
  AND {_DIVIDED_YEAR} BETWEEN 2010 AND 2023 AND {_NO_US}"""
SQL["year_from_yyyymmdd"] = f"""
SELECT publication_number, {_PARSED_YEAR} AS parsed, {_DIVIDED_YEAR} AS divided FROM <<publication_rows>>"""
SQL["number_prefix"] = """
SELECT publication_number, country_code = 'EP' AS by_country,
       regexp_matches(publication_number, '^EP') AS by_number FROM <<publication_rows>>"""

# --- aggregations ----------------------------------------------------------
_BY_YEAR = f"(SELECT year, count(*) AS n FROM {GENUINE} GROUP BY year)"
SQL["count_by_year"] = f"SELECT year, n FROM {_BY_YEAR}"
SQL["count_by_year_dense"] = f"""
SELECT year, count(doc_id) AS n FROM {YEAR_AXIS} LEFT JOIN
 (SELECT doc_id, year FROM {GENUINE}) USING (year) GROUP BY year"""
SQL["value_counts_topk"] = f"""
SELECT application_domain, count(*) AS n FROM {GENUINE} WHERE application_domain IS NOT NULL
GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10"""
SQL["crosstab"] = f"""
SELECT year, {", ".join(f"count(*) FILTER (innovation_orientation = '{o}') AS {o}" for o in S.ORIENTATIONS)},
 count(*) FILTER (innovation_orientation NOT IN ({quoted(S.ORIENTATIONS)})) AS not_listed
FROM {GENUINE} WHERE innovation_orientation IS NOT NULL GROUP BY year"""
SQL["fixed_crosstab"] = f"""
WITH r AS (SELECT CAST(unnest(range(8)) AS INT) AS row_pos, unnest([{quoted(S.HEATMAP_TECHS)}]) AS tech_grouped2),
 c AS (SELECT CAST(unnest(range(8)) AS INT) AS col_pos, unnest([{quoted(S.HEATMAP_DOMAINS)}]) AS application_domain),
 x AS (SELECT row_pos, col_pos, tech_grouped2, application_domain,
  (SELECT count(*) FROM {GROUPED} g WHERE g.tech_grouped2 = r.tech_grouped2 AND g.application_domain = c.application_domain) AS n
  FROM r, c)
SELECT tech_grouped2, application_domain, row_pos, col_pos, n,
       round(n * 100 / nullif(CAST(sum(n) OVER (PARTITION BY row_pos) AS BIGINT), 0), 6) AS share FROM x"""
_ORIENTATION = f"""(SELECT year, innovation_orientation, n,
 n * 100 / CAST(sum(n) OVER (PARTITION BY year) AS BIGINT) AS share
 FROM (SELECT year, innovation_orientation, count(*) AS n FROM {GENUINE}
  WHERE innovation_orientation IS NOT NULL GROUP BY 1, 2))"""
SQL["row_share"] = f"SELECT year, innovation_orientation, n, round(share, 6) AS share FROM {_ORIENTATION}"
SQL["share_of_total"] = f"""
SELECT application_domain, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM {GENUINE}), 6) AS share
FROM {GENUINE} WHERE application_domain IS NOT NULL GROUP BY 1"""
_APPLIED = f"""(SELECT office, year, share FROM (SELECT DISTINCT office FROM {GENUINE}) CROSS JOIN {YEAR_AXIS}
 LEFT JOIN (SELECT office, year, avg(CASE WHEN innovation_orientation = 'applied' THEN 1.0 ELSE 0.0 END) * 100 AS share
  FROM {GENUINE} GROUP BY 1, 2) USING (office, year))"""
SQL["conditional_share_by_year"] = f"SELECT office, year, round(share, 6) AS share FROM {_APPLIED}"
_FLAGS = f"(SELECT year, {_HAS_ABSTRACT} AS has_abstract, {_HAS_CLAIM} AS has_claim FROM <<model_input>>)"
SQL["coverage_report"] = " UNION ALL ".join(
    f"""SELECT '{name}' AS flag, count(*) FILTER ({test}) AS n_true, count(*) AS total,
 round(count(*) FILTER ({test}) * 100 / count(*), 6) AS pct FROM {_FLAGS}"""
    for name, test in (("has_abstract", "has_abstract"), ("has_claim", "has_claim"), ("has_both", "has_abstract AND has_claim"))
)
SQL["coverage_by_year"] = f"""
SELECT year, count(*) FILTER (has_claim) AS n_with, count(*) AS total,
       round_even(count(*) FILTER (has_claim) / count(*) * 100 * 10, 0) / 10 AS pct FROM {_FLAGS} GROUP BY year"""
SQL["missing_count"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_missing, count(*) AS total FROM <<model_input>>"
    for c in ("title", "abstract", "claim1_text")
)
_COUNTRY_YEARS = f"(SELECT applicant_country, year, count(*) AS n FROM {_EPO} GROUP BY 1, 2)"
SQL["country_breakdown"] = f"""
SELECT applicant_country, CAST(sum(n) AS BIGINT) AS total, round(regr_slope(n, year), 6) AS slope,
       round(CAST(sum(n) AS BIGINT) * 100 / (SELECT count(*) FROM {_EPO}), 6) AS share
FROM {_COUNTRY_YEARS} GROUP BY 1 ORDER BY total DESC, 1 LIMIT 15"""
SQL["country_year_matrix"] = f"""
SELECT applicant_country, {", ".join(f"count(*) FILTER (year = {y}) AS y{y}" for y in S.YEARS)}
FROM {_EPO} WHERE applicant_country IN ({quoted(S.EU10)}) GROUP BY 1"""

# --- windows and trends ----------------------------------------------------
SQL["yoy_jump"] = f"""
SELECT a.year, a.n, b.n AS previous, a.n - b.n AS jump, round((a.n - b.n) * 100 / b.n, 6) AS pct_jump
FROM {_BY_YEAR} a JOIN {_BY_YEAR} b ON b.year = 2019 WHERE a.year = 2020"""
SQL["avg_annual_change"] = f"""
SELECT round(avg(CASE WHEN a.year <= 2019 THEN a.n - b.n END), 6) AS pre_avg,
       round(avg(CASE WHEN a.year > 2019 THEN a.n - b.n END), 6) AS post_avg
FROM {_BY_YEAR} a JOIN {_BY_YEAR} b ON a.year = b.year + 1"""
SQL["stack_bounds"] = f"""
WITH c AS (SELECT CAST(unnest(range(1, 9)) AS INT) AS position, unnest([{quoted(S.STACK_ORDER)}]) AS category),
 y AS (SELECT year, count(*) AS rows FROM {GROUPED} GROUP BY 1),
 n AS (SELECT year, tech_grouped AS category, count(*) AS n FROM {GROUPED} GROUP BY 1, 2),
 s AS (SELECT year, category, position, coalesce(n, 0) AS n, coalesce(n, 0) * 100 / rows AS share
  FROM y CROSS JOIN c LEFT JOIN n USING (year, category)),
 u AS (SELECT *, sum(share) OVER (PARTITION BY year ORDER BY position) AS upper FROM s)
SELECT year, category, n, position, round(share, 6) AS share, round(upper, 6) AS upper, round(upper - share, 6) AS lower FROM u"""
SQL["first_last_value"] = f"""
SELECT innovation_orientation, min(year) AS first_year, round(arg_min(share, year), 6) AS first_value,
       max(year) AS last_year, round(arg_max(share, year), 6) AS last_value FROM {_ORIENTATION} GROUP BY 1"""


def _growth_rounds() -> str:
    """The exponent where the slope of the squared error changes sign, by halving a bracket."""
    return f"""WITH RECURSIVE p AS (
 SELECT tech_grouped, CAST(year - 2010 AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n FROM {GROUPED} GROUP BY 1, 2),
g AS (SELECT tech_grouped, sum(n * n) AS sum_sq, var_pop(n) * count(*) AS sst, count(*) AS n_years FROM p GROUP BY 1),
tried AS (
 SELECT tech_grouped, b, sum(n * exp(b * x)) ** 2 / sum(exp(b * x * 2)) AS fit
 FROM p, (SELECT CAST(range AS DOUBLE) / 100 AS b FROM range(-100, 101)) GROUP BY tech_grouped, b),
halved AS (
 SELECT tech_grouped, arg_max(b, fit) - 0.01 AS low, arg_max(b, fit) + 0.01 AS high, 0 AS step FROM tried GROUP BY 1
 UNION ALL
 SELECT tech_grouped, CASE WHEN h > 0 THEN mid ELSE low END, CASE WHEN h > 0 THEN high ELSE mid END, step + 1
 FROM (SELECT tech_grouped, low, high, step, (low + high) / 2 AS mid,
   sum(n * x * exp((low + high) / 2 * x)) * sum(exp((low + high) * x))
    - sum(n * exp((low + high) / 2 * x)) * sum(x * exp((low + high) * x)) AS h
  FROM halved JOIN p USING (tech_grouped) WHERE step < 45 GROUP BY ALL)),
found AS (SELECT tech_grouped, (low + high) / 2 AS b FROM halved WHERE step = 45),
b4 AS (
 SELECT tech_grouped, b, sum(n * exp(b * x)) / sum(exp(b * x * 2)) AS a,
  any_value(sum_sq) - sum(n * exp(b * x)) ** 2 / sum(exp(b * x * 2)) AS sse
 FROM found JOIN p USING (tech_grouped) JOIN g USING (tech_grouped) GROUP BY tech_grouped, b)"""


SQL["exp_growth_fit"] = f"""{_growth_rounds()}
SELECT tech_grouped, n_years, round(a, 2) AS a, round(b, 6) AS b, round((exp(b) - 1) * 100, 3) AS growth_pct, round(1 - sse / sst, 6) AS r2
FROM b4 JOIN g USING (tech_grouped)"""
SQL["fit_curve_points"] = f"""{_growth_rounds()},
 q AS (SELECT tech_grouped, CAST(range AS INT) AS point, 2010 + CAST(range AS DOUBLE) * 13 / 299 AS x, a, b FROM b4, range(300))
SELECT tech_grouped, point, round(x, 2) AS x, round(a * exp(b * (x - 2010)), 2) AS fitted FROM q"""
_TREND = f"""(SELECT *, intercept + slope * year AS fitted FROM {_APPLIED} JOIN
 (SELECT office, regr_slope(share, year) AS slope, regr_intercept(share, year) AS intercept FROM {_APPLIED} GROUP BY 1) USING (office))"""
SQL["linear_trend"] = f"""
SELECT office, year, round(share, 6) AS share, round(slope, 6) AS slope, round(intercept, 6) AS intercept,
       round(fitted, 6) AS fitted FROM {_TREND}"""
SQL["group_slope"] = f"""
SELECT applicant_country, round(regr_slope(n, year), 6) AS slope, count(*) AS n_years FROM {_COUNTRY_YEARS} GROUP BY 1"""
SQL["scatter_fit"] = f"""
SELECT count(*) AS n, round(regr_slope(total, amount), 6) AS slope, round(regr_intercept(total, amount), 6) AS intercept,
       round(corr(total, amount), 6) AS r
FROM (SELECT applicant_country, count(*) AS total FROM {_EPO} GROUP BY 1)
JOIN (VALUES {values(S.EU10_INVESTMENT_2023)}) d(applicant_country, amount) USING (applicant_country)"""
_FEATURES = f"""(SELECT office, year, n, CAST(amount AS DOUBLE) AS amount, ln(n) AS log_patents, ln(amount) AS log_inv,
 CASE WHEN year IN (2020, 2021) THEN 1 ELSE 0 END AS covid
 FROM (SELECT office, year, count(*) AS n FROM {GENUINE} WHERE year >= 2015 GROUP BY 1, 2)
 JOIN (SELECT 'USPTO' AS office, * FROM (VALUES {values(S.US_INVESTMENT)}) u(year, amount)
  UNION ALL SELECT 'EPO', * FROM (VALUES {values(S.EU10_INVESTMENT)}) e(year, amount)) USING (office, year))"""
SQL["covid_flag"] = f"""
SELECT office, year, n, amount, round(log_patents, 6) AS log_patents, round(log_inv, 6) AS log_inv,
       CAST(covid AS INT) AS covid FROM {_FEATURES}"""
# Partialled out by the two-valued flag: means inside and outside the flagged years.
_OLS = f"""f AS {_FEATURES},
 m AS (SELECT office, covid, count(*) AS k, avg(log_patents) AS y, avg(log_inv) AS v FROM f GROUP BY 1, 2),
 w AS (SELECT office, sum((log_inv - v) * (log_patents - y)) / sum((log_inv - v) ** 2) AS b_inv, sum((log_inv - v) ** 2) AS svv
  FROM f JOIN m USING (office, covid) GROUP BY 1),
 b AS (SELECT office, b_inv, svv, m0.k AS k0, m1.k AS k1, m0.v AS v0, m1.v AS v1,
  m1.y - m0.y - b_inv * (m1.v - m0.v) AS b_covid, m0.y - b_inv * m0.v AS b_const
  FROM w JOIN m m0 USING (office) JOIN m m1 USING (office) WHERE m0.covid = 0 AND m1.covid = 1),
 e AS (SELECT office, count(*) AS n, sum((log_patents - b_const - b_covid * covid - b_inv * log_inv) ** 2) AS sse,
  var_pop(log_patents) * count(*) AS sst FROM f JOIN b USING (office) GROUP BY 1),
 s AS (SELECT *, sse / (n - 3) AS s2 FROM b JOIN e USING (office)),
 t AS (SELECT office, n, 1 - sse / sst AS r2, 'const' AS term, b_const AS coef, sqrt(s2 * (1 / k0 + v0 * v0 / svv)) AS se FROM s
  UNION ALL SELECT office, n, 1 - sse / sst, 'covid', b_covid, sqrt(s2 * (1 / k0 + 1 / k1 + (v1 - v0) ** 2 / svv)) FROM s
  UNION ALL SELECT office, n, 1 - sse / sst, 'log_inv', b_inv, sqrt(s2 / svv) FROM s)"""
# Student quantiles for the degrees of freedom that nine or fewer years leave.
_T = "CASE n WHEN 9 THEN 2.4469118511449692 WHEN 8 THEN 2.5705818356363141 WHEN 7 THEN 2.7764451051977987 END"
SQL["log_log_ols"] = f"""
WITH {_OLS}
SELECT office, term, round(coef, 6) AS coef, round(se, 6) AS se, round(coef - {_T} * se, 6) AS ci_low,
       round(coef + {_T} * se, 6) AS ci_high, round(r2, 6) AS r2, n FROM t"""
SQL["log_log_fitted"] = f"""
WITH {_OLS}
SELECT office, year, n, round(exp(b_const + b_covid * covid + b_inv * log_inv), 6) AS fitted FROM f JOIN b USING (office)"""
SQL["r_squared"] = f"""
SELECT office, round(regr_r2(share, year), 6) AS r2 FROM {_APPLIED} GROUP BY 1"""

# --- text and answers ------------------------------------------------------
_CLEAN = {c: strip(f"coalesce({c}, '')") for c in ("title", "abstract", "claim1_text", "answer", "text")}
SQL["clean_text"] = f"SELECT doc_id, {_CLEAN['abstract']} AS abstract FROM <<model_input>>"


def _chat(body: str) -> str:
    return (
        "'<|im_start|>system' || chr(10) || 'Label the document.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || "
        f"{body} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"
    )


def _full_prompt(claim: str) -> str:
    parts = ", ".join(
        f"CASE WHEN {strip(f'coalesce({c}, {chr(39)}{chr(39)})')} <> '' THEN '{caption}: ' || substr({strip(c)}, 1, {n}) END"
        for c, caption, n in (("title", "Title", 100000), ("abstract", "Abstract", 600), (claim, "First Independent Claim", 800))
    )
    return _chat(f"coalesce(nullif(concat_ws(chr(10) || chr(10), {parts}), ''), 'No text available.')")


def _short_prompt(title: str, abstract: str) -> str:
    return _chat(
        f"(CASE WHEN {title} <> '' THEN 'Title: ' || {title} || chr(10) ELSE '' END || 'Abstract: ' || substr({abstract}, 1, 800))"
    )


SQL["build_prompt_full"] = f"SELECT doc_id, {_full_prompt('claim1_text')} AS prompt FROM <<model_input>>"
SQL["build_prompt_short"] = f"SELECT doc_id, {_short_prompt(_CLEAN['title'], _CLEAN['abstract'])} AS prompt FROM <<model_input>>"
SQL["build_prompt_pilot"] = f"""
SELECT doc_id, 'Title: ' || {_CLEAN['title']} || chr(10) || chr(10) || 'Abstract: ' || {_CLEAN['abstract']} AS prompt,
       'Abstract: ' || substr({_CLEAN['abstract']}, 1, 800) AS short_prompt
FROM <<model_input>> WHERE {_CLEAN['abstract']} <> ''"""


def _inside(text: str) -> str:
    return f"regexp_replace(split_part({text}, '```', 2), '^json', '')"


_ANY = f"CASE WHEN contains({_CLEAN['answer']}, '```') THEN {_inside(_CLEAN['answer'])} ELSE {_CLEAN['answer']} END"
_PREFIX = f"CASE WHEN starts_with({_CLEAN['answer']}, '```') THEN {_inside(_CLEAN['answer'])} ELSE {_CLEAN['answer']} END"
SQL["strip_fence_any"] = f"SELECT k, {_ANY} AS body FROM <<answers>>"
SQL["strip_fence_prefix"] = f"SELECT k, {_PREFIX} AS body FROM <<answers>>"


def _braces(text: str) -> str:
    return f"nullif(regexp_extract({text}, '(?s)\\{{.*\\}}'), '')"


SQL["slice_braces"] = f"SELECT k, {_braces('answer')} AS body FROM <<answers>>"
# The JSON reader here lets trailing commas pass; strict readers do not.
_VALID = r"coalesce(json_valid(body) AND NOT regexp_matches(body, ',\s*[}\]]'), false)"


def _parsed(source: str, good: str) -> str:
    flag = "lower(json_extract_string(body, '$.is_genuine_ai'))"
    fields = ", ".join(
        f"CASE WHEN {good} THEN json_extract_string(body, '$.{c}') END AS {c}" for c in ("ai_technique", "confidence", "reasoning")
    )
    return f"""SELECT doc_id, CASE WHEN {good} THEN CASE {flag} WHEN 'true' THEN true WHEN 'false' THEN false END END AS is_genuine_ai,
 {fields}, CASE WHEN {good} THEN 'success' ELSE 'parse_error' END AS status FROM {source}"""


SQL["parse_labels"] = _parsed(f"(SELECT doc_id, {_braces(_ANY)} AS body FROM <<answers>>)", f"({_VALID} AND body <> '{{}}')")
SQL["parse_labels_prefix"] = _parsed(
    f"(SELECT doc_id, {strip(_PREFIX)} AS body FROM <<answers>>)", f"({_VALID} AND starts_with(body, '{{'))"
)
SQL["parse_status"] = f"""
SELECT doc_id, CASE WHEN clean = '' THEN 'skipped' ELSE state END AS status,
       CASE WHEN state <> 'success' THEN substr(coalesce(answer, ''), 1, 200) END AS raw_response
FROM (SELECT *, CASE WHEN NOT {_VALID} THEN 'json_error' WHEN starts_with(body, '{{') THEN 'success' ELSE 'error' END AS state
 FROM (SELECT doc_id, answer, {_CLEAN['answer']} AS clean, {strip(_PREFIX)} AS body FROM <<answers>>))"""
_MATCHES = {
    name: f"regexp_matches(lower(coalesce(reasoning, '')), '{pattern}')"
    for name, pattern in zip(["foundation", "federated", "agents", "distillation"], S.EMERGING_FAMILIES.values())
}
SQL["keyword_match"] = f"SELECT doc_id, {', '.join(f'{m} AS {n}' for n, m in _MATCHES.items())} FROM {GENUINE}"
SQL["emergence_rate"] = " UNION ALL ".join(
    f"""SELECT '{family}' AS family, year, count(*) FILTER ({match}) AS hits,
 round(count(*) FILTER ({match}) * 1000 / count(*), 6) AS per_thousand FROM {GENUINE} GROUP BY year"""
    for family, match in zip(S.EMERGING_FAMILIES, _MATCHES.values())
)

# --- samples ---------------------------------------------------------------
_SUCCESS = f"(SELECT * FROM {LABELLED} WHERE status = 'success')"
_DRAW = "md5(doc_id || ':42'), doc_id"


def _alloc(rows: str) -> str:
    return f"""(SELECT year, n, rounded + CASE WHEN row_number() OVER (ORDER BY rounded DESC, year) <= abs(gap) THEN sign(gap) ELSE 0 END AS alloc
 FROM (SELECT *, 100 - CAST(sum(rounded) OVER () AS BIGINT) AS gap FROM
  (SELECT year, n, CAST(round_even(n / CAST(sum(n) OVER () AS BIGINT) * 100, 0) AS BIGINT) AS rounded
   FROM (SELECT year, count(*) AS n FROM {rows} GROUP BY 1))))"""


def _stratified(rows: str) -> str:
    return f"""(SELECT r.* FROM (SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY {_DRAW}) AS INT) AS rank FROM {rows}) r
 JOIN {_alloc(rows)} a USING (year) WHERE rank <= alloc)"""


SQL["proportional_alloc"] = f"SELECT year, n, CAST(alloc AS BIGINT) AS alloc FROM {_alloc(LABELLED)}"
SQL["stratified_sample"] = f"SELECT doc_id, year, rank FROM {_stratified(LABELLED)}"
SQL["balanced_sample"] = f"""
SELECT doc_id, year, is_genuine_ai, CAST(row_number() OVER (PARTITION BY year, is_genuine_ai ORDER BY {_DRAW}) AS INT) AS rank
FROM {_SUCCESS} QUALIFY rank <= 4"""
SQL["diverse_sample"] = f"""
WITH g AS (SELECT * FROM {_SUCCESS}),
 a AS (SELECT * FROM g WHERE is_genuine_ai AND innovation_orientation = 'applied'
  QUALIFY row_number() OVER (PARTITION BY ai_technique ORDER BY doc_id) = 1),
 p AS (SELECT 1 AS pos, 'fundamental' AS part, 5 AS take, 5 AS needed, doc_id, ai_technique FROM g WHERE is_genuine_ai AND innovation_orientation = 'fundamental'
  UNION ALL SELECT 2, 'applied', 10, 10, doc_id, ai_technique FROM a
  UNION ALL SELECT 3, 'both', 2, 2, doc_id, ai_technique FROM g WHERE is_genuine_ai AND innovation_orientation = 'both'
  UNION ALL SELECT 4, 'non_genuine', 3, 0, doc_id, ai_technique FROM g WHERE NOT is_genuine_ai),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY part ORDER BY {_DRAW}) AS INT) AS rank FROM p),
 z AS (SELECT CASE WHEN is_genuine_ai THEN innovation_orientation ELSE 'non_genuine' END AS part, count(*) AS pool FROM g GROUP BY 1)
SELECT part, rank, doc_id, ai_technique FROM r JOIN z USING (part) WHERE rank <= take AND pool >= needed ORDER BY pos, rank LIMIT 20"""
SQL["review_sample"] = f"""
WITH pool AS (SELECT * FROM {_stratified(_SUCCESS)}),
 reasons AS (SELECT * FROM pool WHERE NOT is_genuine_ai QUALIFY row_number() OVER (PARTITION BY false_positive_reason ORDER BY doc_id) = 1)
SELECT CAST(part AS INT) AS part, doc_id, false_positive_reason FROM
 (SELECT 1 AS part, doc_id AS place, doc_id, false_positive_reason FROM pool WHERE is_genuine_ai
  UNION ALL SELECT 2, md5(doc_id || ':42'), doc_id, false_positive_reason FROM reasons) ORDER BY part, place, doc_id LIMIT 60"""
SQL["head_sample"] = f"""
SELECT doc_id, year, title, abstract, claim1_text FROM <<model_input>>
WHERE {_HAS_ABSTRACT} AND {_HAS_CLAIM} ORDER BY doc_id LIMIT 10"""

# --- validation ------------------------------------------------------------
_RATED = "(SELECT * FROM <<rater_pair>> WHERE first_genuine IS NOT NULL AND second_genuine IS NOT NULL)"
SQL["confusion"] = f"SELECT first_genuine, second_genuine, count(*) AS n FROM {_RATED} GROUP BY 1, 2"


def _kappa(rows: str, a: str, b: str) -> str:
    return f"""(SELECT n, po, pe, (po - pe) / (1 - pe) AS kappa FROM
 (SELECT (SELECT count(*) FROM {rows}) AS n, (SELECT avg(CASE WHEN {a} = {b} THEN 1.0 ELSE 0.0 END) FROM {rows}) AS po,
  (SELECT sum(x.n * CAST(y.n AS DOUBLE)) FROM (SELECT {a} AS c, count(*) AS n FROM {rows} GROUP BY 1) x
   JOIN (SELECT {b} AS c, count(*) AS n FROM {rows} GROUP BY 1) y USING (c)) / (SELECT count(*) FROM {rows}) ** 2 AS pe))"""


_BOTH_TECH = "(SELECT * FROM <<rater_pair>> WHERE first_technique IS NOT NULL AND second_technique IS NOT NULL)"
SQL["cohen_kappa"] = f"""
SELECT n, round(po, 6) AS po, round(pe, 6) AS pe, round(kappa, 6) AS kappa FROM {_kappa(_BOTH_TECH, 'first_technique', 'second_technique')}"""
SQL["recall_f1"] = f"""
SELECT office, tp, fn, fp, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision,
       round(2 * tp / (2 * tp + fp + fn), 6) AS f1
FROM (SELECT office, count(*) FILTER (first_genuine AND second_genuine) AS tp,
  count(*) FILTER (first_genuine AND NOT second_genuine) AS fn,
  count(*) FILTER (NOT first_genuine AND second_genuine) AS fp FROM {_RATED} GROUP BY 1)"""
_JOINT = "(SELECT * FROM <<rater_pair>> WHERE first_genuine AND second_genuine)"
SQL["agreement_rate"] = " UNION ALL ".join(
    f"""SELECT '{d}' AS dimension, count(*) FILTER (first_{d} IS NOT DISTINCT FROM second_{d}) AS agree, count(*) AS n,
 round(count(*) FILTER (first_{d} IS NOT DISTINCT FROM second_{d}) * 100 / count(*), 6) AS pct FROM {_JOINT}"""
    for d in ("technique", "orientation")
)
SQL["agreement_with_older_labels"] = """
SELECT 'orientation' AS dimension, count(*) FILTER (first_orientation = second_orientation) AS agree, count(*) AS n,
       round(count(*) FILTER (first_orientation = second_orientation) * 100 / count(*), 6) AS pct
FROM <<rater_pair>> WHERE second_genuine AND first_orientation IS NOT NULL"""
_OFFICE = {
    o: _kappa(f"(SELECT * FROM {_RATED} WHERE office = '{o}')", "first_genuine", "second_genuine") for o in ("USPTO", "EPO")
}
SQL["combine_batches"] = f"""
WITH b AS (SELECT 'USPTO' AS batch, n, kappa FROM {_OFFICE['USPTO']} UNION ALL SELECT 'EPO', n, kappa FROM {_OFFICE['EPO']})
SELECT batch, n, round(kappa, 6) AS kappa FROM b
UNION ALL SELECT 'weighted', CAST(sum(n) AS BIGINT), round(sum(kappa * n) / sum(n), 6) FROM b
UNION ALL SELECT 'pooled', n, round(kappa, 6) FROM {_kappa(_RATED, 'first_genuine', 'second_genuine')}"""
SQL["schema_conformance"] = " UNION ALL ".join(
    f"""SELECT '{d}' AS dimension, count(*) FILTER ({d} IS NULL) AS n_null,
 count(*) FILTER ({d} NOT IN ({quoted(v)})) AS n_outside, count(*) AS total FROM <<classification>>"""
    for d, v in S.VOCABULARY.items()
)
_FILLED = {
    "ai_technique": "ai_technique IS NOT NULL", "application_domain": "application_domain IS NOT NULL",
    "innovation_orientation": "innovation_orientation IS NOT NULL",
}
_FILLED["any"] = " OR ".join(_FILLED.values())
SQL["null_rule_check"] = " UNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) FILTER ({test}) AS n_filled, count(*) AS rows FROM {LABELLED} WHERE NOT is_genuine_ai"
    for f, test in _FILLED.items()
)


# --- scoring and incremental runs ------------------------------------------
def _stub(source: str, keys: str, failing: str = "3") -> str:
    """Labels the deterministic stub gives to the prompts of a source."""

    def digit(i: int) -> str:
        return f"(strpos('0123456789abcdef', substr(md5(prompt), {i}, 1)) - 1)"

    technique = f"CASE {digit(2)} % 11 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(S.TECHNIQUES)) + " END"
    failed = f"{digit(3)} % 4 IN ({failing})"
    return f"""SELECT {keys}, CASE WHEN NOT {failed} THEN {digit(1)} < 8 END AS is_genuine_ai,
 CASE WHEN NOT {failed} THEN {technique} END AS ai_technique,
 CASE WHEN {failed} THEN 'parse_error' ELSE 'success' END AS status FROM {source}"""


_DOC_PROMPT = _short_prompt("''", _CLEAN["text"])
SQL["score_batches"] = _stub(f"(SELECT doc_id, year, {_full_prompt('claim1_text')} AS prompt FROM <<model_input>>)", "doc_id, year")
SQL["resume_checkpoint"] = _stub(
    f"(SELECT doc_id, {_DOC_PROMPT} AS prompt, CAST(CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS INT) AS batch FROM <<texts>>)",
    "doc_id, batch",
)
SQL["compacted_results"] = _stub(
    f"""(SELECT doc_id, {_DOC_PROMPT} AS prompt,
 CAST((strpos('0123456789abcdef', substr(md5(doc_id), 1, 1)) - 1) // 4 AS INT) AS batch FROM <<texts>>)""",
    "doc_id, batch",
)
_TEXTS = f"(SELECT doc_id, {_DOC_PROMPT} AS prompt, CAST(1 AS BIGINT) AS n_results FROM <<texts>>)"
_FIRST = """CASE WHEN (strpos('0123456789abcdef', substr(md5(prompt), 4, 1)) - 1) % 2 = 0 THEN 'error'
 WHEN (strpos('0123456789abcdef', substr(md5(prompt), 3, 1)) - 1) % 4 = 3 THEN 'parse_error' ELSE 'success' END AS first_status"""
SQL["resumed_run"] = _stub(_TEXTS, "doc_id, n_results")
SQL["retry_failed"] = _stub(_TEXTS, f"doc_id, {_FIRST}")
_BAYES = r"""judged AS (
 SELECT d.doc_id, text, l.toxic, substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 1) IN ('0', '1', '2') AS held_out
 FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id),
tokens AS (
 SELECT doc_id, toxic, held_out, unnest(regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\p{L}\p{N}]+')) AS word FROM judged),
fitted AS (SELECT * FROM judged WHERE NOT held_out AND toxic IS NOT NULL AND text IS NOT NULL),
seen AS (
 SELECT word, count(*) FILTER (toxic) AS yes, count(*) FILTER (NOT toxic) AS no FROM tokens
 WHERE doc_id IN (SELECT doc_id FROM fitted) GROUP BY word HAVING count(DISTINCT doc_id) >= 3),
sums AS (SELECT sum(yes) + count(*) AS yes, sum(no) + count(*) AS no FROM seen),
weights AS (SELECT word, ln((s.yes + 1) / t.yes) - ln((s.no + 1) / t.no) AS weight FROM seen s, sums t),
odds AS (
 SELECT judged.doc_id, toxic, held_out, coalesce(w.total, 0) +
  (SELECT ln(count(*) FILTER (toxic) + 1) - ln(count(*) FILTER (NOT toxic) + 1) FROM fitted) AS log_odds
 FROM judged LEFT JOIN (SELECT doc_id, sum(weight) AS total FROM tokens JOIN weights USING (word) GROUP BY doc_id) w USING (doc_id))"""
SQL["train_text_classifier"] = f"""
WITH {_BAYES}
SELECT doc_id, round(log_odds, 6) AS log_odds, log_odds > 0 AS found_toxic,
       CASE WHEN abs(log_odds) >= 4 THEN 'high' WHEN abs(log_odds) >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM odds"""
SQL["classifier_holdout"] = f"""
WITH {_BAYES}
SELECT count(*) AS n_scored, count(toxic) AS n_labelled, count(*) FILTER (held_out AND toxic IS NOT NULL) AS n_held_out,
       round(count(*) FILTER (held_out AND toxic = (log_odds > 0)) / count(*) FILTER (held_out AND toxic IS NOT NULL), 6) AS accuracy,
       round(CASE WHEN count(*) FILTER (toxic) * 2 > count(toxic) THEN count(*) FILTER (held_out AND toxic)
        ELSE count(*) FILTER (held_out AND NOT toxic) END / count(*) FILTER (held_out AND toxic IS NOT NULL), 6) AS majority_share,
       round(count(*) FILTER (held_out AND toxic AND log_odds > 0) / nullif(count(*) FILTER (held_out AND toxic), 0), 6) AS recall
FROM odds"""
SQL["incremental_stream"] = _stub(f"(SELECT doc_id, {_DOC_PROMPT} AS prompt FROM <<event_docs>>)", "doc_id")

# --- sets, order, comparison -----------------------------------------------
SQL["union_all"] = """
SELECT patent_id AS doc_id, 'title' AS kind FROM <<granted_titles>>
UNION ALL SELECT pgpub_id, 'abstract' FROM <<pregrant_abstracts>>"""
SQL["set_union"] = "SELECT patent_id FROM <<granted_titles>> UNION SELECT patent_id FROM <<claims>>"
SQL["sort_limit"] = "SELECT * FROM <<country>> ORDER BY year, ep_id LIMIT 20"
_SIDES = ", ".join(
    f"""CAST(coalesce(max(n) FILTER (office = '{o}'), 0) AS BIGINT) AS {o.lower()}_n,
 round(max(share) FILTER (office = '{o}'), 6) AS {o.lower()}_applied_share,
 round(max(fitted) FILTER (office = '{o}'), 6) AS {o.lower()}_fitted"""
    for o in ("USPTO", "EPO")
)
SQL["two_corpus_compare"] = f"""
SELECT year, {_SIDES} FROM {_TREND}
LEFT JOIN (SELECT office, year, count(*) AS n FROM {GENUINE} GROUP BY 1, 2) USING (office, year) GROUP BY year"""
SQL["two_corpus_techniques"] = f"""
SELECT office, technique, count(*) FILTER (cmp = technique) AS n,
       round(count(*) FILTER (cmp = technique) * 100 / count(*), 6) AS share
FROM (SELECT office, {recode('ai_technique', S.TECH_COMPARISON, 'NULL')} AS cmp FROM {GENUINE}),
     (SELECT unnest([{quoted(S.TECH_COMPARISON.values())}]) AS technique) GROUP BY 1, 2"""

# --- lifecycles ------------------------------------------------------------
SQL["technique_share_by_year"] = f"""
SELECT year, tech_grouped, n, round(n * 100 / CAST(sum(n) OVER (PARTITION BY year) AS BIGINT), 6) AS share
FROM (SELECT year, tech_grouped, count(*) AS n FROM {GROUPED} GROUP BY 1, 2)"""
SQL["label_corpus"] = _stub(f"(SELECT doc_id, year, {_full_prompt('claim1_text')} AS prompt FROM {_MERGED})", "doc_id, year")
SQL["label_candidates"] = _stub(
    f"(SELECT ep_id, year, cpc, {_short_prompt(_CLEAN['title'], _CLEAN['abstract'])} AS prompt FROM {_CANDIDATES})",
    "ep_id, year, cpc", "2, 3",
)
