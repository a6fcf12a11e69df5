"""Document-shaped views over the star-schema test tables.

Each view is one SQL text that Spark and the checking engine both run; ``<<name>>`` stands for
another view or a base table. Rows are derived from whole tables: the remainders below only
assign values (id shapes, labels, answer styles), none of them drops rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom import schemas as S
from trendloom.functions.text import packed, unpacked
from trendloom.operators.reshape import split_by_keys
from trendloom.session import scratch_dir, small_methods
from trendloom.sources.delimited import read_publications
from trendloom.sources.sinks import land_publications

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# What the made-up columns choose from. Countries are in alphabetical order.
COUNTRIES = [
    "AT", "AU", "BE", "CA", "CH", "CN", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IL",
    "IN", "IT", "JP", "KR", "NL", "NO", "PL", "SE", "TW", "US",
]
PRIORITY_COUNTRIES = ["US", "DE", "JP", "CN", "FR", "KR"]
CODES = [
    "G06N3/04", "G06V10/82", "G10L15/22", "G10L25/30", "G06F18/22", "G06F40/30", "G16H50/20",
    "G05B13/02", "G06Q10/04", "H04L9/00", "A61B5/00", "G06F9/50",
]
LANGUAGES = ["en", "de", "en", "fr"]


@dataclass(frozen=True)
class Dialect:
    """The few spots where the two engines spell nested values differently."""

    name: str

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def struct(self, **fields: str) -> str:
        if self.spark:
            return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def array(self, *items: str) -> str:
        return ("array(" if self.spark else "list_value(") + ", ".join(items) + ")"

    def head(self, array: str, n: str) -> str:
        return f"slice({array}, 1, {n})" if self.spark else f"list_slice({array}, 1, {n})"

    def indexed_map(self, array: str, body: str) -> str:
        """Map over elements ``t`` and positions ``i``; Spark counts from 0, the other from 1."""
        head = "transform" if self.spark else "list_transform"
        arrow = "(t, i) ->" if self.spark else "lambda t, i:"
        return f"{head}({array}, {arrow} {body})"

    def lines(self, text: str) -> str:
        return f"split({text}, chr(10))" if self.spark else f"string_split({text}, chr(10))"


def pick(expr: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {cases} END"


def doc_id(k: str) -> str:
    text = f"CAST({k} AS STRING)"
    return (
        f"CASE WHEN {k} % 20 = 0 THEN 'RE' || lpad({text}, 7, '0') "
        f"WHEN {k} % 20 <= 8 THEN CAST(7000000 + {k} AS STRING) "
        f"WHEN {k} % 20 = 9 THEN 'X' || {text} ELSE '20' || lpad({text}, 9, '0') END"
    )


def bulk_id(k: str) -> str:
    """Reissues appear in bulk files without their prefix."""
    return f"CASE WHEN {k} % 20 = 0 THEN lpad(CAST({k} AS STRING), 7, '0') ELSE {doc_id(k)} END"


def year(ts: str) -> str:
    """1995-2001 by half-years onto 2010-2023."""
    return f"CAST(2010 + (year({ts}) - 1995) * 2 + CASE WHEN month({ts}) > 6 THEN 1 ELSE 0 END AS INT)"


UNIVERSE = f"SELECT {doc_id('o_orderkey')} AS doc_id, {year('o_orderdate')} AS year FROM <<orders>>"

TEXTS = f"""
SELECT {doc_id('doc_id')} AS doc_id, {bulk_id('doc_id')} AS bulk_id, text, lang FROM <<documents>>"""

# In the bulk files most ids stand twice, the second time with the text of the document before or
# with none, so that which row comes first shows in the results.
BULK_TEXTS = f"""
SELECT doc_id, bulk_id, text, lang FROM <<texts>>
UNION ALL
SELECT {doc_id('(doc_id + 1)')}, {bulk_id('(doc_id + 1)')}, CASE WHEN doc_id % 3 <> 0 THEN text END, lang FROM <<documents>>"""

GRANTED_TITLES = """
SELECT CASE WHEN lang = 'en' THEN bulk_id ELSE doc_id END AS patent_id,
       CASE WHEN lang <> 'es' THEN split_part(text, '.', 1) END AS patent_title
FROM <<bulk_texts>> WHERE length(doc_id) < 11 AND doc_id NOT LIKE 'X%'"""

GRANTED_ABSTRACTS = """
SELECT bulk_id AS patent_id, text AS patent_abstract
FROM <<bulk_texts>> WHERE length(doc_id) < 11 AND doc_id NOT LIKE 'X%'"""

PREGRANT_ABSTRACTS = """
SELECT doc_id AS pgpub_id, text AS application_abstract FROM <<bulk_texts>> WHERE length(doc_id) = 11"""

# Granted files count claims from 0, except 2012, whose texts carry no number.
CLAIMS = f"""
SELECT {bulk_id('l_orderkey')} AS patent_id,
       CASE WHEN l_orderkey % 20 <= 8 THEN 'granted' ELSE 'pregrant' END AS claim_type,
       {year('l_shipdate')} AS year,
       CAST(CASE WHEN l_orderkey % 20 <= 8 THEN l_linenumber - 1 ELSE l_linenumber END AS STRING) AS seq,
       CASE WHEN {year('l_shipdate')} = 2012 THEN 'Claim: ' ELSE CAST(l_linenumber AS STRING) || '. ' END
         || 'A method using part ' || CAST(l_partkey AS STRING)
         || ' of supplier ' || CAST(l_suppkey AS STRING) AS text
FROM <<lineitem>>"""

REASONING = [
    "uses a large language model", "Federated learning of devices", "multi-agent planning",
    "teacher-student distillation",
]

_RAW_LABELS = f"""
SELECT o_orderkey AS k, {doc_id('o_orderkey')} AS doc_id, 'EP' || CAST(o_orderkey AS STRING) AS ep_id,
       {year('o_orderdate')} AS year,
       CASE WHEN o_orderkey % 4 = 0 THEN 'EPO' ELSE 'USPTO' END AS office,
       CASE WHEN o_orderkey % 50 = 7 THEN 'parse_error' ELSE 'success' END AS status,
       CASE WHEN o_orderkey % 50 = 7 THEN NULL WHEN o_orderstatus = 'F' THEN 'True'
            WHEN o_orderstatus = 'O' THEN 'False'
            WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END AS is_genuine_ai,
       CASE WHEN o_orderkey % 17 = 0 THEN 'quantum_annealing'
            ELSE {pick('o_custkey % 11', S.TECHNIQUES)} END AS ai_technique,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL
            ELSE {pick('o_custkey % 21', S.DOMAINS)} END AS application_domain,
       {pick('o_orderkey % 6', S.MODALITIES)} AS data_modality,
       CASE WHEN o_orderpriority LIKE '1%' THEN 'fundamental' WHEN o_orderpriority LIKE '2%' THEN 'both'
            ELSE 'applied' END AS innovation_orientation,
       {pick('o_orderkey % 7', S.TASKS)} AS core_ai_task,
       {pick('o_custkey % 5', S.CONTRIBUTIONS)} AS contribution_type,
       {pick('o_orderkey % 5', S.PARADIGMS)} AS training_paradigm,
       CASE WHEN o_orderkey % 10 = 0 THEN 'true' ELSE 'false' END AS is_llm_related,
       {pick('o_custkey % 3', S.CONFIDENCES)} AS confidence,
       o_orderkey % 10 AS reason_kind, o_custkey
FROM <<orders>>"""


def _if_genuine(column: str) -> str:
    return f"CASE WHEN is_genuine_ai = 'True' THEN {column} END AS {column}"


CLASSIFICATION = f"""
SELECT k, doc_id, ep_id, year, office, status, is_genuine_ai,
       CASE WHEN is_genuine_ai = 'False' THEN 'not a learning method, case ' || CAST(k % 7 AS STRING) END
         AS false_positive_reason,
       {", ".join(_if_genuine(c) for c in (
           "ai_technique", "application_domain", "data_modality"))},
       CASE WHEN is_genuine_ai = 'True' OR (is_genuine_ai = 'False' AND k % 13 = 0)
            THEN innovation_orientation END AS innovation_orientation,
       {", ".join(_if_genuine(c) for c in (
           "core_ai_task", "contribution_type", "training_paradigm", "is_llm_related"))},
       CASE WHEN status = 'success' THEN confidence END AS confidence,
       CASE WHEN is_genuine_ai IS NULL OR reason_kind = 4 THEN NULL
            WHEN reason_kind < 4 THEN {pick('reason_kind', REASONING)}
            ELSE 'applies ' || coalesce(application_domain, 'a method') END AS reasoning
FROM <<raw_labels>>"""

# The second rater disagrees on every ninth document.
RATER_PAIR = f"""
SELECT doc_id, year, office, is_genuine_ai = 'True' AS first_genuine, ai_technique AS first_technique,
       innovation_orientation AS first_orientation,
       CASE WHEN k % 9 = 0 THEN is_genuine_ai <> 'True' ELSE is_genuine_ai = 'True' END AS second_genuine,
       CASE WHEN k % 3 = 0 THEN {pick('k % 11', S.TECHNIQUES)} ELSE ai_technique END AS second_technique,
       CASE WHEN k % 5 = 0 THEN 'applied' ELSE innovation_orientation END AS second_orientation
FROM <<classification>>"""

_OBJECT = (
    "'{\"is_genuine_ai\": ' || lower(coalesce(is_genuine_ai, 'null')) || ', \"ai_technique\": '"
    " || CASE WHEN ai_technique IS NULL THEN 'null' ELSE '\"' || ai_technique || '\"' END"
    " || ', \"confidence\": \"high\", \"reasoning\": \"case ' || CAST(k AS STRING) || '\"}'"
)
_ANSWERS = [
    "obj",
    "'```' || chr(10) || obj || chr(10) || '```'",
    "'```json' || chr(10) || obj || chr(10) || '```'",
    "'Here is the label: ' || obj || ' I hope this helps.'",
    "replace(obj, '\"', '''')",
    "'{}'",
    "obj || ' ' || obj",
    "substr(obj, 1, 30)",
    "''",
    "CAST(NULL AS STRING)",
    "replace(replace(obj, ': true', ': \"True\"'), ': false', ': \"False\"')",
    "replace(obj, '\"confidence\"', '\"doc_id\": \"overwritten\", \"confidence\"')",
    "replace(obj, '\"high\"', '\"high\", \"more\": {\"a\": [1, 2]}')",
    "replace(obj, 'case', 'Größe é 中')",
    "replace(obj, '}', ', }')",
    "'no label can be given'",
    "'  ' || chr(10) || chr(9) || obj || chr(10)",
    "obj || ', \"x\": {}'",
    "'[' || obj || ']'",
    "'42'",
]
ANSWERS = f"""
SELECT k, doc_id, year, CASE k % {len(_ANSWERS)} {" ".join(f"WHEN {i} THEN {a}" for i, a in enumerate(_ANSWERS))} END AS answer
FROM (SELECT *, {_OBJECT} AS obj FROM <<classification>>) s"""

COUNTRY = f"""
SELECT 'EP' || CAST(o_orderkey AS STRING) AS ep_id, {year('o_orderdate')} AS year,
       {pick('c_nationkey', COUNTRIES)} AS applicant_country,
       {pick('o_custkey % 25', COUNTRIES)} AS inventor_country
FROM <<orders>> JOIN <<customer>> ON o_custkey = c_custkey"""

MODEL_INPUT = """
SELECT u.doc_id, u.year, split_part(t.text, '.', 1) AS title, t.text AS abstract, c.claim AS claim1_text
FROM <<universe>> u LEFT JOIN <<texts>> t ON u.doc_id = t.doc_id
LEFT JOIN (SELECT patent_id, min(text) AS claim FROM <<claims>> GROUP BY patent_id) c ON u.doc_id = c.patent_id"""

EVENT_DOCS = """
SELECT CAST(event_id AS STRING) AS doc_id, event_type || ' ' || props AS text FROM <<events>>"""


def choose(expr: str, values: list[str]) -> str:
    """``pick`` for long lists that are used often: one lookup instead of a chain of tests."""
    return f"split_part('{','.join(values)}', ',', CAST({expr} + 1 AS INT))"


_PREFIX = "CASE WHEN l_suppkey % 25 = 0 THEN 'US' ELSE 'EP' END"
_BASE = f"({year('l_shipdate')} * 10000 + month(l_shipdate) * 100)"


def record_order(prefix: str, base: str, day: str, year: str) -> dict[str, str]:
    """What records are ordered by when they are stored."""
    return {
        "country_code": f"CASE WHEN l_partkey % 50 = 0 THEN 'WO' ELSE {prefix} END",
        "publication_date": f"CAST(CASE WHEN l_partkey % 97 = 0 THEN {year} * 10000 + 1340 ELSE {base} + {day} END AS INT)",
        "publication_number": f"{prefix} || CAST(l_orderkey AS STRING) || 'A' || CAST(l_linenumber AS STRING)",
    }


# The values a publication record is made of, one row per order line.
def _publication_parts(also: str = "") -> str:
    numbers = ", ".join(
        f"{choose(f'(l_suppkey + {j} * l_partkey) % 6', PRIORITY_COUNTRIES)} || CAST(l_orderkey * 10 + {j} AS STRING) AS number{j}, "
        f"CASE WHEN l_partkey % 13 <> {j} THEN CAST({{base}} + 1 - 10000 * (1 + (l_partkey + {j}) % 3) AS INT) END AS day{j}"
        for j in (1, 2, 3)
    )
    codes = ", ".join(
        f"{choose(e, CODES)} AS code{i}"
        for i, e in enumerate(("l_partkey % 12", "l_suppkey % 12", "(l_partkey + l_suppkey) % 12"), start=1)
    )
    return f"""
SELECT {also}l_orderkey, l_partkey, l_suppkey, l_linenumber, {_PREFIX} AS prefix,
       {_BASE} AS base, day(l_shipdate) AS day, {year('l_shipdate')} AS year,
       'Method ' || CAST(l_partkey AS STRING) AS method, 'Verfahren ' || CAST(l_partkey AS STRING) AS german,
       {numbers.replace("{base}", _BASE)}, {codes},
       {choose('l_suppkey % 6', PRIORITY_COUNTRIES)} AS party1, {choose('l_partkey % 6', PRIORITY_COUNTRIES)} AS party2,
       CASE WHEN l_partkey % 19 <> 0 THEN {choose('(l_suppkey + l_partkey) % 6', PRIORITY_COUNTRIES)} END AS inventor
FROM <<lineitem>>"""


# What a record is made of besides its document's text: a fraction of its bytes. A day compresses better
# than a time.
PUBLICATION_LINES = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_shipdate AS DATE) AS l_shipdate FROM <<lineitem>>"""


def publications(d: Dialect, joined: bool = False) -> str:
    """Nested records. Texts come from the document with the order's key, one element per line;
    ``joined`` parts carry it already."""
    offset = "i" if d.spark else "(i - 1)"
    titles = d.array(
        d.struct(text="german", language="'de'"),
        d.struct(text="method", language="CASE WHEN l_suppkey % 7 = 0 THEN 'fr' ELSE 'en' END"),
        d.struct(text="method || ' again'", language="'en'"),
    )
    abstracts = d.indexed_map(
        d.lines("text"), d.struct(text="nullif(t, '')", language=choose(f"({offset} + doc_id) % 4", LANGUAGES))
    )
    abstract, source = f"{abstracts} AS abstract_localized", ""
    if not joined:
        source = f" LEFT JOIN (SELECT doc_id, {abstract} FROM <<documents>>) d\n  ON l_orderkey = doc_id"
        abstract = "abstract_localized"
    priorities = d.array(*[
        d.struct(
            publication_number=f"number{j}", application_number=f"CASE WHEN l_partkey % 11 <> 0 THEN number{j} END",
            filing_date=f"day{j}",
        )
        for j in (1, 2, 3)
    ])
    codes = d.array(*[d.struct(code=f"code{j}") for j in (1, 2, 3)])
    parties = d.array(d.struct(country_code="party1"), d.struct(country_code="party2"))
    order = record_order("prefix", "base", "day", "year")
    return f"""
SELECT {order["publication_number"]} AS publication_number,
       'EP' || CAST(l_orderkey * 10 + l_linenumber AS STRING) AS application_number,
       {order["country_code"]} AS country_code,
       CAST(base + 1 - 10000 AS INT) AS filing_date,
       {order["publication_date"]} AS publication_date,
       {d.head(titles, 'CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 1 + l_linenumber % 3 END')} AS title_localized,
       {abstract},
       CASE WHEN l_linenumber <> 7 THEN {d.head(priorities, 'l_linenumber % 4')} END AS priority_claim,
       {d.head(codes, '1 + l_linenumber % 3')} AS cpc,
       {d.head(parties, 'l_linenumber % 3')} AS assignee_harmonized,
       {d.array(d.struct(country_code='inventor'))} AS inventor_harmonized
FROM <<publication_parts>>{source}"""


def view_sql(d: Dialect) -> dict[str, str]:
    """All views in an order in which each uses earlier ones only."""
    return {
        "universe": UNIVERSE, "texts": TEXTS, "bulk_texts": BULK_TEXTS, "granted_titles": GRANTED_TITLES,
        "granted_abstracts": GRANTED_ABSTRACTS, "pregrant_abstracts": PREGRANT_ABSTRACTS,
        "claims": CLAIMS, "raw_labels": _RAW_LABELS, "classification": CLASSIFICATION,
        "rater_pair": RATER_PAIR, "answers": ANSWERS, "country": COUNTRY,
        "model_input": MODEL_INPUT, "event_docs": EVENT_DOCS, "publication_parts": _publication_parts(), "publication_rows": publications(d),
    }


MARK = re.compile(r"<<(\w+)>>")


# Folders of the tables landed by a session, by application, input and name.
_LANDED: dict[tuple[str, str, str], str] = {}


class Tables:
    """Base tables and views as lazy DataFrames.

    The nested publication records are a stored table in real use, so they are landed as Parquet
    once per session, below the cluster's shared folder, and read from there.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.sql = view_sql(Dialect("spark"))
        self.known: dict[str, DataFrame] = {}

    def publications(self) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, "publications")
        if key not in _LANDED:
            path = scratch_dir(self.spark, "publications")
            order = record_order(_PREFIX, _BASE, "day(l_shipdate)", year("l_shipdate"))
            with small_methods(self.spark):
                land_publications(self.publication_lines(), path, build=self.publication_records, order=order)
            _LANDED[key] = path
        return read_publications(self.spark, _LANDED[key])

    def publication_lines(self) -> DataFrame:
        """``PUBLICATION_LINES`` with the texts of documents with the order's key.

        Texts, the bulk of it, are shuffled twice and sorted, so they are packed first. Lines of orders
        without a document take no part in the join.
        """
        lines, key = self._run(PUBLICATION_LINES), F.col("doc_id").alias("l_orderkey")
        some, none = split_by_keys(lines, self.documents.select(key), "l_orderkey")
        texts = self.documents.select(key, packed(F.col("text")).alias("text"))
        return some.join(texts, "l_orderkey", "left").unionByName(none.withColumn("text", F.lit(None).cast("binary")))

    def publication_records(self, lines: DataFrame) -> DataFrame:
        """The rows of ``publication_rows``, from ``publication_lines``."""
        lines = lines.withColumn("text", unpacked(F.col("text")))
        parts = self._run(_publication_parts("l_orderkey AS doc_id, text, "), lineitem=lines)
        return self._run(publications(Dialect("spark"), joined=True), publication_parts=parts)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BASE_TABLES and name not in self.__dict__.get("sql", {}):
            raise AttributeError(name)
        if name not in self.known:
            self.known[name] = self._build(name)
        return self.known[name]

    def _build(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._run(self.sql[name])

    def _run(self, text: str, **given: DataFrame) -> DataFrame:
        parents = {m: given[m] if m in given else getattr(self, m) for m in MARK.findall(text)}
        text = text.replace("{", "{{").replace("}", "}}")
        return self.spark.sql(MARK.sub(r"{\1}", text), **parents)


def with_views(query: str) -> str:
    """The checking engine's form: every view the query needs as a common table expression."""
    sql = view_sql(Dialect("duckdb"))
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in MARK.findall(text):
            if name in sql and name not in needed:
                needed.add(name)
                visit(sql[name])

    visit(query)
    ctes = [f"v_{name} AS ({sql[name]})" for name in sql if name in needed]
    text = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + query.strip()
    if ctes and (own := re.match(r"\s*(WITH(?: RECURSIVE)?)\s", query)):
        text = f"{own[1]} " + ",\n".join(ctes) + ",\n" + query[own.end() :].strip()
    return MARK.sub(lambda m: f"v_{m[1]}" if m[1] in sql else m[1], text)
