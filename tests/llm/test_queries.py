"""Queries of the package against their SQL."""

import duckdb
import pytest

from parity import compare, connect
from trendloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    rows, _, problem = compare(spark, connect(SF), name, SF)
    assert not problem and rows > 0


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_quality_rules_on_odd_texts_equal_the_sql(spark, documents):
    from trendloom.llm import quality_rules

    once = documents.dropDuplicates(["doc_id"])
    con = duckdb.connect()
    con.register("documents", once.select("doc_id", "text").toArrow())
    found = con.execute(queries.ORACLE["op9_quality_rules"])
    names = [c[0] for c in found.description]
    expected = {r[0]: dict(zip(names, r, strict=True)) for r in found.fetchall()}
    got = quality_rules.judge(once).select("row.doc_id", *[n for n in names if n != "doc_id"])
    assert {r.doc_id: r.asDict() for r in got.collect()} == expected


def test_spans_and_lines_on_odd_texts_equal_the_sql(spark, documents, nothing):
    from trendloom.llm import line_dedup, span_dedup

    once = documents.dropDuplicates(["doc_id"])
    con = duckdb.connect()
    con.register("documents", once.select("doc_id", "text").toArrow())
    found = con.execute(queries.ORACLE["op3_sentence_spans"]).fetchall()
    got = span_dedup.remove_repeated_spans(once).selectExpr("row.doc_id", "n_sentences", "size(removed) n", "sha2(kept_text, 256) s")
    assert sorted(tuple(r) for r in got.collect()) == sorted(found) and any(r[2] for r in found)
    found = con.execute(queries.ORACLE["op11_line_dedup"]).fetchall()
    assert sorted(tuple(r) for r in line_dedup.digests(once).collect()) == sorted(found)
