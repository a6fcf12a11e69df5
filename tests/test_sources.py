import zipfile

import pytest

from trendloom import schemas as S
from trendloom.sources import archives, delimited, sinks


def test_csv_strings(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(' doc_id ,"title ",note\n 007 ,"He said ""hi"",\nthen left",\n"8", ,x\n', encoding="utf-8")
    df = delimited.read_csv_strings(spark, str(path), ids=["doc_id"])
    assert df.columns == ["doc_id", "title", "note"]
    assert [tuple(r) for r in df.collect()] == [("007", 'He said "hi",\nthen left', None), ("8", None, "x")]


def test_csv_typed(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id,year,flag\na,2010,True\nb,x,False\nc,,\n")
    df = delimited.read_csv_typed(spark, str(path), S.struct(id=S.STRING, year=S.INT, flag=S.BOOL))
    assert [tuple(r) for r in df.collect()] == [("a", 2010, True), ("b", None, False), ("c", None, None)]


def test_bulk_tsv(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_bytes(b"id\tseq\ttext\n1\t0\tfine\n2\t0\n3\t0\ttoo\tmany\n4\t0\tbad \xff byte\n5\t0\t\"quoted\ttab\"\n6\t0\tx\t\n7\t\t\"\"\n")
    schema = S.struct(id=S.STRING, seq=S.STRING, text=S.STRING)
    df = delimited.read_bulk_tsv(spark, str(path), schema)
    found = {r.id: r.text for r in df.collect()}
    assert found == {"1": "fine", "2": None, "4": "bad � byte", "5": "quoted\ttab", "6": "x", "7": None}
    assert df.count() == df.select("id").count() == 6 and df.where("seq IS NULL").first().id == "7"
    assert df.first().file_path.endswith("a.tsv")


def test_yearly_files(spark, tmp_path):
    (tmp_path / "g_claims_2010.tsv").write_text("patent_id\tclaim_sequence\tclaim_text\n1\t0\t1. A\n")
    (tmp_path / "g_claims_2013.tsv").write_text("patent_id\tclaim_sequence\tclaim_text\n2 \t0\t1. B\n")
    (tmp_path / "g_claims_2009.tsv").write_text("patent_id\tclaim_sequence\tclaim_text\n9\t0\t1. old\n")
    (tmp_path / "pg_claims_2010.tsv").write_text(" document_number \tclaim_text\tclaim_sequence\n20100000001\t1. C\t1\n")
    df = delimited.read_yearly_claims(spark, delimited.claim_files(str(tmp_path)))
    assert sorted(tuple(r) for r in df.collect()) == [
        ("1", "granted", 2010, "0", "1. A"), ("2", "granted", 2013, "0", "1. B"), ("20100000001", "pregrant", 2010, "1", "1. C"),
    ]


def test_yearly_files_with_columns_in_other_orders(spark, tmp_path):
    (tmp_path / "g_claims_2011.tsv").write_text("patent_id\tclaim_sequence\tclaim_text\n7000001\t0\t1. A\n")
    (tmp_path / "g_claims_2012.tsv").write_text("claim_sequence\tpatent_id\tclaim_text\n0\t7000002\t1. B\n")
    df = delimited.read_yearly_claims(spark, {"granted": f"{tmp_path}/g_claims_*.tsv"})
    assert sorted((r.patent_id, r.seq, r.text) for r in df.collect()) == [("7000001", "0", "1. A"), ("7000002", "0", "1. B")]
    (tmp_path / "g_claims_2013.tsv").write_text("patent_id\ttext\nx\ty\n")
    with pytest.raises(ValueError, match="seq"):
        delimited.read_yearly_claims(spark, {"granted": f"{tmp_path}/g_claims_*.tsv"})


def test_archives_by_roles(spark, tmp_path):
    for name, data in (("a", "patent_id\tseq\ttext\n1\t0\tone\n"), ("b", "document_number\tclaim_text\tclaim_sequence\n2\ttwo\t1\n"), ("c", "seq\tbody\n0\tx\n")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("x.tsv", data)
    roles = {"patent_id": [["patent_id"], ["document_number"]], "seq": [["seq"]], "text": [["text"]]}
    out = str(tmp_path / "out")
    status = {r.archive.split("/")[-1]: r.status for r in archives.land_archives(spark, str(tmp_path), out, roles).collect()}
    assert status == {"a.zip": "landed", "b.zip": "landed", "c.zip": "failed"}
    landed = spark.read.parquet(out).where("error IS NULL")
    assert sorted((r.patent_id, r.seq, r.text) for r in landed.collect()) == [("1", "0", "one"), ("2", "1", "two")]


def test_resolve_columns():
    found = delimited.resolve_columns(["Lens ID", "Publication Title", "Abstract"], delimited.TEXT_ROLES)
    assert found == {"lens_id": "Lens ID", "title": "Publication Title", "abstract": "Abstract"}
    claims = delimited.resolve_columns(["pg_document_number", "claim_sequence", "claim_text"], delimited.CLAIM_ROLES)
    assert claims == {"patent_id": "pg_document_number", "seq": "claim_sequence", "text": "claim_text"}
    with pytest.raises(ValueError, match=r"\['title', 'abstract'\].*Lens ID"):
        delimited.resolve_columns(["Lens ID"], delimited.TEXT_ROLES)


def test_archives(spark, tmp_path):
    def pack(name, member, data):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("readme.txt", "x")
            if member:
                z.writestr(member, data)
                z.writestr("second.tsv", "id\ttext\n99\tnot read\n")

    pack("a.zip", "a.tsv", b" id \ttext\n1\tone\n2\t\xff\n3\ttoo\tmany\n4\n")
    pack("b.zip", "b.tsv", b"text\tother\nno id here\tx\n")
    pack("c.zip", None, b"")
    (tmp_path / "d.zip").write_bytes(b"this is no archive")
    out = str(tmp_path / "out")
    status = {r.archive.split("/")[-1]: r for r in archives.land_archives(spark, str(tmp_path), out, ["id", "text"]).collect()}
    assert {n: (r.rows, r.status) for n, r in status.items()} == {
        "a.zip": (3, "landed"), "b.zip": (0, "failed"), "c.zip": (0, "failed"), "d.zip": (0, "failed"),
    }
    assert status["c.zip"].error == "no .tsv member"
    assert status["b.zip"].error == "no column for ['id']; found ['text', 'other']"
    landed = spark.read.parquet(out).where("error IS NULL")
    assert {(r.id, r.text) for r in landed.collect()} == {("1", "one"), ("2", "�"), ("4", None)}


def test_sinks(spark, tmp_path, rows):
    both = sinks.union_variant_rows(rows("id string, a int", [("1", 1)]), rows("id string, b int", [("2", 2)]))
    assert sorted(tuple(r) for r in both.collect()) == [("1", 1, None), ("2", None, 2)]
    path = str(tmp_path / "csv")
    sinks.write_projected(both, ["b", "id", "absent"], path, "csv")
    back = delimited.read_csv_strings(spark, path)
    assert back.columns == ["b", "id"] and back.count() == 2


def test_quoted_line_breaks_in_bulk_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('patent_id\tseq\ttext\n1\t0\t"first\nsecond ""line"""\n2\t0\tplain\n')
    schema = S.struct(patent_id=S.STRING, seq=S.STRING, text=S.STRING)
    found = delimited.read_bulk_tsv(spark, str(tmp_path), schema, multi_line=True).drop("file_path").collect()
    assert sorted(tuple(r) for r in found) == [("1", "0", 'first\nsecond "line"'), ("2", "0", "plain")]
