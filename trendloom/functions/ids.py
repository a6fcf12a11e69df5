"""Document id shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom.functions.text import strip


def id_kind(doc_id: Column) -> Column:
    """granted / pregrant / reissue by shape, else unknown."""
    doc_id = strip(doc_id)
    return (
        F.when(doc_id.rlike(r"^[0-9]{6,8}$"), "granted")
        .when(doc_id.rlike(r"^20[0-9]{9}$"), "pregrant")
        .when(doc_id.rlike(r"^RE[0-9]+$"), "reissue")
        .otherwise("unknown")
    )


def join_key(doc_id: Column) -> Column:
    """Id under which bulk files list the document: reissues appear without their prefix."""
    return F.regexp_replace(strip(doc_id), "^RE", "")


def source_tag(doc_id: Column) -> Column:
    return F.when(id_kind(doc_id).isin("granted", "reissue"), "granted").otherwise("pregrant")


def claim_file_kind(doc_id: Column) -> Column:
    """Which claim files can hold the document; NULL for unknown shapes."""
    kind = id_kind(doc_id)
    return F.when(kind.isin("granted", "reissue"), "granted").when(kind == "pregrant", "pregrant")


def document_key(doc_id: Column) -> Column:
    """Join key of a universe id. Unknown shapes get one that no bulk file uses, and each its own,
    so they neither match nor pile up in one task as NULLs would."""
    return F.when(id_kind(doc_id) == "unknown", F.concat(F.lit("?"), doc_id)).otherwise(join_key(doc_id))


def key_file_kind(key: Column) -> Column:
    """Claim files in which a bulk key is looked for: pre-grant numbers have their own shape."""
    return F.when(key.rlike(r"^20[0-9]{9}$"), "pregrant").otherwise("granted")
