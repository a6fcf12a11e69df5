"""Text cleaning, truncation and prompt rendering."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom.schemas import ABSTRACT_CHARS, CLAIM_CHARS, DISPLAY_CHARS, SHORT_ABSTRACT_CHARS

# SQL trim() removes spaces only; answers and bulk files also carry tabs, newlines and the like.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Chat markers of the labelling model.
CHAT_SYSTEM, CHAT_USER = "<|im_start|>system\n", "<|im_start|>user\n"
CHAT_END, CHAT_ASSISTANT = "<|im_end|>\n", "<|im_start|>assistant\n"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def clean_text(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def longer_than(c: Column, n: int) -> Column:
    return F.length(clean_text(c)) > n


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def ellipsize(c: Column, n: int = DISPLAY_CHARS) -> Column:
    return F.when(F.length(c) > n, F.concat(truncate(c, n), F.lit("..."))).otherwise(c)


def label_instructions(vocabulary: Mapping[str, Sequence[str]], flags: Sequence[str] = ("is_genuine_ai", "is_llm_related")) -> str:
    """A plain system prompt listing the allowed values; callers may pass their own text."""
    lines = [f"{name}: true or false" for name in flags]
    lines += [f"{name}: one of {', '.join(values)}" for name, values in vocabulary.items()]
    return "Label the document. Answer with one JSON object holding these keys.\n" + "\n".join(lines)


def chat(system: str, user: Column) -> Column:
    return F.concat(
        F.lit(CHAT_SYSTEM + system + CHAT_END + CHAT_USER), user, F.lit(CHAT_END + CHAT_ASSISTANT)
    )


def _section(caption: str, text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit(f"{caption}: "), text))


def prompt_full(system: str, title: Column, abstract: Column, claim: Column) -> Column:
    """Title, abstract and first claim; blank sections are left out."""
    body = F.concat_ws(
        "\n\n",
        _section("Title", clean_text(title)),
        _section("Abstract", truncate(clean_text(abstract), ABSTRACT_CHARS)),
        _section("First Independent Claim", truncate(clean_text(claim), CLAIM_CHARS)),
    )
    return chat(system, F.when(body == "", "No text available.").otherwise(body))


def prompt_short(system: str, title: Column, abstract: Column) -> Column:
    """Optional title line, then the abstract line (present even when empty)."""
    title = clean_text(title)
    body = F.concat(
        F.when(title != "", F.concat(F.lit("Title: "), title, F.lit("\n"))).otherwise(""),
        F.lit("Abstract: "),
        truncate(clean_text(abstract), SHORT_ABSTRACT_CHARS),
    )
    return chat(system, body)


def prompt_pilot(title: Column, abstract: Column) -> Column:
    return F.concat(F.lit("Title: "), clean_text(title), F.lit("\n\nAbstract: "), clean_text(abstract))


# Texts handed back by a task at a time, in bytes: packed ones may be a fraction of them.
UNPACKED_BYTES = 16 << 20


def packed(c: Column) -> Column:
    """A text as compressed bytes, to be moved and sorted; shuffles compress prose to 0.65 only.

    The first byte tells how: short texts that would grow stay as they are.
    """

    def run(texts: pa.Array) -> pa.Array:
        pack = lambda t: min(b"1" + zlib.compress(t), b"0" + t, key=len)
        return pa.array([None if t is None else pack(t) for t in texts.to_pylist()], pa.binary())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")(c.cast("binary"))


def unpacked(c: Column) -> Column:
    """The text that was ``packed``."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts, size = [], 0
            for p in batch.to_pylist():
                texts.append(None if p is None else zlib.decompress(p[1:]) if p[:1] == b"1" else p[1:])
                size += len(texts[-1] or b"")
                if size > UNPACKED_BYTES:
                    yield pa.array(texts, pa.binary())
                    texts, size = [], 0
            yield pa.array(texts, pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(c).cast("string")


def prompt_abstract_only(abstract: Column) -> Column:
    return F.concat(F.lit("Abstract: "), truncate(clean_text(abstract), SHORT_ABSTRACT_CHARS))
