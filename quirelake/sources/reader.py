"""Parsing as a DataFrame step: one Arrow map, no shuffle."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import NODE_COLUMNS, Node, flatten, node, node_schema
from ..storage import stored
from .html import parse_html
from .latex import parse_latex
from .markdown import parse_markdown
from .plain import parse_csv, parse_json, parse_text


def parse_image(source: str) -> Node:
    """A document with one image; its meaning comes from image passes."""
    from ..schema import paragraph

    return node("Document", children=[paragraph(node("Image", src=source))] if source else [])


def parse_transcription(source: str) -> Node:
    """A model's answer: an enclosing fence goes, HTML tables are read as HTML, the rest as Markdown."""
    import re

    source = re.sub(r"\A\s*```[\w-]*\n(.*?)\n?```\s*\Z", r"\1", source, flags=re.S)
    out: list[Node] = []
    for part in re.split(r"(<table\b.*?</table>)", source, flags=re.S | re.I):
        made = parse_html(part) if part[:6].lower() == "<table" else parse_markdown(part)
        for n in made["children"]:
            if n["type"] == "Table" and not n["headers"] and len(n["rows"]) > 1:
                n["headers"] = n["rows"].pop(0)["cells"]
            out.append(n)
    return node("Document", children=out)


#: Text formats and their parsers; a new source is a new entry.
PARSERS: dict[str, Callable[..., Node]] = {
    "html": parse_html,
    "markdown": parse_markdown,
    "text": parse_text,
    "latex": parse_latex,
    "csv": parse_csv,
    "json": parse_json,
    "image": parse_image,
    "transcription": parse_transcription,
}


#: Python frames of a parser at most: some ten thousand levels of nesting.
MOST_FRAMES = 60_000


def parse(fmt: str, source: str, *, extract: bool = False, url: str | None = None) -> Node:
    """The tree of one text."""
    if fmt not in PARSERS:
        raise ValueError(f"format {fmt!r} is none of {', '.join(PARSERS)}")
    # Parsers call themselves for each level of nesting, in Python frames that lie on the heap.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), MOST_FRAMES))
    return parse_html(source, extract=extract, url=url) if fmt == "html" else PARSERS[fmt](source)


def warnings_of(source: str) -> list[tuple[str, str]]:
    """Codes and messages about a text that can be read, but perhaps not as it was meant."""
    out = []
    if n := source.count("\ufffd"):
        out.append(("replaced_characters", f"{n} characters were not readable in their encoding"))
    if n := sum(source.count(c) for c in map(chr, (*range(9), 11, *range(14, 32)))):
        out.append(("control_characters", f"{n} control characters"))
    return out


#: Texts that a worker holds as Python values at a time; Spark's batches have up to ten thousand rows.
TEXTS_AT_ONCE = 256


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts, so that a worker's memory does not grow with the length of texts times the rows of a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            yield batch.slice(at, TEXTS_AT_ONCE)


def _rows_of(ids: list, texts: list, urls: list, fmt: str, extract: bool, schema: pa.Schema, warn: bool) -> Iterator[pa.RecordBatch]:
    """Rows of the node table; with ``warn`` also rows of warnings, which have no node, and a text that fails is one of them."""
    made: list[tuple] = []
    blank = (None,) * len(NODE_COLUMNS)
    for i, source, url in zip(ids, texts, urls, strict=True):
        if not warn:
            made += [(i, *r) for r in flatten(parse(fmt, source or "", extract=extract, url=url))]
        else:
            try:
                made += [(i, *r, None, None) for r in flatten(parse(fmt, source or "", extract=extract, url=url))]
            except (ValueError, KeyError, TypeError, RecursionError) as e:
                made.append((i, *blank, "failed", str(e)))
            made += [(i, *blank, code, message) for code, message in warnings_of(source or "")]
        if len(made) > 50_000:
            yield _batch(made, schema)
            made = []
    if made:
        yield _batch(made, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _parsed(df: DataFrame, fmt: str, id_col: str, text_col: str, url_col: str | None, extract: bool, warn: bool) -> DataFrame:
    if fmt not in PARSERS:
        raise ValueError(f"format {fmt!r} is none of {', '.join(PARSERS)}")
    schema: StructType = node_schema(id_col)
    if warn:
        schema = schema.add("_code", "string").add("_message", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in in_parts(batches):
            ids, texts, urls = (batch.column(k).to_pylist() for k in range(3))
            yield from _rows_of(ids, texts, urls, fmt, extract, arrow, warn)

    url: Column = F.col(url_col) if url_col else F.lit(None)
    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), url.cast("string").alias("_url")).mapInArrow(run, schema)


def parse_df(df: DataFrame, fmt: str, *, id_col: str = "doc_id", text_col: str = "text", url_col: str | None = None, extract: bool = False) -> DataFrame:
    """The node table of a column of texts; a null text is an empty document.

    Only the columns named are read.  Rows of the result are not ordered;
    ``(id, node_id)`` orders them.  A text that is not in its format (JSON alone can be) fails the job; see ``parse_and_warn``.
    """
    return _parsed(df, fmt, id_col, text_col, url_col, extract, False)


def parse_and_warn(df: DataFrame, fmt: str, *, id_col: str = "doc_id", text_col: str = "text", url_col: str | None = None, extract: bool = False) -> tuple[DataFrame, DataFrame]:
    """The node table, and id, code and message of what was odd about texts; both from one pass, which is written to the shared folder.

    A text that fails has no nodes and the code ``failed``.
    """
    both = stored(_parsed(df, fmt, id_col, text_col, url_col, extract, True))
    warnings = both.where("_code is not null").select(id_col, F.col("_code").alias("code"), F.col("_message").alias("message"))
    return both.where("_code is null").drop("_code", "_message"), warnings


__all__ = ["NODE_COLUMNS", "PARSERS", "parse", "parse_and_warn", "parse_df"]
