"""Conversion of columns of documents: parse, passes and rendering in one Arrow map, or over a node table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import check_choice
from ..schema import NODE_COLUMNS, assemble
from ..sources.code import fenced
from ..sources.reader import PARSERS, in_parts, parse
from .render import RENDERERS, discard_links, neutralize_links, remove_images


@dataclass(frozen=True)
class Options:
    """How to convert."""

    extract_html: bool = False
    discard_links: bool = False
    image_handling: str = "auto"
    code_parsing: bool = False

    def __post_init__(self):
        check_choice("image_handling", self.image_handling, ("auto", "keep", "discard", "describe", "transcribe"))
        if self.image_handling in ("describe", "transcribe"):
            raise ValueError(f"image_handling {self.image_handling!r} needs a model, and none is configured")


def convert_text(source: str, from_format: str, to_format: str, options: Options | None = None, *, url: str | None = None) -> str:
    """One text in another format.

    Passes in a fixed order: images that the target cannot hold go, links are
    discarded or neutralized; JSON keeps links as they are.
    """
    options = options or Options()
    check_choice("format", from_format, tuple(PARSERS))
    check_choice("format", to_format, tuple(RENDERERS))
    if options.code_parsing and from_format == "markdown":
        source = fenced(source)
    tree = parse(from_format, source, extract=options.extract_html, url=url)
    if options.image_handling == "discard" or options.image_handling == "auto" and to_format in ("csv", "text"):
        remove_images(tree)
    if options.discard_links:
        discard_links(tree)
    if to_format != "json":
        neutralize_links(tree)
    return RENDERERS[to_format](tree)


def convert_df(df: DataFrame, from_format: str, to_format: str, options: Options | None = None, *, id_col: str = "doc_id", text_col: str = "text", url_col: str | None = None) -> DataFrame:
    """id, converted text and error of every row; a document that cannot be converted has an error and no text.

    No shuffle: parsing, passes and rendering of a document happen in one task.
    """
    options = options or Options()
    check_choice("format", from_format, tuple(PARSERS))
    check_choice("format", to_format, tuple(RENDERERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            ids, texts, urls = (batch.column(k).to_pylist() for k in range(3))
            made: list[str | None] = []
            errors: list[str | None] = []
            for source, url in zip(texts, urls, strict=True):
                try:
                    made.append(convert_text(source or "", from_format, to_format, options, url=url))
                    errors.append(None)
                except (ValueError, RecursionError) as e:
                    made.append(None)
                    errors.append(str(e))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(made, pa.string()), pa.array(errors, pa.string())], names=[id_col, "converted", "error"])

    url = F.col(url_col) if url_col else F.lit(None)
    chosen = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), url.cast("string").alias("_url"))
    return chosen.mapInArrow(run, f"`{id_col}` long, converted string, error string")


def render_df(nodes: DataFrame, to_format: str, *, id_col: str = "doc_id") -> DataFrame:
    """id and rendered text of a node table: one group for each document."""
    check_choice("format", to_format, tuple(RENDERERS))

    def run(table: pa.Table) -> pa.Table:
        tree = assemble(table.select(NODE_COLUMNS).to_pylist())
        try:
            made, error = RENDERERS[to_format](tree), None
        except (ValueError, RecursionError) as e:
            made, error = None, str(e)
        return pa.table({id_col: table.column(id_col)[:1], "rendered": pa.array([made], pa.string()), "error": pa.array([error], pa.string())})

    return nodes.groupBy(id_col).applyInArrow(run, f"`{id_col}` long, rendered string, error string")


#: Writers by the extension of a path.
WRITERS = {"parquet": "parquet", "orc": "orc", "csv": "csv", "json": "json", "jsonl": "json", "txt": "text"}


def save(df: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists") -> None:
    """Writes a result in a format, or in the one of the path's extension (Parquet without any).

    Never over what is there unless asked to, and never over a file that the result reads.
    """
    name = path.rstrip("/").rpartition("/")[2]
    extension = name.rpartition(".")[2].lower() if "." in name else "parquet"
    fmt = fmt or WRITERS.get(extension)
    if fmt is None:
        raise ValueError(f"no writer for the extension of {name!r}; known are {', '.join(WRITERS)}")
    plain = lambda x: x.removeprefix("file:").rstrip("/").replace("//", "")
    if any(plain(read) == plain(path) or plain(read).startswith(f"{plain(path)}/") for read in df.inputFiles()):
        raise ValueError(f"{path!r} is read by the result that would replace it")
    writer = df.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
