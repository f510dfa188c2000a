"""What the operators share: byte-level words, per-document Arrow maps, table reading.

Texts travel as UTF-8 bytes.  Both word classes of the contracts are unions of
single ASCII bytes and all non-ASCII characters, so ``bytes.translate`` and
``bytes.split`` find the words exactly, without a regular expression.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_UPPER, _LOWER = UPPER.encode(), LOWER.encode()
_LOWERED = bytes.maketrans(_UPPER, _LOWER)
#: A-Z to a-z, and each ASCII byte that is neither a digit nor a letter to a space.
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: bytes.split() splits at exactly these six bytes.
ASCII_SPACE = b" \t\n\r\x0b\x0c"

#: The alphanumeric separators of the contracts, for SQL engines.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: bytes) -> bytes:
    """A-Z to a-z, nothing else."""
    return text.translate(_LOWERED)


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.translate(_ALNUM).split()


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, case kept."""
    return text.split()


def lower_sql(column: Column) -> Column:
    """A-Z to a-z in the JVM."""
    return F.translate(column, UPPER, LOWER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data directory, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session without the setting (tests) gets one of its own, below the
    warehouse directory.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse")
        folder = f"{warehouse.rstrip('/')}/_checkpoints"
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared folder as a table and read again.

    The table cuts the lineage: executors may be lost, and the plan of what
    follows starts anew (a checkpoint would carry the constraints of all plans
    before it, which grow without end in a loop).  It goes when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/quirelake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; a longer text is a slice of its own."""
    lengths = batch.column(column).cast(pa.binary())
    begin = size = 0
    for i, x in enumerate(pa.compute.binary_length(lengths).to_pylist()):
        x = x or 0
        if i > begin and size + x > most:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += x
    if begin < batch.num_rows:
        yield batch.slice(begin)


Digest = Callable[[list[bytes]], dict[str, Iterable]]


def per_document(
    docs: DataFrame, schema: str, prepare: Callable[[], Digest], *, most: int = 8_000_000
) -> DataFrame:
    """doc_id and the columns of ``schema``, one row per row of ``docs``.

    ``prepare`` runs once per task and returns a function from the texts of a
    slice (bytes, null as empty) to the new columns.  Only doc_id and text are
    read, so other columns, whatever their names, neither travel nor clash.
    """
    kinds = T._parse_datatype_string(f"doc_id long, {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        digest = prepare()
        for batch in batches:
            for piece in pieces(batch, "text", most):
                made = digest(binary(piece.column("text")))
                arrays = [piece.column("doc_id").cast(pa.int64())]
                arrays += [pa.array(made[f.name], f.type) for f in list(arrow)[1:]]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kinds)


def rewritten(
    docs: DataFrame, prepare: Callable[[], Callable[[list[bytes]], tuple[list[bool], dict[int, str]]]], *, most: int = 8_000_000
) -> DataFrame:
    """The columns of ``docs``, with rows dropped and texts replaced.

    The function of ``prepare`` gets the texts of a slice and returns which
    rows stay, and new texts by index.  ``n_chars``, where it exists as an
    integer, follows a new text; every other column passes through as it is.
    """
    schema = docs.schema
    names = schema.names
    text_at = names.index("text")
    counts_at = [i for i, f in enumerate(schema) if f.name == "n_chars" and isinstance(f.dataType, (T.LongType, T.IntegerType))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = prepare()
        for batch in batches:
            for piece in pieces(batch, names[text_at], most):
                kept, new = decide(binary(piece.column(text_at)))
                if new:
                    arrays = list(piece.columns)
                    texts = arrays[text_at].to_pylist()
                    for i, t in new.items():
                        texts[i] = t
                    arrays[text_at] = pa.array(texts, arrays[text_at].type)
                    for c in counts_at:
                        n = arrays[c].to_pylist()
                        for i, t in new.items():
                            n[i] = len(t)
                        arrays[c] = pa.array(n, arrays[c].type)
                    piece = pa.RecordBatch.from_arrays(arrays, schema=piece.schema)
                yield piece if all(kept) else piece.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, schema)


def held_out(modulus: int) -> Column:
    """crc32 of doc_id as text is divisible by ``modulus``; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0, F.lit(False))


def environment_path(variable: str, default: str) -> str:
    """A path parameter that the environment may override."""
    return os.environ.get(variable, default)
