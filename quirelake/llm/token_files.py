"""Token ids as binary files of shuffled byte or bit planes.

A folder holds files of consecutive documents, in ascending doc_id order, and a
manifest table.  A file is a stream of ids cut into blocks of ``BLOCK`` ids, whatever
documents they belong to; a block is transposed into planes (all lowest bytes
together, and so on, or all lowest bits), and each plane is compressed by zstandard by itself; a plane
of zeros alone takes no room.  All numbers are little-endian::

    record   := plane data of one block
    footer   := zstandard of
                  int64 block count, int64 document count, int64 ids of the file, int64 BLOCK, int64 planes a block, int64 1 for bits
                  chunk index: int64 offset, int64 ids, then int64 length of each plane, for each block
                  documents: int64 doc_id, int64 ids, int8 1 for a null doc_id, each as one column
    file     := (record "\\n")* footer, int64 length of the footer, b"BITPLAN1", "\\n"

The line feed after each record comes from Spark's own text writer, which writes the files: so they
lie wherever Spark can write, under its commit protocol, and a lost or repeated
task leaves no partial file.  ``binaryFile`` reads them back.

Words between ASCII white space never share a token, so a task encodes each
distinct word once, through the tokenizers library itself, and gathers the ids of texts from
a table; a vocabulary whose special tokens or pieces can span white space is
rejected.  Rows are dealt by ranges of (doc_id, hash of the text, place in the input), so that even
copies of one row are dealt out.

Defined results: null and empty texts have the end id alone; rows of one doc_id go by a
hash of their text and repeated rows side by side, each with a place of its own; null doc_ids come first and
stay null; an empty table gives a folder with no documents; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_symbols, tokenizer_source
from .common import pieces, shared_folder

#: Ids of a block.
BLOCK = 1 << 16
#: The id that ends each document.
END = 2
#: Distinct words whose ids a Python worker keeps.
CACHED = 400_000
_MAGIC = b"BITPLAN1"
_LEVEL = 3
_SLICE = 8_000_000
_HEAD = 6
#: Words that the whole pipeline of the library takes at once.
_BATCH = 20_000
#: A letter, and punctuation that is always apart from it.
_BEHIND = r"[A-Za-z][.,;:!?)]+"
#: Words of Latin letters that normalization only lowers.
_LATIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first; planes of zeros are empty."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()) if len(ids) else 0
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() if top >> 8 * k else b"" for k in range(4)]
    out = [b""] * 32
    for k in range((top.bit_length() + 7) // 8):
        column = np.ascontiguousarray(raw[:, k])
        for b in range(8):
            if top >> 8 * k + b:
                out[8 * k + b] = np.packbits(column & np.uint8(1 << b) != 0).tobytes()
    return out


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The ids of a block."""
    if not bits:
        raw = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            if plane:
                raw[:, k] = np.frombuffer(plane, np.uint8)
        return raw.reshape(-1).view("<u4")
    out = np.zeros(n, np.uint32)
    for b, plane in enumerate(planes):
        if plane:
            out |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype(np.uint32) << np.uint32(b)
    return out


class FileWriter:
    """Makes the records of one file from ids and documents."""

    def __init__(self, bits: bool, block: int):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=_LEVEL).compress
        self.bits, self.block = bits, block
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.offset = self.n_ids = 0
        self.index: list[list[int]] = []
        self.documents: list[list[np.ndarray]] = [[], [], []]

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> Iterator[bytes]:
        """Takes whole documents; gives the records of the blocks that are full."""
        for column, part in zip(self.documents, (doc_ids.fill_null(0).to_numpy(), sizes, doc_ids.is_null().to_numpy(zero_copy_only=False)), strict=True):
            column.append(part)
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            stream = np.concatenate(self.waiting)
            full = len(stream) // self.block * self.block
            for begin in range(0, full, self.block):
                yield self._record(stream[begin : begin + self.block])
            self.waiting, self.n_waiting = [stream[full:]], len(stream) - full

    def _record(self, ids: np.ndarray) -> bytes:
        planes = [self.compress(p) if p else b"" for p in to_planes(ids, self.bits)]
        self.index.append([self.offset, len(ids), *map(len, planes)])
        record = b"".join(planes)
        self.offset += len(record) + 1
        return record

    def close(self) -> Iterator[bytes]:
        """The last record and the footer."""
        if self.n_waiting:
            yield self._record(np.concatenate(self.waiting))
        columns = [np.concatenate([np.zeros(0, np.int64), *c]).astype(t) for c, t in zip(self.documents, ("<i8", "<i8", "i1"), strict=True)]
        head = np.array([len(self.index), len(columns[0]), self.n_ids, self.block, 32 if self.bits else 4, self.bits], "<i8")
        footer = self.compress(b"".join([head.tobytes(), np.array(self.index, "<i8").tobytes(), *(c.tobytes() for c in columns)]))
        yield footer + len(footer).to_bytes(8, "little") + _MAGIC


class FileReader:
    """One file: its documents, its chunk index, and ids by place."""

    def __init__(self, content: bytes):
        import zstandard

        if content[-9:] != _MAGIC + b"\n":
            raise ValueError("not a token file, or not a whole one")
        self.content, self.decompress = content, zstandard.ZstdDecompressor().decompress
        size = int.from_bytes(content[-17:-9], "little")
        footer = self.decompress(content[-17 - size : -17])
        blocks, documents, self.n_ids, self.block, planes, bits = np.frombuffer(footer, "<i8", _HEAD).tolist()
        self.bits = bool(bits)
        at = 8 * _HEAD
        self.index = np.frombuffer(footer, "<i8", blocks * (2 + planes), at).reshape(blocks, 2 + planes)
        at += self.index.nbytes
        self.doc_ids = np.frombuffer(footer, "<i8", documents, at)
        self.sizes = np.frombuffer(footer, "<i8", documents, at + 8 * documents)
        self.nulls = np.frombuffer(footer, "i1", documents, at + 16 * documents) != 0

    def ids_of_block(self, number: int) -> np.ndarray:
        """The ids of one block, read by the chunk index alone."""
        offset, n, *lengths = self.index[number].tolist()
        planes = []
        for length in lengths:
            planes.append(self.decompress(self.content[offset : offset + length]) if length else b"")
            offset += length
        return from_planes(planes, n, self.bits)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids by place in the file; only the blocks that hold them are decompressed."""
        if begin >= end:
            return np.zeros(0, np.uint32)
        first, last = begin // self.block, (end - 1) // self.block
        stream = np.concatenate([self.ids_of_block(k) for k in range(first, last + 1)])
        return stream[begin - first * self.block : end - first * self.block]


class WordEncoder:
    """Ids of texts through the tokenizers library, each distinct word once.

    Letters and the punctuation behind them are apart already for the pre-tokenizer; a space between
    them leaves fewer distinct words.  A word of Latin letters alone is one pre-token and goes straight to the library's
    model; all others take its whole pipeline.
    """

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        added = json.loads(source).get("added_tokens", [])
        spaced = lambda t: any(c in t["content"] for c in " \t\n\r\x0b\x0c") or t.get("lstrip") or t.get("rstrip") or t.get("single_word")
        if any(map(spaced, added)):
            raise ValueError("special tokens of this vocabulary can span white space")
        self.specials = [t["content"] for t in added]
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        whole = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        probe = "Some words,  and: more) ÀÉ naïve. aß 12"
        if whole(probe) != [i for w in probe.split() for i in whole(w)]:
            raise ValueError("pieces of this vocabulary can span white space")
        symbols = dict(enumerate(byte_symbols()))
        self.symbols = lambda w: w.encode().decode("latin-1").translate(symbols)
        direct = lambda w: [t.id for t in self.tokenizer.model.tokenize(self.symbols(w.lower()))]
        self.direct = direct if all(direct(w) == whole(w) for w in ("Some", "ÀÉ", "naïve", "zzxqéøå", "aß")) else None
        self.apart = whole("words, more)") == whole("words , more )") and not any(re.search(_BEHIND, t.lower()) for t in self.specials)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _ids(self, words: list[str]) -> Iterator[list[int]]:
        if self.direct is None:
            words, plain = [], words
        else:
            plain = [w for w in words if not _LATIN(w)]
        others = iter(())
        if plain:
            batches = (self.tokenizer.encode_batch_fast(plain[k : k + _BATCH], add_special_tokens=False) for k in range(0, len(plain), _BATCH))
            others = (e.ids for batch in batches for e in batch)
        if self.direct is None:
            yield from others
            return
        tokenize, symbols = self.tokenizer.model.tokenize, self.symbols
        for w in words:
            if not _LATIN(w):
                yield next(others)
            else:
                w = w.lower()
                yield [t.id for t in tokenize(w if w.isascii() else symbols(w))]

    def _codes(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.known]
        if new and self.known and len(self.known) + len(new) > CACHED:
            self.clear()
            new = words
        if new:
            sizes = np.empty(len(new), np.int64)
            ids = array("I")
            for k, found in enumerate(self._ids(new)):
                sizes[k] = len(found)
                ids.extend(found)
            self.flat = np.concatenate([self.flat, np.frombuffer(ids, np.uint32)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _folded(self, texts: pa.Array) -> pa.Array:
        """Texts with fewer distinct words and the same tokens: in lower case where no special token arises, words apart from what follows."""
        if self.direct is not None:
            lower = pc.ascii_lower(texts)
            if not any(pc.any(pc.match_substring(lower, s)).as_py() for s in self.specials):
                texts = lower
        return pc.replace_substring_regex(texts, f"([A-Za-z])({_BEHIND[8:]})", r"\1 \2") if self.apart else texts

    def encode(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has; ``end`` closes each text."""
        split = pc.ascii_split_whitespace(self._folded(texts))
        words = split.flatten().dictionary_encode()
        codes = self._codes(words.dictionary.to_pylist())[words.indices.to_numpy()]
        sizes = np.diff(self.starts)[codes]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[codes] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        places = np.concatenate([[0], ends])[np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]
        counts = np.diff(places, prepend=0)
        return (ids, counts) if end is None else (np.insert(ids, places, np.uint32(end)), counts + 1)


_loaded: dict[int, WordEncoder] = {}


def _loaded_once(source: str) -> WordEncoder:
    """One vocabulary, with its word table, for all tasks of a Python worker."""
    key = hash(source)
    if key not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _loaded.clear()
        _loaded[key] = WordEncoder(source)
    return _loaded[key]


def write_ids(docs: DataFrame, folder: str, path: str, *, end: int | None = END, bits: bool = False, block: int = BLOCK) -> None:
    """Writes the ids of every whole text below ``folder``, in ascending doc_id order, and the manifest."""
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast(tokenizer_source(path))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", "_hash", "_place"]
    rows = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = _loaded_once(source.value), FileWriter(bits, block)
        one = lambda records: pa.record_batch([pa.array(records, pa.binary())], names=["record"])
        some = False
        for batch in batches:
            for piece in pieces(batch, "text", _SLICE):
                some = True
                for record in writer.add(piece.column("doc_id"), *encoder.encode(piece.column("text"), end)):
                    yield one([record])
        if some:
            for record in writer.close():
                yield one([record])

    # A cast to string keeps the bytes as they are, and the text writer writes them so.
    records = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\n").text(f"{folder}/ids")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                reader = FileReader(content.as_py())
                yield pa.record_batch([pa.array([name]), pa.array([len(reader.sizes)], pa.int64()), pa.array([reader.n_ids], pa.int64())], names=["file", "n_documents", "n_ids"])

    each = _files(spark, folder).mapInArrow(totals, "file string, n_documents long, n_ids long")
    # One row a file; their names count up in the order of their documents.
    before = Window.orderBy(F.length("file"), "file").rowsBetween(Window.unboundedPreceding, -1)
    each.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """path (its last part) and content of the files that hold documents."""
    files = spark.read.format("binaryFile").load(f"{folder}/ids").where("length > 0")
    return files.select(F.regexp_extract("path", "part-[0-9]+", 0).alias("path"), "content")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """file, n_documents, n_ids and start (ids before the file) of each file."""
    return spark.read.schema("file string, n_documents long, n_ids long, start long").parquet(f"{folder}/manifest")


def _documents(spark: SparkSession, folder: str, name: str, kind: str, arrow: pa.DataType, of: Callable[[np.ndarray], object]) -> DataFrame:
    """doc_id, start, n_tokens and one column made of the ids of each document by ``of``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                reader = FileReader(content.as_py())
                ends = np.cumsum(reader.sizes)
                first = 0
                while first < len(ends):  # so many documents as have about a million ids
                    begin = int(ends[first] - reader.sizes[first])
                    last = max(first + 1, int(np.searchsorted(ends, begin + (1 << 20), "right")))
                    ids = reader.ids(begin, int(ends[last - 1]))
                    starts = ends[first:last] - reader.sizes[first:last]
                    made = [of(ids[b - begin : e - begin]) for b, e in zip(starts.tolist(), ends[first:last].tolist(), strict=True)]
                    yield pa.record_batch(
                        [
                            pa.array([file] * (last - first)),
                            pa.array(reader.doc_ids[first:last], mask=reader.nulls[first:last]),
                            pa.array(starts),
                            pa.array(reader.sizes[first:last]),
                            pa.array(made, arrow),
                        ],
                        names=["file", "doc_id", "at", "n_tokens", name],
                    )
                    first = last

    rows = _files(spark, folder).mapInArrow(run, f"file string, doc_id long, at long, n_tokens long, {name} {kind}")
    starts = manifest(spark, folder).select("file", "start")
    return rows.join(starts, "file").select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", name)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document of a folder."""
    return _documents(spark, folder, "ids", "array<int>", pa.list_(pa.int32()), lambda ids: ids.view(np.int32))


def id_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) of every document."""
    return _documents(spark, folder, "ids_crc32", "long", pa.int64(), lambda ids: zlib.crc32(np.ascontiguousarray(ids, "<u4")))


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared folder; it goes when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/quirelake-ids-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
