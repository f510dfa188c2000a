"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Every window of 13 consecutive words of a benchmark item (or the whole item,
where it is shorter) goes into a hash set.  Documents are scanned once: words
outside the benchmark's vocabulary cannot lie in a window, so only runs of
known words are hashed; a hash hit counts after its words are compared.  The
set is sent out in blocks of at most ``MOST_WINDOWS`` windows, one at a time.
A benchmark of one block, the usual case, needs no shuffle; a larger one scans
the documents once a block, writes the places found to a table, and joins the
places of all blocks by row (doc_id and digest of the text, nulls equal), so
that the result is the same however the benchmark is cut.

Defined results: null and empty texts have no words, no hits and stay;
items without words are ignored; repeated rows of documents give repeated
results; repeated items count by their distinct item_id; a null item_id
marks words as hit but is not listed; an empty benchmark hits nothing; other
columns, whatever their names, pass through or are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, alnum_words, binary, per_document, rewritten, stored

WINDOW = 13
#: A document goes when this part of its words, or more, is hit: one in twenty.
ONE_IN = 20
#: Windows broadcast at once: about 200 MB on an executor.
MOST_WINDOWS = 400_000

NON_WORD_OF_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WindowSet:
    """The windows of some items, with the items that each belongs to."""

    def __init__(self, items: Iterable[tuple[int | None, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = defaultdict(set)
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            width = min(window, len(ids))
            for i in range(len(ids) - width + 1) if width else ():
                owners[tuple(ids[i : i + width])].add(item)
        self.owners = dict(owners)
        rng = np.random.default_rng(13)
        self.codes = rng.integers(1, 2**63, len(self.vocabulary) + 1, dtype=np.uint64)
        by_width: dict[int, set[int]] = defaultdict(set)
        for w in self.owners:
            by_width[len(w)].add(int(self._hash(np.array([w]))[0]))
        self.hashes = {n: np.array(sorted(h), np.uint64) for n, h in sorted(by_width.items())}

    def _hash(self, windows: np.ndarray) -> np.ndarray:
        """Polynomial hashes of rows of word ids."""
        h = np.zeros(len(windows), np.uint64)
        for column in windows.T:
            h = h * _MULTIPLIER + self.codes[column]
        return h

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Word ids, -1 outside the vocabulary."""
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words], np.int64)

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, set]]:
        """(first word, width, items) of each place where a window stands."""
        out: list[tuple[int, int, set]] = []
        if not len(self.hashes) or not len(ids):
            return out
        unknown = np.flatnonzero(np.concatenate([[-1], ids, [-1]]) < 0)
        ends = unknown[1:] - 1
        begins = unknown[:-1]
        for width, hashes in self.hashes.items():
            long = ends - begins >= width
            if not long.any():
                continue
            starts = np.concatenate([np.arange(b, e - width + 1) for b, e in zip(begins[long], ends[long], strict=True)])
            h = np.zeros(len(starts), np.uint64)
            for k in range(width):
                h = h * _MULTIPLIER + self.codes[ids[starts + k]]
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for s in starts[hashes[at] == h].tolist():
                if (who := self.owners.get(tuple(ids[s : s + width].tolist()))) is not None:
                    out.append((s, width, who))
        return out


def benchmark_blocks(benchmark: DataFrame, most: int = MOST_WINDOWS) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items as words, in blocks of at most ``most`` windows; an item larger than that is cut, with overlap."""
    block: list[tuple[int | None, list[bytes]]] = []
    size = 0
    for row in benchmark.select("item_id", "text").toLocalIterator(prefetchPartitions=False):
        words = alnum_words((row["text"] or "").encode())
        for begin in range(0, max(1, len(words) - WINDOW + 1), most):
            part = words[begin : begin + most + WINDOW - 1]
            if block and size + len(part) > most:
                yield block
                block, size = [], 0
            if part:
                block.append((row["item_id"], part))
                size += len(part)
    if block:
        yield block


def _item_digest(items: Iterable[int]) -> str:
    return hashlib.sha256(",".join(sorted({str(i) for i in items if i is not None})).encode()).hexdigest()


def _covered(spans: Iterable[tuple[int, int]], n: int) -> int:
    """Words inside any of the spans."""
    mark = np.zeros(n + 1, np.int64)
    for s, w in spans:
        mark[s] += 1
        mark[s + w] -= 1
    return int((np.cumsum(mark) > 0).sum())


def contamination(docs: DataFrame, benchmark: DataFrame, *, most: int = MOST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``."""
    spark = docs.sparkSession
    blocks = benchmark_blocks(benchmark, most)
    first, second = next(blocks, []), next(blocks, None)
    schema = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    if second is None:
        sent = spark.sparkContext.broadcast(WindowSet(first))

        def prepare():
            windows = sent.value

            def digest(texts: list[bytes]) -> dict[str, list]:
                out: dict[str, list] = {"n_words": [], "n_hit": [], "n_items": [], "items_sha256": [], "contaminated": []}
                for t in texts:
                    words = alnum_words(t)
                    found = windows.hits(windows.ids(words))
                    items = {i for _, _, who in found for i in who if i is not None}
                    n, hit = len(words), _covered([f[:2] for f in found], len(words)) if found else 0
                    for name, value in zip(out, (n, hit, len(items), _item_digest(items), hit > 0 and ONE_IN * hit >= n), strict=True):
                        out[name].append(value)
                return out

            return digest

        return per_document(docs, schema, prepare)
    return _by_blocks(docs, itertools.chain([first, second], blocks)).drop("key")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and key: what tells one row's content from another's."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("key"))


def _hits(keyed: DataFrame, blocks: Iterable[list]) -> DataFrame:
    """key, start, width, items of every place of every block; one block is in memory at a time."""
    spark = keyed.sparkSession
    hits = None
    texts = keyed.select("key", "text")
    for block in blocks:
        sent = spark.sparkContext.broadcast(WindowSet(block))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            windows = sent.value
            for batch in batches:
                rows = [
                    (k, s, w, sorted(x for x in who if x is not None))
                    for k, t in zip(batch.column("key").to_pylist(), binary(batch.column("text")), strict=True)
                    for s, w, who in windows.hits(windows.ids(alnum_words(t)))
                ]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "start", "width", "items"])

        found = stored(texts.mapInArrow(scan, "key string, start long, width long, items array<long>"))
        sent.unpersist()
        hits = found if hits is None else hits.unionByName(found)
    return hits


def _spans(hits: DataFrame) -> DataFrame:
    """key and the distinct (start, width) of a text, in order; at most a few for each of its words."""
    return hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "width"))).alias("spans"))


def _by_blocks(docs: DataFrame, blocks: Iterable[list]) -> DataFrame:
    """The same for a benchmark of several blocks, with the key of each row's text."""
    keyed = _keyed(docs)
    hits = _hits(keyed, blocks)
    # Overlapping windows, reduced to the word places that each text's hits cover.
    places = hits.select("key", F.explode(F.sequence("start", F.col("start") + F.col("width") - 1)).alias("at")).distinct()
    n_hit = places.groupBy("key").agg(F.count("*").alias("n_hit"))
    listed = hits.select("key", F.explode_outer(F.col("items").cast("array<string>")).alias("item")).groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = stored(n_hit.join(listed, "key"))
    words = F.size(F.filter(F.split(F.col("text"), NON_WORD_OF_ANY_CASE), lambda w: w != ""))
    out = keyed.select("doc_id", "key", words.cast("long").alias("n_words")).join(found, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (ONE_IN * n_hit >= F.col("n_words"))).alias("contaminated"),
        "key",
    )


def oracle() -> str:
    """The same in DuckDB: every window of every document joined with the items' windows."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH b AS (SELECT item_id, words, least({WINDOW}, len(words)) AS width FROM (SELECT item_id, {words} AS words FROM benchmark)),
owners AS (SELECT DISTINCT item_id, width, array_to_string(words[i + 1 : i + width], ' ') AS g FROM (SELECT *, unnest(range(0, len(words) - width + 1)) AS i FROM b WHERE width > 0)),
d AS (SELECT doc_id, {words} AS words FROM documents),
places AS (SELECT doc_id, width, i, array_to_string(words[i + 1 : i + width], ' ') AS g
  FROM (SELECT doc_id, words, width, unnest(range(0, len(words) - width + 1)) AS i FROM d, (SELECT DISTINCT width FROM owners))),
hits AS (SELECT doc_id, i, width, item_id FROM places JOIN owners USING (width, g)),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS place FROM hits) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit > 0 AND {ONE_IN} * n_hit >= len(words), false) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", most: int = MOST_WINDOWS) -> DataFrame:
    """The columns of ``docs`` without contaminated documents, or without the hit spans.

    ``remove="documents"`` drops rows of which a twentieth or more is hit;
    ``remove="spans"`` keeps all rows and cuts the words inside windows out of
    the texts, once for all windows.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: documents or spans, not {remove!r}")
    blocks = benchmark_blocks(benchmark, most)
    first, second = next(blocks, []), next(blocks, None)
    if second is not None:
        return _decontaminated_by_blocks(docs, itertools.chain([first, second], blocks), remove)
    sent = docs.sparkSession.sparkContext.broadcast(WindowSet(first))

    def prepare():
        windows = sent.value

        def decide(texts: list[bytes]) -> tuple[list[bool], dict[int, str]]:
            kept, new = [True] * len(texts), {}
            for i, t in enumerate(texts):
                words = alnum_words(t)
                if found := windows.hits(windows.ids(words)):
                    if remove == "documents":
                        kept[i] = ONE_IN * _covered([f[:2] for f in found], len(words)) < len(words)
                    else:
                        new[i] = _without(t, [f[:2] for f in found])
            return kept, new

        return decide

    return rewritten(docs, prepare)


def _decontaminated_by_blocks(docs: DataFrame, blocks: Iterable[list], remove: str) -> DataFrame:
    """The same for several blocks: texts with hits, few of all, meet their rows by key."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    if remove == "documents":
        bad = _by_blocks(docs, blocks).where("contaminated").select(F.col("key").alias("bad")).distinct()
        return docs.join(bad, F.sha2(text, 256) == bad["bad"], "left_anti")
    keyed = _keyed(docs)
    spans = _spans(_hits(keyed, blocks))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [_without(t, [(x["start"], x["width"]) for x in s]) for t, s in zip(binary(batch.column("text")), batch.column("spans").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("key"), pa.array(new, pa.string())], names=["key_of", "text_of"])

    cuts = stored(keyed.select("key", "text").dropDuplicates(["key"]).join(spans, "key").mapInArrow(cut, "key_of string, text_of string"))
    met = docs.join(cuts, F.sha2(text, 256) == cuts["key_of"], "left")
    changed = cuts["text_of"].isNotNull()
    value = {"text": F.when(changed, cuts["text_of"]).otherwise(docs["text"])}
    if isinstance(dict((f.name, f.dataType) for f in docs.schema).get("n_chars"), (T.LongType, T.IntegerType)):
        value["n_chars"] = F.when(changed, F.char_length(cuts["text_of"])).otherwise(docs["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return met.select(*(value[c].alias(c) if c in value else docs[c] for c in docs.columns))


def _without(text: bytes, found: list[tuple[int, int]]) -> str:
    """The text without the words of the windows (first word, width) found and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = bytearray(), 0
    for s, w in sorted(found):
        begin, end = places[s][0], places[s + w - 1][1]
        if begin >= at:
            out += text[at:begin]
        at = max(at, end)
    return bytes(out + text[at:]).decode("utf-8", "replace")
