"""Near-duplicate components by circulant MinHash.

Two permutations make the whole signature: the first scatters the shingle
hashes over a circle of ``CIRCLE`` places, the second, a table of the places
that is circularly shifted by one more for each coordinate, gives that
coordinate's minimum.  All coordinates of a shingle so lie side by side in the
table.  Bands of four coordinates propose candidates and exact Jaccard on the
full sets of word shingles confirms them.

Hot groups stay cheap without losing a link between different texts:

* documents with equal sets are one class, found by an aggregation;
* in a bucket, members are compared with one pivot (a star, not all pairs):
  first with the member that shares the largest buckets, which in a group of
  copies of one text is that text, then with another; links join components;
* members of buckets that still hold several components meet at last by an
  exact prefix filter: two sets of the similarity asked for must share one of
  the rarest fifth of their shingles, so texts that merely share a passage, or
  that are edited copies of one text too far from each other, never meet.
  Only members of unlike components are paired, and only those whose sizes can meet at that
  place: each row allows an interval of partners' sizes, which is joined as blocks of powers of two, so pages of
  one template that are not similar enough are not even compared.

Components are found by label propagation with pointer jumping over
written tables in the shared folder.  With 28 bands of 4 coordinates a
pair of similarity 0.8 shares no band with a probability of 4e-7.

Defined results: a null or empty text, or one without words, has no shingles,
is linked with nothing and kept; a text of fewer words than a shingle is one
shingle; repeated rows get the same result, so all copies of a row that is kept
are kept; rows of one doc_id with several texts are one document; rows with a
null doc_id are linked with nothing, have a null component and are kept; an
empty table gives an empty result; columns other than doc_id and text are not
read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, LOWER, UPPER, binary, lower_ascii, per_document, pieces, stored

BANDS, ROWS = 28, 4
#: Places of the circle.
CIRCLE = 1 << 20
#: Percent of similarity that links.
PERCENT = 80
#: Rounds of stars before components are compared.
STARS = 2
#: Bytes that are hashed at once, and of texts in a slice.
_CHUNK = 1 << 20

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: A-Z to a-z, white space to spaces.
_PLAIN = bytes.maketrans(UPPER.encode() + ASCII_SPACE, LOWER.encode() + b" " * len(ASCII_SPACE))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 64-bit numbers, in place."""
    x ^= x >> np.uint64(30)
    x *= _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@functools.lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and the powers of an odd number and of its inverse."""
    base = int(_GOLDEN)
    return np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64), _powers(base, _CHUNK), _powers(pow(base, -1, 1 << 64), _CHUNK)


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, one after the other, and how many each text has."""
    codes, up, down = _tables()
    data = b" ".join(texts).translate(_PLAIN) + b" "
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    begin = 0
    while begin < len(data):  # each part ends with a space
        end = data.rfind(b" ", begin, begin + _CHUNK) + 1 or data.index(b" ", begin) + 1
        part = np.frombuffer(data, np.uint8, end - begin, begin)
        if len(part) > len(up):
            up, down = _powers(int(_GOLDEN), len(part)), _powers(pow(int(_GOLDEN), -1, 1 << 64), len(part))
        inside = part != 32
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        first, last = edges[::2], edges[1::2]
        sums = np.cumsum(np.where(inside, codes[part] * up[: len(part)], np.uint64(0)), dtype=np.uint64)
        hashes.append(_mixed((sums[last] - sums[first] + codes[part[first]] * up[first]) * down[first]))
        starts.append(first + begin)
        begin = end
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), ends), prepend=0)


@functools.lru_cache(2)
def _circle(coordinates: int) -> np.ndarray:
    """The second permutation, read from each place on."""
    table = np.random.default_rng(11).permutation(CIRCLE).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[: coordinates - 1]]), coordinates)


class CirculantMinHash:
    """Shingle sets and signatures of texts."""

    def __init__(self, width: int, bands: int = BANDS, rows: int = ROWS):
        self.width, self.bands, self.rows = width, bands, rows

    def shingles(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted hashes of the distinct shingles of each text."""
        codes, sizes = word_codes(texts)
        whole = self._windows(codes, self.width)
        out, begin = [], 0
        for n in sizes.tolist():
            if n >= self.width:
                out.append(np.unique(whole[begin : begin + n - self.width + 1]))
            else:
                out.append(self._windows(codes[begin : begin + n], n) if n else np.zeros(0, np.uint64))
            begin += n
        return out

    @staticmethod
    def _windows(codes: np.ndarray, width: int) -> np.ndarray:
        n = max(0, len(codes) - width + 1)
        h = np.full(n, width, np.uint64)
        for k in range(width):
            h = _mixed(h * _GOLDEN + codes[k : k + n])
        return h

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The least number on the circle's table, shifted once more for each coordinate."""
        circle = _circle(self.bands * self.rows)
        places = (_mixed(shingles + _GOLDEN) % np.uint64(CIRCLE)).astype(np.int64)
        low = np.full(circle.shape[1], CIRCLE, np.int32)
        for at in range(0, len(places), 2048):
            np.minimum(low, circle[places[at : at + 2048]].min(0), out=low)
        return low

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """One bucket key for each band."""
        rows = signature.astype(np.uint64).reshape(self.bands, self.rows)
        key = np.arange(self.bands, dtype=np.uint64)
        for column in rows.T:
            key = _mixed(key * _GOLDEN + column)
        return key.view(np.int64)


def _shingle_set(text: bytes, width: int) -> set[bytes]:
    words = lower_ascii(text).split()
    width = min(width, len(words))
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, a fingerprint of the whole set and its bucket keys."""

    def prepare():
        minhash = CirculantMinHash(width)

        def digest(texts: list[bytes]) -> dict[str, list]:
            out: dict[str, list] = {"n_shingles": [], "fingerprint": [], "keys": []}
            for s in minhash.shingles(texts):
                out["n_shingles"].append(len(s))
                out["fingerprint"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                out["keys"].append(minhash.keys(minhash.signature(s)).tolist() if len(s) else None)
            return out

        return digest

    return per_document(docs, "n_shingles long, fingerprint binary, keys array<long>", prepare, most=_CHUNK)


def _linked(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, set[bytes]] = (b"", set())
        for batch in batches:
            keep = []
            for x, y in zip(binary(batch.column("text_a")), binary(batch.column("text_b")), strict=True):
                if x != last[0]:
                    last = (x, _shingle_set(x, width))
                first, second = last[1], _shingle_set(y, width)
                common = len(first & second)
                keep.append(common > 0 and 100 * common >= PERCENT * (len(first) + len(second) - common))
            rows = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            if rows.num_rows:
                yield rows

    return both.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def _prefix_pairs(texts: DataFrame, labels: DataFrame, width: int) -> DataFrame:
    """Pairs of nodes that share one of the shingles that a similar pair must share.

    Shingles are ordered by the number of ``texts`` that hold them, then by
    value; those of one text only come first and cannot be shared.  Two
    similar sets of ``n`` and ``m`` shingles have ``a`` in common, at least
    0.8 / 1.8 of ``n + m``; what follows their first common shingle, at places
    ``i`` and ``j`` in that order, must hold the rest, so ``1 + min(n - i - 1,
    m - j - 1) >= a``.  Only places that can satisfy this are compared.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = CirculantMinHash(width)
        for batch in batches:
            for piece in pieces(batch, "text", 1_000_000):
                sets = [x.view(np.int64) for x in minhash.shingles(binary(piece.column("text")))]
                sizes = np.array([len(s) for s in sets])
                ids = np.repeat(piece.column("node").to_numpy(), sizes)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(np.repeat(sizes, sizes), pa.int64()), pa.array(np.concatenate(sets))], names=["node", "size", "shingle"])

    rows = texts.select("node", "text").mapInArrow(explode, "node long, size long, shingle long")
    often = rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    shared = rows.join(often, "shingle").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("shared"))
    prefix = F.col("size") - F.ceil(F.col("size") * PERCENT / 100) + 1
    alone = F.col("size") - F.size("shared")
    left = (prefix - alone).cast("int")
    chosen = shared.where(left > 0).select("node", "size", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), left)["shingle"]).alias("at", "shingle"))
    chosen = stored(chosen.select("node", "size", "shingle", (F.col("size") - F.col("alone") - F.col("at")).alias("rest")).join(labels, "node"))
    # Of each shingle, members of the commonest component are never paired with each other.
    kinds = chosen.groupBy("shingle", "label").agg(F.count("*").alias("n")).groupBy("shingle")
    mixed = stored(kinds.agg(F.max(F.struct("n", "label"))["label"].alias("major"), F.count("*").alias("labels")).where("labels > 1").drop("labels"))
    # Sizes of partners that a row allows: similar in size, and with both sets within what is left from this place on.
    lowest, highest = F.ceil(F.col("size") * PERCENT / 100).cast("long"), F.least(F.floor(F.col("size") * 100 / PERCENT), F.floor(F.col("rest") * (100 + PERCENT) / PERCENT) - F.col("size")).cast("long")
    rows = chosen.join(mixed, "shingle").withColumns({"low": lowest, "high": highest}).where("low <= high")
    side = lambda s: [F.col(c).alias(f"{s}{t}") for c, t in (("node", ""), ("size", "_size"), ("label", "_label"), ("rest", "_rest"))]
    x = rows.where("label <> major").select("shingle", F.explode(_dyadic(F.col("low"), F.col("high"))).alias("_d"), *side("x"))
    y = rows.select("shingle", F.explode(_ancestors(F.col("size"))).alias("_d"), *side("y"))
    x, y = (t.select("*", "_d.level", "_d.at").drop("_d") for t in (x, y))
    enough = (100 + PERCENT) * F.least("x_rest", "y_rest") >= PERCENT * (F.col("x_size") + F.col("y_size"))
    return x.join(y, ["shingle", "level", "at"]).where((F.col("x_label") != F.col("y_label")) & enough)


def _dyadic(low: Column, high: Column) -> Column:
    """The interval from ``low`` to ``high`` as blocks (level, at): ``at`` times 2 ** level and as many numbers from there on."""

    def blocks(level: Column) -> Column:
        width = F.pow(F.lit(2), level).cast("long")
        first, end = F.floor((low + width - 1) / width), F.floor((high + 1) / width)
        left = F.when((first < end) & (first % 2 == 1), first)
        right = F.when((end % 2 == 1) & (end - 1 >= first + first % 2), end - 1)
        return F.array(left, right)

    levels = F.sequence(F.lit(0), F.log2(high - low + 2).cast("int"))
    pieces = F.transform(levels, lambda level: F.transform(F.filter(blocks(level), lambda at: at.isNotNull()), lambda at: F.struct(level.alias("level"), at.alias("at"))))
    return F.flatten(pieces)


def _ancestors(size: Column) -> Column:
    """The blocks that hold a size, of all levels that an interval of partners can have."""
    levels = F.sequence(F.lit(0), (F.log2(size + 2) + 1).cast("int"))
    return F.transform(levels, lambda level: F.struct(level.alias("level"), F.floor(size / F.pow(F.lit(2), level)).cast("long").alias("at")))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and the smallest node reachable by edges (a, b), by min labels and pointer jumping."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stored(nodes.select("node", F.col("node").alias("label")))
    if both.isEmpty():
        return labels
    while True:
        reached = (
            both.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        )
        lower = labels.join(reached, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("next"))
        new = stored(lower.join(jump, "low", "left").select("node", "label", F.least("low", F.coalesce("next", "low")).alias("new")))
        changed = new.where("new < label").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, *, width: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_signed = stored(signed(docs, width))
    usable = all_signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = stored(
        usable.groupBy("fingerprint").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("size"), F.first("keys").alias("keys"))
    )
    placed = classes.select("node", "size", F.explode("keys").alias("key"))
    shared = stored(placed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "n"))
    members = stored(placed.join(shared, "key").select("key", "node", "size", "n"))
    # Members of a node's buckets: the text behind many copies shares most.
    nodes = stored(members.groupBy("node").agg(F.sum("n").alias("weight"), F.max("size").alias("size")))
    texts = stored(docs.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text"))
    labels = nodes.select("node", F.col("node").alias("label"))
    for turn in range(STARS + 1):
        placed = members.join(labels.join(nodes.drop("size"), "node") if turn == 0 else labels, "node")
        rank = F.col("weight") if turn == 0 else F.hash("node", F.lit(turn)).cast("long")
        several = placed.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.max(F.struct(rank.alias("rank"), (-F.col("node")).alias("_node"), "size", "label")).alias("pivot"))
        mixed = stored(several.where("_low < _high").select("key", "pivot"))
        if mixed.isEmpty():
            break
        if turn < STARS:
            pairs = placed.join(mixed, "key").select((-F.col("pivot._node")).alias("x"), F.col("pivot.size").alias("x_size"), F.col("pivot.label").alias("x_label"), F.col("node").alias("y"), F.col("size").alias("y_size"), F.col("label").alias("y_label"))
        else:
            still = placed.join(mixed.select("key"), "key").select("node").distinct()
            pairs = _prefix_pairs(texts.join(still, "node"), labels, width)
        near = F.lit(100) * F.least("x_size", "y_size") >= PERCENT * F.greatest("x_size", "y_size")
        pairs = pairs.where((F.col("x_label") != F.col("y_label")) & near).select(F.col("x").alias("a"), F.col("y").alias("b"))
        found = stored(_linked(stored(pairs.distinct()), texts, width))
        if found.isEmpty():  # this round's pivots link nothing; the next may, and the last compares all
            continue
        # Links become edges between components.
        of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))  # noqa: B023, E731
        edges = found.join(of("a"), "a").join(of("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).where("a <> b").distinct()
        merged = components(labels.select(F.col("label").alias("node")).distinct(), edges)
        labels = stored(labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("new")), "label").select("node", F.col("new").alias("label")))
    # Only classes that a smaller document reaches change; a table, so that groups of copies can be split in the join.
    moved = stored(classes.select("fingerprint", "node").join(labels, "node", "left").select("fingerprint", F.coalesce("label", "node").alias("found")))
    rows = all_signed.select("doc_id", "n_shingles", "fingerprint")
    bare = F.col("fingerprint").isNull() | F.col("doc_id").isNull()
    whole = rows.where(~bare).join(moved, "fingerprint", "left").unionByName(rows.where(bare).withColumn("found", F.col("doc_id")))
    return whole.select("doc_id", "n_shingles", F.col("found").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, *, width: int = 4) -> DataFrame:
    """The columns of ``docs`` without documents that have a smaller near duplicate."""
    gone = near_duplicates(docs, width=width).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")
