"""Language-model scores by a probabilistic suffix tree.

The symbols are the bytes of a text's lower-cased tokens, joined by one space
and closed by one end symbol.  Contexts of up to ``DEPTH`` bytes become states
of the tree if they occur ``LEAST_COUNT`` times, at any corpus size, and if a
divergence test says that they predict better than the state one byte shorter.
Next-symbol distributions are smoothed towards the shorter state, and a text
is scored from the longest suffix state at each place.

The tree grows with the corpus.  All contexts that end in the same two bytes
are a block, whose subtree needs no other block: the blocks grow on the
executors and are written as a table.  The driver holds the states of one byte
and, one after the other, parts of about ``PART_ROWS`` rows, each of which is
broadcast and scores the places of its own blocks; a text's score is the sum
over the parts.

Beside it stands the token unigram of the contract.  Its vocabulary grows with
the corpus: words above ``FREQUENT_SHARE`` of all tokens (a bounded number)
are broadcast, the other words of each text meet their counts in a shuffle by
word, which therefore has no hot key.

Defined results: null and empty texts have only the end token; repeated rows
give repeated results; rows with a null doc_id are not held out; an empty
table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, held_out, lower_ascii, pieces, stored

HELD_OUT = 10
#: Bytes of a context at most; a context and its next symbol fit in 64 bits.
DEPTH = 6
#: A context needs so many occurrences, whatever the size of the corpus.
LEAST_COUNT = 20
#: Log-likelihood (nats) that a state must gain over the shorter one.
LEAST_GAIN = 10.0
#: Rows of the tree (states and their next symbols) that are broadcast at once.
PART_ROWS = 3_000_000
#: Words of at least this share of all training tokens are broadcast: 100,000 words at most.
FREQUENT_SHARE = 1e-5
#: The end of a text, as a token and as a symbol; no word contains it.
END = b"\n"
_PIECE = 3_000_000
_BLOCKS = 1 << 16
_MASK = [np.int64((1 << 8 * d) - 1) for d in range(DEPTH + 2)]


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words and the end token."""
    return [*lower_ascii(text).split(), END]


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The context and next symbol of every place, packed, and where each text begins."""
    joined = [b" ".join(lower_ascii(t).split()) + END for t in texts]
    data = b"".join(END * DEPTH + j for j in joined)
    sizes = np.array([len(j) for j in joined])
    ends = np.cumsum(sizes + DEPTH)
    n = max(0, len(data) - DEPTH)
    # Eight bytes from every place on, as big-endian numbers that overlap in memory, cut to DEPTH + 1 bytes.
    windows = np.ndarray((n,), ">u8", data + bytes(8), strides=(1,))
    packed = (windows.astype(np.uint64) >> np.uint64(8 * (7 - DEPTH))).view(np.int64)
    # Place k predicts data[k + DEPTH]; the padding before each text is not predicted.
    keep = np.ones(n, bool)
    for d in range(1, DEPTH + 1):
        keep[ends[:-1] - d] = False
    return packed[keep], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    import pandas as pd

    codes, distinct = pd.factorize(values)
    return codes, np.asarray(distinct, np.int64)


def _backwards(packed: np.ndarray) -> np.ndarray:
    """Packed contexts and symbols with the symbol first, then the context from its latest byte on."""
    return packed.astype(np.int64).byteswap().view(np.uint64)


#: The symbol and the latest bytes of a context, of a backward key.
_TOP = [np.uint64(((1 << 8 * (d + 1)) - 1) << 8 * (7 - d)) for d in range(DEPTH + 1)]
_CONTEXT = np.uint64((1 << 56) - 1)


class SuffixTree:
    """By depth: states with their escape, and next symbols of states with their probability, as sorted backward keys.

    Sorted backwards, contexts that share their latest bytes lie together, so
    that every depth is looked up once for all that share it, in order.
    """

    def __init__(self, root: np.ndarray, states: list[tuple[np.ndarray, np.ndarray]], nexts: list[tuple[np.ndarray, np.ndarray]]):
        self.root, self.states, self.nexts = root, states, nexts

    @classmethod
    def grown(cls, levels: list[tuple[np.ndarray, np.ndarray]]) -> SuffixTree:
        """From (context and symbol, count) of each depth from 0: tests the divergence of each context, shortest first."""
        root = np.ones(256)
        if levels and len(levels[0][0]):
            root[levels[0][0]] += levels[0][1]
        return cls(root / root.sum(), [], []).extended(levels[1:])

    def extended(self, levels: list[tuple[np.ndarray, np.ndarray]]) -> SuffixTree:
        """This tree with the good contexts of the next depths."""
        tree = SuffixTree(self.root, [*self.states], [*self.nexts])
        for depth, (keys, counts) in enumerate(levels, len(self.states) + 1):
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order].astype(float)
            context = keys >> 8
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
            kinds = np.diff(np.append(first, len(keys)))
            totals = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
            shorter = np.exp(tree.log_p(keys))
            own = (counts + np.repeat(kinds, kinds) * shorter) / np.repeat(totals + kinds, kinds)
            gain = np.add.reduceat(counts * np.log(own / shorter), first) if len(first) else np.zeros(0)
            states = context[first] if len(first) else np.zeros(0, np.int64)
            good = gain > LEAST_GAIN
            if depth > 1:  # a state's suffix is a state
                good &= np.isin(_backwards((states & _MASK[depth - 1]) << 8), tree.states[-1][0])
            inside = np.repeat(good, kinds)
            tree.states.append(_sorted(_backwards(states[good] << 8), (kinds / (totals + kinds))[good]))
            tree.nexts.append(_sorted(_backwards(keys[inside]), own[inside]))
        return tree

    def log_p(self, packed: np.ndarray) -> np.ndarray:
        """Natural log probability of each packed context's next symbol, from its longest suffix state."""
        keys = _backwards(packed)
        order = np.argsort(keys)
        keys = keys[order]
        # Of each depth: the distinct keys, where a state was found for all shorter contexts, and their place in it.
        p = self.root[(keys >> np.uint64(56)).astype(np.int64)]
        at = np.arange(len(keys))
        for depth, ((states, escapes), (nexts, own)) in enumerate(zip(self.states, self.nexts, strict=True), 1):
            if not len(states) or not len(at):
                break
            each = keys[at] & _TOP[depth]
            begins = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]]))
            distinct = each[begins]
            place = np.minimum(np.searchsorted(nexts, distinct), len(nexts) - 1)
            seen = nexts[place] == distinct
            unseen = np.flatnonzero(~seen)
            context = distinct[unseen] & _CONTEXT
            state = np.minimum(np.searchsorted(states, context), len(states) - 1)
            escaped = states[state] == context
            value = np.where(seen, own[place], p[at[begins]])
            value[unseen[escaped]] *= escapes[state[escaped]]
            known = seen
            known[unseen[escaped]] = True
            sizes = np.diff(np.append(begins, len(at)))
            at = at[np.repeat(known, sizes)]
            p[at] = np.repeat(value[known], sizes[known])
        out = np.empty(len(p))
        out[order] = np.log(p)
        return out

    def scores(self, texts: list[bytes], blocks: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each text, or the part of it that the places of some blocks (one bool each) have."""
        packed, starts = grams(texts)
        codes, distinct = _distinct(packed)
        if blocks is None:
            each = self.log_p(distinct)
        else:
            each = np.zeros(len(distinct))
            inside = blocks[(distinct >> 8) & (_BLOCKS - 1)]
            each[inside] = self.log_p(distinct[inside])
        return np.add.reduceat(each[codes], starts) / np.log(10) if len(texts) else np.zeros(0)


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order]


def corpus_counts(docs: DataFrame) -> DataFrame:
    """word or gram, and n: counts over all training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def out_words() -> pa.RecordBatch:
            batch = pa.record_batch(
                [pa.array(words.keys(), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(words.values(), pa.int64())], names=["word", "gram", "n"]
            )
            words.clear()
            return batch

        def merge() -> int:
            """Counts of all parts as one part; returns its size."""
            codes, distinct = _distinct(np.concatenate([np.zeros(0, np.int64), *(k for k, _ in parts)]))
            weights = np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])
            parts[:] = [(distinct, np.bincount(codes, weights, len(distinct)).astype(np.int64))]
            return len(distinct)

        def out_grams() -> pa.RecordBatch:
            merge()
            keys, sums = parts.pop()
            return pa.record_batch([pa.nulls(len(keys), pa.binary()), pa.array(keys), pa.array(sums)], names=["word", "gram", "n"])

        for batch in batches:
            for piece in pieces(batch, "text", _PIECE):
                texts = binary(piece.column("text"))
                for t in texts:
                    words.update(tokens(t))
                codes, distinct = _distinct(grams(texts)[0])
                parts.append((distinct, np.bincount(codes, minlength=len(distinct)).astype(np.int64)))
                if len(words) > 400_000:
                    yield out_words()
                if sum(len(k) for k, _ in parts) > 6_000_000 and merge() > 3_000_000:
                    yield out_grams()
        yield out_words()
        yield out_grams()

    training = docs.where(~held_out(HELD_OUT)).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return training.mapInArrow(count, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def often(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys, with their counts, whose contexts occur often enough."""
    codes, contexts = _distinct(keys >> 8)
    good = np.bincount(codes, counts, len(contexts))[codes] >= LEAST_COUNT
    return keys[good], counts[good]


def grow(counts: DataFrame) -> tuple[SuffixTree, DataFrame]:
    """The states of one byte, and a table of all longer states and their next symbols by block."""
    symbols = counts.where("gram is not null").select("gram", "n")
    levels = []
    for depth in range(2):
        rows = symbols.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (depth + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
        levels.append((rows.column("key").to_numpy().astype(np.int64), rows.column("n").to_numpy().astype(np.int64)))
    base = SuffixTree.grown([levels[0], often(*levels[1])])
    sent = counts.sparkSession.sparkContext.broadcast(base)

    def block_rows(block: pa.Table) -> pa.Table:
        grams, n = block.column("gram").to_numpy(), block.column("n").to_numpy()
        levels = []
        for depth in range(2, DEPTH + 1):
            codes, keys = _distinct(grams & _MASK[depth + 1])
            levels.append(often(keys, np.bincount(codes, n, len(keys))))
        tree = sent.value.extended(levels)
        number = block.column("block")[0].as_py()
        found: list[list[np.ndarray]] = [[], [], [], []]
        for depth in range(2, DEPTH + 1):
            for inner, (keys, values) in enumerate((tree.states[depth - 1], tree.nexts[depth - 1])):
                for c, v in zip(found, (np.full(len(keys), depth), keys.view(np.int64), values, np.full(len(keys), inner == 0)), strict=True):
                    c.append(v)
        depths, keys, values, state = (np.concatenate(c) for c in found)
        return pa.table([pa.array(np.full(len(keys), number), pa.int32()), pa.array(depths, pa.int8()), pa.array(keys, pa.int64()), pa.array(values, pa.float64()), pa.array(state, pa.bool_())], names=["block", "depth", "key", "value", "state"])

    block = F.shiftright("gram", 8).bitwiseAND(F.lit(_BLOCKS - 1)).cast("int").alias("block")
    return base, stored(symbols.select(block, "gram", "n").groupBy("block").applyInArrow(block_rows, "block int, depth byte, key long, value double, state boolean"))


def parts_of(base: SuffixTree, table: DataFrame) -> Iterator[tuple[SuffixTree, np.ndarray | None]]:
    """Trees of about ``PART_ROWS`` rows and the blocks that each scores (None: all)."""
    sizes = np.zeros(_BLOCKS, np.int64)
    for r in table.groupBy("block").count().collect():
        sizes[r["block"]] = r["count"]
    part = np.maximum(np.cumsum(sizes) - 1, 0) // PART_ROWS
    for p in np.unique(part):
        blocks = part == p
        low, high = np.flatnonzero(blocks)[[0, -1]].tolist()
        rows = table.where(F.col("block").between(low, high)).select("depth", "key", "value", "state").toArrow()
        depths, keys, values, state = (rows.column(c).to_numpy() for c in ("depth", "key", "value", "state"))
        tree = SuffixTree(base.root, [*base.states], [*base.nexts])
        for depth in range(2, DEPTH + 1):
            for inner in (True, False):
                at = np.flatnonzero((depths == depth) & (state == inner))
                (tree.states if inner else tree.nexts).append(_sorted(keys[at].view(np.uint64), values[at]))
        yield tree, None if blocks.all() else blocks


def language_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = stored(corpus_counts(docs))
    words = counts.where("word is not null").select("word", "n")
    n_train, n_distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = max(2, int(np.ceil(n_train * FREQUENT_SHARE)))
    common = words.where(F.col("n") >= least).toArrow()
    frequent = spark.sparkContext.broadcast(dict(zip(common.column("word").to_pylist(), np.log10(common.column("n").to_numpy() + 0.1).tolist(), strict=True)))
    parts = [spark.sparkContext.broadcast(p) for p in parts_of(*grow(counts))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (tree, blocks), often = parts[0].value, frequent.value
        names = ["doc_id", "text_key", "n_tokens", "n_known", "base", "score", "words", "copies"]
        for batch in batches:
            for piece in pieces(batch, "text", _PIECE):
                texts = binary(piece.column("text"))
                columns: list[list] = [[], [], [], []]
                words: list[bytes] = []
                copies: list[int] = []
                ends = [0]
                for t in texts:
                    found = Counter(tokens(t))
                    key = xxhash.xxh3_64_intdigest(t) - (1 << 63)
                    # The text's own row goes first, by a word that no text has.
                    words.append(b"\n%d" % key)
                    copies.append(0)
                    base, known = 0.0, 0
                    for w, k in found.items():
                        if w in often:
                            base += k * often[w]
                            known += k
                        else:
                            words.append(w)
                            copies.append(k)
                    ends.append(len(words))
                    for c, v in zip(columns, (key, found.total(), known, base), strict=True):
                        c.append(v)
                offsets = pa.array(ends, pa.int32())
                arrays = [piece.column("doc_id"), *(pa.array(c) for c in columns), pa.array(tree.scores(texts, blocks))]
                arrays += [pa.ListArray.from_arrays(offsets, pa.array(words, pa.binary())), pa.ListArray.from_arrays(offsets, pa.array(copies, pa.int64()))]
                yield pa.record_batch(arrays, names=names)

    def further(number: int, sent) -> DataFrame:
        """doc_id, text_key, part and score of each row by one of the other parts."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, blocks = sent.value
            for batch in batches:
                for piece in pieces(batch, "text", _PIECE):
                    texts = binary(piece.column("text"))
                    keys = pa.array([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts], pa.int64())
                    yield pa.record_batch([piece.column("doc_id"), keys, pa.array([number] * len(texts), pa.int32()), pa.array(tree.scores(texts, blocks))], names=["doc_id", "text_key", "part", "score"])

        return docs.mapInArrow(run, "doc_id long, text_key long, part int, score double")

    scored = docs.mapInArrow(score, "doc_id long, text_key long, n_tokens long, n_known long, base double, score double, words array<binary>, copies array<long>")
    own = lambda c: F.when(F.col("at") == 0, F.col(c)).alias(c)
    placed = scored.select("doc_id", "text_key", "n_tokens", "n_known", "base", "score", F.posexplode(F.arrays_zip("words", "copies")).alias("at", "_w"))
    rows = placed.select("doc_id", "text_key", F.col("_w.words").alias("word"), F.col("_w.copies").alias("copies"), own("n_tokens"), own("n_known"), own("base"), own("score"))
    rare = words.where(F.col("n") < least).select("word", F.col("n").alias("c"))
    met = rows.join(rare.hint("shuffle_hash"), "word", "left")
    if len(parts) > 1:
        met = met.withColumn("part", F.lit(0))
        for number, sent in enumerate(parts[1:], 1):
            met = met.unionByName(further(number, sent), allowMissingColumns=True)
        whole_score = sum((F.max(F.when(F.col("part") == i, F.col("score"))) for i in range(1, len(parts))), F.max(F.when(F.col("part") == 0, F.col("score"))))
    else:
        whole_score = F.max("score")
    c = F.coalesce("c", F.lit(0))
    by_text = met.groupBy("doc_id", "text_key").agg(
        F.count("n_tokens").alias("rows"),
        F.max("n_tokens").alias("n_tokens"),
        F.max("n_known").alias("often_known"),
        F.max("base").alias("often_base"),
        whole_score.alias("score"),
        F.coalesce(F.sum(F.when(c > 0, F.col("copies"))), F.lit(0)).alias("rare_known"),
        F.coalesce(F.sum(F.col("copies") * F.log10(c + 0.1)), F.lit(0.0)).alias("rare_base"),
    )
    # Repeated rows were counted together: each gets its share, which is the same for all.
    whole = float(np.log10(n_train + 0.1 * (n_distinct + 1)))
    return by_text.select(
        "doc_id",
        held_out(HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("often_known") + F.col("rare_known") / F.col("rows")).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("often_base") + F.col("rare_base") / F.col("rows") - F.col("n_tokens") * whole).alias("base_score"),
        "score",
        F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("_row"),
    ).drop("_row")
