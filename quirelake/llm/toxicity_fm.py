"""Toxicity by a factorization machine over hashed terms.

A document is the set of the hashed terms of its words: each word and its
beginnings of four and six bytes.  Every term of ``LEAST_DOCUMENTS``
training rows takes part; each has a linear weight, and each pair of them in a
document a low-rank interaction, so that a combination, such as an insult with
the mention of a group, can weigh more than the sum of its parts.  Terms whose
share of toxic documents hardly differs from the average (a z value over the
training rows) are regularised by smaller inputs, their factors much less than
their weights, so that pairs of such terms are learned as well.

The machine is fitted on the driver over a sample of labelled rows of at most
``MOST_LABELLED`` documents, chosen by a hash of doc_id, of which whole texts
are read; terms are counted on the executors, and what reaches the driver are
those that take part.  No model has more than ``BUCKETS`` terms, and every
whole text of the table is scored.

Defined results: null and empty texts get the score of a text without terms;
without labelled rows, with one class only or without such terms, every score is the smoothed
share of toxic rows (0.5 without rows) less a hair, so nothing is rejected
unseen; null labels are left out; a document labelled twice counts by its
largest label, one with several texts by the first of them in order; repeated
rows give repeated results; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, binary, held_out, per_document, rewritten, stored

BUCKETS = 1 << 22
FACTORS = 4
#: Labelled documents fitted at most.
MOST_LABELLED = 12_000
#: Rows whose crc32(doc_id) is divisible by this are never learned from.
HELD_OUT = 5
BEGINNINGS = (4, 6)
#: A term takes part if so many training documents have it.
LEAST_DOCUMENTS = 5
#: The z value from which a term is an input of 1; below, of what power of its part of it for weights and for factors, and of how much for factors at least.
CLEAR_Z, WEIGHT_POWER, FACTOR_POWER, LEAST_FACTOR = 5.0, 3, 1, 0.1
THRESHOLD = 0.5
#: Mini-batches of the fit and its rate.
STEPS, RATE = 1_000, 0.25
#: Words whose terms a task remembers.
CACHED = 200_000


def word_terms(word: bytes) -> list[int]:
    """Hashed terms of a word: itself and its beginnings; the family of a term is where its checksum starts."""
    return [zlib.crc32(word) % BUCKETS, *[zlib.crc32(word[:n], n) % BUCKETS for n in BEGINNINGS if len(word) > n]]


class FactorizationMachine:
    """sigmoid(bias + sum w + 1/2 (|sum v|^2 - sum |v|^2)) over the terms of a document."""

    def __init__(self, bias: float, terms: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.terms, self.weights, self.factors = bias, terms, weights, factors
        # Per term: what counts alone, w - |v|^2 / 2, and the factors.
        self.inputs = np.column_stack([weights - 0.5 * (factors * factors).sum(1), factors]).astype(np.float64)

    def __reduce__(self):
        return FactorizationMachine, (self.bias, self.terms, self.weights, self.factors)

    @property
    def place(self) -> dict[int, int]:
        """The place of each term among the weights."""
        return {t: i for i, t in enumerate(self.terms.tolist())}

    @classmethod
    def constant(cls, share: float) -> FactorizationMachine:
        """The same score for all texts, below one half."""
        share = min(max(share, 1e-6), 0.5 - 1e-6)
        return cls(float(np.log(share / (1 - share))), np.zeros(0, np.int32), np.zeros(0), np.zeros((0, FACTORS)))

    @classmethod
    def fitted(cls, documents: list[np.ndarray], labels: np.ndarray, *, steps: int = STEPS, rate: float = RATE, decay: float = 2e-3) -> FactorizationMachine:
        """Adagrad over mini-batches of fixed rows in changing order; inputs are scaled by the terms' z values.

        The number of steps does not depend on that of the rows, each of which is read once at least.
        """
        n, positive = len(labels), int(labels.sum())
        if not 0 < positive < n:
            return cls.constant((positive + 0.5) / (n + 1) if n else 0.5)
        # One document at a time: the driver never holds all terms twice.
        seen, toxic = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
        for d, y in zip(documents, labels, strict=True):
            found = np.unique(d)
            seen[found] += 1
            toxic[found] += int(y)
        share = positive / n
        terms = np.flatnonzero(seen >= LEAST_DOCUMENTS).astype(np.int32)
        if not len(terms):
            return cls.constant(share)
        clear = np.abs(toxic[terms] - seen[terms] * share) / np.sqrt(seen[terms] * share * (1 - share)) / CLEAR_Z
        first = np.minimum(1, clear**WEIGHT_POWER)
        second = np.clip(clear**FACTOR_POWER, LEAST_FACTOR, 1)[:, None]
        place = np.full(BUCKETS, -1, np.int32)
        place[terms] = np.arange(len(terms), dtype=np.int32)
        rng = np.random.default_rng(10)
        order = rng.permutation(n)
        batches = []
        for at in range(0, n, 128):
            rows = order[at : at + 128]
            parts = [(i := place[np.unique(documents[r])])[i >= 0] for r in rows]
            used, inside = np.unique(np.concatenate(parts), return_inverse=True)
            owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(p) for p in parts])
            batches.append((labels[rows], used, inside.astype(np.int32), owner))
        w = np.zeros(len(terms))
        v = rng.normal(0, 0.05, (len(terms), FACTORS))
        gw, gv = np.full(len(terms), 1e-1), np.full((len(terms), FACTORS), 1e-1)
        bias, gb = float(np.log(share / (1 - share))), 1.0
        for _ in range(-(-steps // len(batches))):
            for at in rng.permutation(len(batches)):
                truth, used, inside, owner = batches[at]
                n_rows, n_used = len(truth), len(used)
                s1, s2 = first[used], second[used]
                vs = s2 * v[used]
                vt = vs[inside]
                total = np.stack([np.bincount(owner, vt[:, k], n_rows) for k in range(FACTORS)], 1)
                alone = (s1 * w[used] - 0.5 * (vs * vs).sum(1))[inside]
                score = bias + np.bincount(owner, alone, n_rows) + 0.5 * (total * total).sum(1)
                error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - truth
                each, pull = error[owner], (error[:, None] * total)[owner]
                mass = np.bincount(inside, each, n_used)
                dw = s1 * mass + decay * w[used]
                dv = s2 * (np.stack([np.bincount(inside, pull[:, k], n_used) for k in range(FACTORS)], 1) - mass[:, None] * vs) + decay * v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                w[used] -= rate * dw / np.sqrt(gw[used])
                v[used] -= 0.1 * rate * dv / np.sqrt(gv[used])
                db = float(error.sum())
                gb += db * db
                bias -= rate * db / gb**0.5
        return cls(bias, terms, first * w, second * v)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The scores of whole texts."""
        return Scorer(self).scores(texts)


class Scorer:
    """Scores texts by a machine, with a table of the words met, which ends with it."""

    def __init__(self, machine: FactorizationMachine):
        self.machine = machine
        self._forget()

    def _forget(self) -> None:
        """Empties the table of words: the terms of word number i lie in ``flat`` from ``begins[i]`` to ``begins[i + 1]``."""
        self.numbers: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.int64)
        self.begins = np.zeros(1, np.int64)

    def learn(self, words: set[bytes]) -> None:
        """Puts the terms of new words into the table."""
        if len(self.numbers) > CACHED:
            self._forget()
        new = [w for w in words if w not in self.numbers]
        if not new:
            return
        found = [word_terms(w) for w in new]
        sizes = np.array([len(f) for f in found])
        terms = np.fromiter((t for f in found for t in f), np.int32, int(sizes.sum()))
        at = np.minimum(np.searchsorted(self.machine.terms, terms), max(0, len(self.machine.terms) - 1))
        known = self.machine.terms[at] == terms if len(self.machine.terms) else np.zeros(len(terms), bool)
        kept = np.add.reduceat(known, np.cumsum(sizes) - sizes).astype(np.int64)
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(kept)])
        self.flat = np.concatenate([self.flat, at[known]])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The scores of whole texts."""
        found = [set(alnum_words(t)) for t in texts]
        self.learn(set().union(*found))
        sizes = np.array([len(f) for f in found], np.int64)
        numbers = np.fromiter((i for f in found for i in map(self.numbers.__getitem__, f)), np.int64, int(sizes.sum()))
        begins, counts = self.begins[numbers], self.begins[numbers + 1] - self.begins[numbers]
        places = np.repeat(begins - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
        owner = np.repeat(np.repeat(np.arange(len(texts)), sizes), counts)
        # Words share beginnings: each term counts once in a text.
        keys = np.sort(owner * max(1, len(self.machine.terms)) + self.flat[places])
        owner, terms = np.divmod(keys[np.flatnonzero(np.diff(keys, prepend=-1))], max(1, len(self.machine.terms)))
        out = np.full(len(texts), self.machine.bias)
        if len(terms):
            begin = np.flatnonzero(np.diff(owner, prepend=-1))
            sums = np.add.reduceat(self.machine.inputs[terms], begin)
            out[owner[begin]] += sums[:, 0] + 0.5 * (sums[:, 1:] ** 2).sum(1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, text and label of at most ``most`` labelled rows that are not held out, by a hash of doc_id."""
    wanted = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(HELD_OUT))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(label).cast("int")).alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_label").alias("_label"))


def fit(docs: DataFrame, labels: DataFrame, *, most: int = MOST_LABELLED) -> FactorizationMachine:
    """A machine fitted on the labelled rows of ``docs``."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(sorted({t for w in set(alnum_words(text)) for t in word_terms(w)}), np.int32).tobytes() for text in binary(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.binary()), batch.column("_label")], names=["doc_id", "terms", "_label"]
            )

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int32)
        for batch in batches:
            for x in batch.column("terms").to_pylist():
                total[np.frombuffer(x, np.int32)] += 1
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["term", "n"])

    sample = stored(training_rows(docs, labels, most=most).mapInArrow(terms, "doc_id long, terms binary, _label int"))
    often = sample.mapInArrow(seen, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS).select("term").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(often.column("term").to_numpy()))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.intersect1d(np.frombuffer(x, np.int32), sent.value, assume_unique=True).tobytes() for x in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary()), batch.column("_label")], names=["doc_id", "terms", "_label"])

    rows = sample.mapInArrow(kept, sample.schema).toArrow().sort_by("doc_id")
    documents = [np.frombuffer(x, np.int32) for x in rows.column("terms").to_pylist()]
    return FactorizationMachine.fitted(documents, np.array(rows.column("_label").to_pylist(), np.float32))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and predicted of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def prepare():
        scorer = Scorer(sent.value)

        def digest(texts: list[bytes]) -> dict[str, list]:
            scores = scorer.scores(texts)
            return {"score": scores.tolist(), "predicted": (scores >= THRESHOLD).astype(int).tolist()}

        return digest

    return per_document(docs, "score double, predicted int", prepare, most=2_000_000)


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the machine doesn't take for toxic, with their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def prepare():
        scorer = Scorer(sent.value)
        return lambda texts: ((scorer.scores(texts) < THRESHOLD).tolist(), {})

    return rewritten(docs, prepare, most=2_000_000)
