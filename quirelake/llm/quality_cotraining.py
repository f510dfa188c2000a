"""Document quality by co-training.

Two classifiers see different views of a document: its text (hashed words and
style measures of the whole text) and its page metadata (language, source,
length class).
Both start from the labelled rows; in each round either one labels the
documents that it is most sure of, among all unlabelled ones that it has not
labelled yet, and hands them to the other.  At the end
each view is calibrated on labelled rows that were kept apart, and a second
logistic model over the calibrated views scores every document.

Every whole text is read once, for a vector of fixed size that is written as a
table.  The driver has ``MOST_LABELLED`` labelled rows, chosen by a hash of
doc_id; of the unlabelled ones, all of which take part, it has histograms of
scores, counts by metadata, and sums of slopes and curvatures.  Which labels a
row was given follows from the views of the rounds before, so no state of rows
is kept.

Defined results: a null or empty text has the style measures of an empty text and no words;
null metadata is a value of its own; without labels, or with one class only,
every score is the smoothed share of good rows; a document with null labels alone is unlabelled, a
document labelled twice counts by its largest label, and one with several texts is learned from by the one whose
vectors come first in order; rows whose crc32(doc_id) is divisible by ``HELD_OUT`` are scored, never learned from; repeated rows give
repeated results; an empty table gives an empty result; other columns are not
read, and missing metadata columns count as null.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, held_out, lower_ascii, pieces, stored
from .quality_rules import repeated_words

HELD_OUT = 5
MOST_LABELLED = 6_000
ROUNDS = 5
#: Part of the rows it has not labelled yet that either view labels in a round.
CONFIDENT = 0.05
#: Bins of a score's logit by which rows are ranked.
BINS = 256
METADATA = 256
#: Buckets of hashed words in the text view.
WORDS = 128
THRESHOLD = 0.5

_CLASSES = (b"#*$%&|<>", b"!?", b".,;:", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\"'()[]{}", b"=+-_/\\", b"\n")


def style(text: bytes) -> list[float]:
    """Measures of a whole text, each about 0 to 1."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    out = [1.0]
    for c in _CLASSES:
        share = (len(text) - len(text.translate(None, c))) / size
        out += [min(1.0, 5 * share), float(share > 0.02), float(share > 0.15)]
    distinct = len(set(map(lower_ascii, words))) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = repeated_words(words) / n
    mean = len(b"".join(words)) / n
    out += [distinct, float(distinct < 0.3), repeated, float(repeated > 0.3), 1 - len(set(lines)) / max(1, len(lines)), min(1.0, mean / 20), float(mean > 12), float(mean < 3)]
    return [*out, min(1.0, np.log1p(len(words)) / 12), float(len(words) < 20)]


STYLE = len(style(b""))
#: Places of the text view: style, then words.
TEXT = STYLE + WORDS


def word_shares(text: bytes) -> bytes:
    """For each bucket the root of the share of words that fall into it, in steps of 1/255."""
    counts = Counter(map(lower_ascii, text.split()))
    if not counts:
        return bytes(WORDS)
    buckets = np.fromiter((zlib.crc32(w) % WORDS for w in counts), np.int64, len(counts))
    shares = np.bincount(buckets, np.fromiter(counts.values(), float, len(counts)), WORDS) / counts.total()
    return np.rint(255 * np.sqrt(shares)).astype(np.uint8).tobytes()


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """Hashed places of a document's metadata."""
    length = "none" if n_chars is None else str(int(np.log2(max(1, n_chars))))
    return [zlib.crc32(f"{k}={v}".encode()) % METADATA for k, v in (("lang", lang), ("source", source), ("length", length))]


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id, style, word and metadata vectors of each row."""
    cols = [F.col(c).cast(k).alias(c) if c in docs.columns else F.lit(None).cast(k).alias(c) for c, k in (("lang", "string"), ("source", "string"), ("n_chars", "long"))]
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 8_000_000):
                meta = [metadata(*m) for m in zip(*(piece.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)]
                texts = binary(piece.column("text"))
                arrays = [piece.column("doc_id"), pa.array(map(style, texts), pa.list_(pa.float64())), pa.array(map(word_shares, texts), pa.binary()), pa.array(meta, pa.list_(pa.int32()))]
                yield pa.record_batch(arrays, names=["doc_id", "style", "words", "metadata"])

    return chosen.mapInArrow(run, "doc_id long, style array<double>, words binary, metadata array<int>")


def _arrays(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The text vectors and metadata places of rows."""
    table = rows.combine_chunks() if isinstance(rows, pa.Table) else rows
    styles, places = (np.asarray(x.combine_chunks().flatten() if isinstance(x, pa.ChunkedArray) else x.flatten()) for x in (table.column("style"), table.column("metadata")))
    words = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint8).reshape(-1, WORDS) / 255
    return np.hstack([styles.reshape(-1, STYLE), words]), places.reshape(-1, 3).astype(int)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def derivatives(x: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of the log loss of rows that count ``n`` times each."""
    p = _sigmoid(x @ w)
    return x.T @ (n * (p - y)), (x * (n * p * (1 - p))[:, None]).T @ x


def logistic(
    x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, *, more: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None,
    start: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 15,
) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; ``more`` adds the derivatives of rows elsewhere."""
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    for _ in range(rounds):
        slope, curve = derivatives(x, y, np.ones(len(y)) if n is None else n, w)
        if more:
            slope, curve = (a + b for a, b in zip((slope, curve), more(w), strict=True))
        slope = slope + ridge * w
        curve = curve + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < (1e-4 if more else 1e-6):
            break
    return w


def one_hot(places: np.ndarray) -> np.ndarray:
    """Rows of hashed places as indicators, with a constant."""
    out = np.zeros((len(places), METADATA + 1))
    out[np.arange(len(places))[:, None], places] = 1
    out[:, -1] = 1
    return out


def _bins(z: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(z, -30, 30) * BINS).astype(int)


def _binned(view: int, styles: np.ndarray, places: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The binned logits of rows by a view; equal metadata are reckoned once."""
    if view == 0:
        return _bins(styles @ w)
    distinct, codes = np.unique(places, axis=0, return_inverse=True)
    return _bins(one_hot(distinct) @ w)[codes.reshape(-1)]


#: Weights of a view in a round; the rows of up to the first bin are bad, those from the second on good.
Rule = tuple[np.ndarray, int, float]


def given(view: int, rules: list[Rule], styles: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The label of each row by the first rule of a view that is sure of it, or -1."""
    out = np.full(len(styles), -1)
    for w, bad, good in rules:
        z = _binned(view, styles, places, w)
        out = np.where(out >= 0, out, np.where(z <= bad, 0, np.where(z >= good, 1, -1)))
    return out


class Pool:
    """All unlabelled rows: a table of vectors of which only sums reach the driver."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def each(self, schema: str, run: Callable[[np.ndarray, np.ndarray], pa.RecordBatch]) -> DataFrame:
        """What ``run`` makes of the vectors of each batch."""

        def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in found:
                if batch.num_rows:
                    yield run(*_arrays(batch))

        return self.rows.mapInArrow(batches, schema)

    def histograms(self, views: list[np.ndarray], rules: list[list[Rule]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The bins in order and their counts, for either view, over the rows that it has not labelled yet."""

        def run(styles: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
            left = [given(v, rules[v], styles, places) < 0 for v in (0, 1)]
            found = [np.unique(_binned(v, styles[left[v]], places[left[v]], views[v]), return_counts=True) for v in (0, 1)]
            view = np.repeat([0, 1], [len(b) for b, _ in found])
            bins, counts = (np.concatenate(c) for c in zip(*found, strict=True))
            return pa.record_batch([pa.array(view, pa.int32()), pa.array(bins, pa.int32()), pa.array(counts, pa.int64())], names=["view", "bin", "n"])

        rows = self.each("view int, bin int, n long", run).groupBy("view", "bin").agg(F.sum("n").alias("n")).orderBy("view", "bin").toArrow()
        view, bins, n = (rows.column(c).to_numpy() for c in ("view", "bin", "n"))
        return [(bins[view == v], n[view == v]) for v in (0, 1)]

    def metadata_counts(self, rules: list[Rule]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct metadata with labels given by the text view, the labels, and how many rows each has."""

        def run(styles: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
            label = given(0, rules, styles, places)
            found, counts = np.unique(np.column_stack([places, label])[label >= 0], axis=0, return_counts=True)
            return pa.record_batch([pa.array(found[:, i], pa.int32()) for i in range(4)] + [pa.array(counts, pa.int64())], names=["a", "b", "c", "label", "n"])

        keys = ["a", "b", "c", "label"]
        rows = self.each("a int, b int, c int, label int, n long", run).groupBy(*keys).agg(F.sum("n").alias("n")).orderBy(*keys).toArrow()
        a, b, c, label, n = (rows.column(x).to_numpy() for x in (*keys, "n"))
        return np.column_stack([a, b, c]).astype(int), label.astype(float), n.astype(float)

    def text_derivatives(self, rules: list[Rule], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slope and curvature of the text view at ``w`` over all rows with labels given by the metadata view."""

        def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((TEXT + 1, TEXT))
            for batch in found:
                if batch.num_rows:
                    styles, places = _arrays(batch)
                    label = given(1, rules, styles, places)
                    at = label >= 0
                    slope, curve = derivatives(styles[at], label[at], np.ones(int(at.sum())), w)
                    total[0] += slope
                    total[1:] += curve
            yield pa.record_batch([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["total"])

        parts = self.rows.mapInArrow(batches, "total array<double>").toArrow().column("total")
        total = sum((np.asarray(x.values) for x in parts), np.zeros((TEXT + 1) * TEXT)).reshape(TEXT + 1, TEXT)
        return total[0], total[1:]


def rule(w: np.ndarray, bins: np.ndarray, counts: np.ndarray, share: float) -> Rule:
    """Up to which bin a view is sure that rows are bad, and from which that they are good."""
    n = int(counts.sum())
    take = max(1, int(CONFIDENT * n))
    bad = max(1, round(take * (1 - share)))
    lowest = int(bins[np.searchsorted(np.cumsum(counts), min(bad, n))])
    # Sure of a class means beyond what the labelled rows of that class show on average.
    highest = max(int(bins[::-1][np.searchsorted(np.cumsum(counts[::-1]), take - bad)]), int(np.ceil(_logit(np.array(share)) * BINS))) if take > bad else np.inf
    return w, min(lowest, -1), highest


class CoTrained:
    """Weights of both views, their calibrations (slope, offset) and of their combination."""

    def __init__(self, views: list[np.ndarray], calibrations: list[tuple[float, float]], combined: np.ndarray):
        self.views, self.calibrations, self.combined = views, calibrations, combined

    @classmethod
    def constant(cls, share: float) -> CoTrained:
        """The same score for all documents."""
        offset = float(_logit(np.array(share)))
        return cls([np.zeros(TEXT), np.zeros(METADATA + 1)], [(0.0, 0.0)] * 2, np.array([0.0, 0.0, offset]))

    @classmethod
    def fitted(cls, labelled: tuple[np.ndarray, np.ndarray], labels: np.ndarray, unlabelled: Callable[[], Pool]) -> CoTrained:
        """Co-trains on four of five labelled rows and all unlabelled ones, calibrates on the fifth."""
        n, good = len(labels), int(labels.sum())
        if not 0 < good < n:
            return cls.constant((good + 0.5) / (n + 1) if n else 0.5)
        apart = np.arange(n) % 5 == 0
        if not 0 < labels[~apart].sum() < (~apart).sum() or not 0 < labels[apart].sum() < apart.sum():
            apart = np.zeros(n, bool)
        train = [x[~apart] for x in labelled]
        y = labels[~apart]
        pool = unlabelled()
        rules: list[list[Rule]] = [[], []]
        views = [logistic(x, y) for x in train]
        for _ in range(ROUNDS):
            ranked = pool.histograms(views, rules)
            if not len(ranked[0][0]) and not len(ranked[1][0]):
                break
            for view in (0, 1):
                if len(ranked[view][0]):
                    rules[view].append(rule(views[view], *ranked[view], float(y.mean())))
            places, taught, n = pool.metadata_counts(rules[0])
            views = [
                logistic(train[0], y, more=lambda w: pool.text_derivatives(rules[1], w), start=views[0]),
                logistic(np.concatenate([train[1], one_hot(places)]), np.concatenate([y, taught]), np.concatenate([np.ones(len(y)), n])),
            ]
        held = [x[apart] if apart.any() else x for x in labelled]
        truth = labels[apart] if apart.any() else labels
        calibrations, calibrated = [], []
        for x, w in zip(held, views, strict=True):
            z = x @ w
            slope, offset = logistic(np.stack([z, np.ones(len(z))], 1), truth, ridge=0.1)
            calibrations.append((float(slope), float(offset)))
            calibrated.append(slope * z + offset)
        combined = logistic(np.stack([*calibrated, np.ones(len(truth))], 1), truth, ridge=0.1)
        return cls(views, calibrations, combined)

    def scores(self, styles: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated text score, calibrated metadata score, combined score."""
        z = [a * (x @ w) + b for x, w, (a, b) in zip((styles, one_hot(places)), self.views, self.calibrations, strict=True)]
        return _sigmoid(z[0]), _sigmoid(z[1]), _sigmoid(z[0] * self.combined[0] + z[1] * self.combined[1] + self.combined[2])


def _one_row(rows: DataFrame) -> DataFrame:
    """One row of each doc_id: of several, the one whose vectors come first in order, whichever task is run again."""
    others = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.min(F.struct(*others)).alias("_row")).select("doc_id", *(F.col(f"_row.{c}").alias(c) for c in others)).select(rows.columns)


def fit(rows: DataFrame, labels: DataFrame) -> CoTrained:
    """A model co-trained over a bounded sample of the labelled vectors and all unlabelled ones that are not held out.

    A row of ``labels`` without a quality is no label: its document is unlabelled.
    """
    wanted = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(HELD_OUT))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("quality").cast("int")).alias("label"))
    )
    chosen = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    sample = _one_row(rows.join(F.broadcast(chosen), "doc_id")).toArrow().sort_by("doc_id")
    styles, places = _arrays(sample)

    def unlabelled() -> Pool:
        left = rows.where("doc_id is not null").where(~held_out(HELD_OUT))
        known = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"))
        return Pool(stored(_one_row(left.join(known, "doc_id", "left_anti"))))

    return CoTrained.fitted((styles, one_hot(places)), np.array(sample.column("label").to_pylist(), float), unlabelled)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_score, metadata_score, score and kept of every row of ``docs``."""
    rows = stored(vectors(docs))
    sent = docs.sparkSession.sparkContext.broadcast(fit(rows, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text, meta, both = sent.value.scores(*_arrays(batch))
                yield pa.record_batch([batch.column("doc_id"), pa.array(text), pa.array(meta), pa.array(both), pa.array(both >= THRESHOLD)], names=["doc_id", "text_score", "metadata_score", "score", "kept"])

    return rows.mapInArrow(run, "doc_id long, text_score double, metadata_score double, score double, kept boolean")
