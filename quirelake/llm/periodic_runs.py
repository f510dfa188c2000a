"""Periodic runs of words by heavy/light lag counting.

A run is a stretch of words with smallest period ``q`` and a length of at
least ``max(LEAST_LENGTH, LEAST_POWER * q)`` that no neighbouring word extends.
For each lag the words that equal the word so far behind are counted: exact FFT
autocorrelation for frequent words, differences of positions for rare ones.
Only a lag with as many matches as one run of that period must have is
scanned for islands of matches.

Two exact shortcuts keep ordinary texts cheap and adversarial ones bounded:

* both ends of a run repeat ``WINDOW`` words at its period's distance, so every word
  of a run lies in a window of that width that occurs twice in the text.  Lags
  are counted inside stretches of such words alone (found by hashes of
  exact word numbers; a collision only adds work);
* an island as long as asked for holds a whole block of an aligned grid of half
  its length.  Prefix hashes compare the blocks of a lag, matches are extended
  word by word, and what lies in a run whose period divides the lag is passed over.

Each text is read by one task, whole; tasks share nothing, so a lost executor
costs its own tasks only.

Defined results: null and empty texts, and texts without words, have no runs
and an empty collapsed text; a null doc_id stays null; repeated rows get repeated
results; an empty table gives an empty result; columns other than doc_id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Words of a run at least, and periods of a run at least.
LEAST_LENGTH, LEAST_POWER = 24, 3
#: Words that a run of any period repeats at least: LEAST_LENGTH - 8, where 2 * 8 periods take over.
WINDOW = 16
_SLICE = 16_000_000
_K = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)

Run = tuple[int, int, int]
#: From (doc_id, number of words) to (first word, period) of a tail that is to repeat, or None.
Tail = Callable[[int, int], "tuple[int, int] | None"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _M
    return x ^ (x >> np.uint64(32))


def _least_matches(lag: np.ndarray | int) -> np.ndarray | int:
    """Consecutive matches at a lag that a run of that period has at least."""
    return np.maximum(LEAST_LENGTH - lag, (LEAST_POWER - 1) * lag)


def lag_counts(codes: np.ndarray, most: int) -> np.ndarray:
    """For each lag up to ``most``, how many words equal the word so far behind them; codes are 0, 1, ..."""
    n = len(codes)
    counts = np.zeros(most + 1, np.int64)
    size = 1 << int(n + most).bit_length()
    occurrences = np.bincount(codes)
    # A word is frequent where its pairs cost more than its transform.
    heavy = occurrences.astype(np.int64) * (occurrences - 1) > 8 * size
    if heavy.any():
        power = np.zeros(size // 2 + 1)
        for word in np.flatnonzero(heavy):
            spectrum = np.fft.rfft((codes == word).astype(float), size)
            power += spectrum.real**2 + spectrum.imag**2
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    at = np.flatnonzero(~heavy[codes])
    at = at[np.argsort(codes[at], kind="stable")]
    word = codes[at]
    left = np.arange(len(at))
    step = 1
    while len(left := left[left + step < len(at)]):
        far = at[left + step]
        near = (word[left] == word[left + step]) & (far - at[left] <= most)  # later ones are farther still
        left = left[near]
        counts += np.bincount(far[near] - at[left], minlength=most + 1)
        step += 1
    counts[0] = n
    return counts


def _first_difference(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading entries agree, read in growing parts."""
    n, done, step = min(len(a), len(b)), 0, 64
    while done < n:
        end = min(n, done + step)
        differ = np.flatnonzero(a[done:end] != b[done:end])
        if len(differ):
            return done + int(differ[0])
        done, step = end, 2 * step
    return n


def runs_of(codes: np.ndarray) -> list[Run]:
    """(start, length, period) of every run, by start, then period."""
    n = len(codes)
    most = n // LEAST_POWER
    if n < LEAST_LENGTH:
        return []
    _, codes = np.unique(codes, return_inverse=True)
    lags = np.arange(most + 1)
    enough = np.flatnonzero(lag_counts(codes, most) >= _least_matches(lags))
    enough = enough[enough > 0]
    if not len(enough):
        return []
    # Prefix sums of word numbers times powers: a block's hash times a power of its place.
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _K, np.uint64)]), dtype=np.uint64)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(1)) * powers[:n], dtype=np.uint64)])
    found: list[Run] = []
    by_period: dict[int, list[tuple[int, int]]] = {}
    for lag in enough.tolist():
        least = int(_least_matches(lag))
        block = (least + 1) // 2
        at = np.arange(0, n - lag - block + 1, block)
        same = (prefix[at + block] - prefix[at]) * powers[lag] == prefix[at + lag + block] - prefix[at + lag]
        at = at[same]
        for period, places in by_period.items():
            if len(at) and lag % period == 0:
                begins, ends = np.array(places).T  # of one period: both ascend
                k = np.searchsorted(begins, at, "right") - 1
                at = at[(k < 0) | (ends[k] < at + block + lag)]
        past = 0
        places = []
        for j in at.tolist():
            if j < past:
                continue
            right = j + _first_difference(codes[j : n - lag], codes[j + lag :])
            left = j - _first_difference(codes[j + lag - 1 : lag - 1 if lag else None : -1], codes[:j][::-1]) if j else 0
            past = max(past, right)
            if right - left >= least:
                places.append((left, right + lag))
                found.append((left, right + lag - left, lag))
        if places:
            by_period[lag] = places
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[Run]) -> Run | None:
    """The run of most periods, exactly; ties go to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _stretches(codes: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Places where each word lies in a window that occurs twice in its document; documents end at ``ends``."""
    n = len(codes)
    if n < LEAST_LENGTH:
        return []
    import pandas as pd

    sizes = np.diff(ends, prepend=0)
    document = np.repeat(np.arange(len(ends)), sizes)
    starts = n - WINDOW + 1
    hashes = _mixed(codes.astype(np.uint64) + np.uint64(1))
    width = 1
    while width < WINDOW:
        hashes = _mixed(hashes[:-width] * _K + hashes[width:])
        width *= 2
    inside = np.flatnonzero(document[:starts] == document[WINDOW - 1 :])
    keys = hashes[inside] ^ _mixed(document[inside].astype(np.uint64) * _K)
    twice = inside[pd.Series(keys).duplicated(keep=False).to_numpy()]
    if not len(twice):
        return []
    # Windows of one document that overlap or touch are one stretch.
    cut = (np.diff(twice) > WINDOW) | (document[twice[1:]] != document[twice[:-1]])
    begins = twice[np.concatenate([[True], cut])]
    return [(b, e) for b, e in zip(begins.tolist(), (twice[np.concatenate([cut, [True]])] + WINDOW).tolist(), strict=True) if e - b >= LEAST_LENGTH]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words, their numbers (equal words, equal numbers), and where each text's words end."""
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten()
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
    filled = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    words = words.filter(filled).dictionary_encode()
    return words.dictionary, words.indices.to_numpy().astype(np.int64), kept[offsets[1:]].astype(np.int64)


def periodic_runs(docs: DataFrame, *, tail: Tail | None = None) -> DataFrame:
    """doc_id, n_words, runs, strongest and collapsed of every row of ``docs``.

    ``runs`` are structs of start, length and period by start, then period;
    ``strongest`` is the one of most periods (null without runs).  ``collapsed`` is
    the text without the words that repeat their run's first period, words
    joined by one space.  ``tail`` lets the end of a document repeat first, as tests of
    the detector want it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", _SLICE):
                texts = pc.fill_null(piece.column("text"), "")
                dictionary, codes, ends = _words(texts)
                if tail is not None:
                    begin = 0
                    for doc_id, end in zip(piece.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                        repeats = tail(doc_id, end - begin) if doc_id is not None and end > begin else None
                        if repeats is not None:
                            first, period = begin + repeats[0], repeats[1]
                            codes[first:end] = codes[first + np.arange(end - first) % period]
                        begin = end
                runs: list[Run] = []
                best: list[Run | None] = [None] * len(ends)
                owners: list[int] = []
                dropped = np.zeros(len(codes) + 1, np.int64)
                by_document: dict[int, list[Run]] = {}
                for b, e in _stretches(codes, ends):
                    k = int(np.searchsorted(ends, b, "right"))
                    origin = b - (int(ends[k - 1]) if k else 0)
                    for start, length, period in runs_of(codes[b:e]):
                        by_document.setdefault(k, []).append((origin + start, length, period))
                        dropped[b + start + period] += 1
                        dropped[b + start + length] -= 1
                for k in sorted(by_document):
                    mine = sorted(by_document[k], key=lambda r: (r[0], r[2]))
                    runs += mine
                    owners += [k] * len(mine)
                    best[k] = strongest(mine)
                keep = np.cumsum(dropped[:-1]) == 0
                kept_ends = np.concatenate([[0], np.cumsum(keep)])[ends]
                words = dictionary.take(pa.array(codes[keep]))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], kept_ends]), pa.int32()), words)
                struct = pa.struct([(f, pa.int64()) for f in ("start", "length", "period")])
                each = pa.array([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], struct)
                counts = np.bincount(np.array(owners, np.int64), minlength=len(ends))
                yield pa.record_batch(
                    [
                        piece.column("doc_id"),
                        pa.array(np.diff(ends, prepend=0), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), each),
                        pa.array([r and dict(zip(("start", "length", "period"), r, strict=True)) for r in best], struct),
                        pc.binary_join(lists, ""  if not len(words) else " ").cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "strongest", "collapsed"],
                )

    one = "struct<start: long, length: long, period: long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id long, n_words long, runs array<{one}>, strongest {one}, collapsed string"
    )


def _listed(runs: Column) -> Column:
    """``start,length,period`` and a line feed for each run."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")


def run_digests(found: DataFrame) -> DataFrame:
    """The strongest run and digests of runs and collapsed text, from ``periodic_runs``."""
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(_listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
        "n_words",
    )
