"""Embedding whitening by the singular values of centred distributed rows.

The entries become integers ``floor(scale * c)``; the fit list holds each
distinct integer vector once.  Sums, and so the mean, are exact.  Rows are centred as
``(n * x - S) / n`` (an exact integer, rounded once by the division) and MLlib's
``computeSVD`` decomposes the distributed matrix of the centred fit list: its
squared singular values over ``n`` are the eigenvalues of the covariance with
divisor ``n``, its right singular vectors the components.  All singular
values are asked for, for which MLlib takes LAPACK on the Gram matrix of the centred rows
instead of an iterative method with a tolerance.  The total variance comes from
the exact deviations, not from the singular values.

What the driver holds grows with the dimension alone: sums and extremes of each
dimension and the components.  The fit list is made by an aggregation, so that a
vector that a third of all rows share is combined before the shuffle, and written to
the shared folder, as several passes read it.

Defined results: rows whose vector is null, empty, or holds a null or
non-finite entry go, as do rows whose vector has another length than most (ties:
the longer) of the rest; components without variance (up to rounding: a singular value below
``LEAST_SHARE`` of the greatest) have no rows, so that a table whose vectors are all the same
gives an empty result, as an empty one does; repeated rows and
null vec_ids get rows of their own; a deviation beyond 64 bits is null; entries beyond
64 bits become the nearest 64-bit number; columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

COMPONENTS = 4
SCALE = 256
#: Singular values below this share of the greatest are zero but for rounding.
LEAST_SHARE = 1e-7
#: MLlib decomposes Gram matrices of up to so many dimensions by LAPACK.
_DENSE = 15_000
_LONG = 1 << 63


def integer_vectors(embeddings: DataFrame, *, scale: int = SCALE) -> DataFrame:
    """vec_id and x of the rows whose vector is whole and finite."""
    c = F.col("embedding").cast("array<double>")
    plain = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    whole = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(plain & F.forall(c, finite), c).alias("c")).where("c is not null")
    return whole.select("vec_id", F.transform("c", lambda e: F.floor(e * F.lit(float(scale))) + F.lit(0).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(fit: DataFrame) -> tuple[int, list[int], int]:
    """Rows, the exact sum of each dimension, and the greatest absolute entry: one row a dimension reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, most = 0, None, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                here = max(int(x.max()), -int(x.min()))
                part = x.sum(0).tolist() if here * len(x) < _LONG else x.astype(object).sum(0).tolist()
                sums = part if sums is None else [a + b for a, b in zip(sums, part, strict=True)]
                n, most = n + len(x), max(most, here)
        if n:
            d = len(sums)
            yield pa.record_batch(
                [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(s) for s in sums]), pa.array([str(most)] * d)], names=["dimension", "n", "total", "most"]
            )

    parts = fit.select("x").mapInArrow(add, "dimension int, n long, total string, most string")
    wide = "decimal(38,0)"
    rows = parts.groupBy("dimension").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast(wide)).cast("string").alias("total"), F.max(F.col("most").cast(wide)).cast("string").alias("most")).collect()
    rows.sort(key=lambda r: r["dimension"])
    return (rows[0]["n"], [int(r["total"]) for r in rows], int(rows[0]["most"])) if rows else (0, [], 0)


def _offsets(x: np.ndarray, n: int, sums: list[int], most: int) -> np.ndarray:
    """n * x - S, exact: 64-bit numbers where they are wide enough, else Python's."""
    if n * most + max(map(abs, sums), default=0) < _LONG:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _centred(offsets: np.ndarray, n: int) -> np.ndarray:
    """offsets / n, each rounded once."""
    if offsets.dtype == np.int64 and len(offsets) and np.abs(offsets).max() < 1 << 53:
        return offsets / float(n)
    return np.array([[v / n for v in row] for row in offsets.astype(object).tolist()]).reshape(offsets.shape)


def _deviations(offsets: np.ndarray) -> list[int]:
    """The sum of the squared offsets of each row, exact."""
    if offsets.dtype == np.int64 and len(offsets):
        top = int(np.abs(offsets).max())
        if top * top * offsets.shape[1] < _LONG:
            return (offsets * offsets).sum(1).tolist()
    return [sum(v * v for v in row) for row in offsets.astype(object).tolist()]


def whitened(embeddings: DataFrame, *, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row and component."""
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integer_vectors(embeddings, scale=scale)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dimension = lengths[0]["d"]
    rows = rows.where(F.size("x") == dimension)
    fit = stored(rows.select("x").distinct())
    n, sums, most = _sums(fit)

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _centred(_offsets(_matrix(batch.column("x")), n, sums, most), n)
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * dimension, pa.int32()), pa.array(rows.ravel()))], names=["c"])

    vectors = fit.select("x").mapInArrow(centre, "c array<double>").select(array_to_vector("c").alias("v"))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"), n, dimension)
    svd = matrix.computeSVD(dimension if dimension <= _DENSE else components, computeU=False, rCond=LEAST_SHARE) if n > 1 else None
    if svd is None:
        return spark.createDataFrame([], schema)
    values = svd.s.toArray()[:components] ** 2 / n
    values = values[values > 0]
    if not len(values):
        return spark.createDataFrame([], schema)
    axes = svd.V.toArray()[:, : len(values)]
    scaled = axes / np.sqrt(values)
    names = [f"w{k}" for k in range(len(values))]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                offsets = _offsets(_matrix(batch.column("x")), n, sums, most)
                out = _centred(offsets, n) @ scaled
                yield pa.record_batch([batch.column("vec_id"), pa.array([str(v) for v in _deviations(offsets)]), *(pa.array(np.ascontiguousarray(c)) for c in out.T)], names=["vec_id", "deviation", *names])

    project_schema = "vec_id long, deviation string, " + ", ".join(f"{w} double" for w in names)
    wide = "decimal(38,0)"
    fitted = fit.select(F.lit(None).cast("long").alias("vec_id"), "x").mapInArrow(project, project_schema)
    pairs = [(a, b) for a in range(len(names)) for b in range(a + 1)]
    summary = fitted.agg(F.sum(F.col("deviation").cast(wide)).cast("string").alias("deviation"), *(F.covar_pop(names[a], names[b]).alias(f"c{a}_{b}") for a, b in pairs)).first()
    error = max(abs(summary[f"c{a}_{b}"] - (a == b)) for a, b in pairs)
    variance = float(Fraction(int(summary["deviation"]), n**3))
    each = rows.mapInArrow(project, project_schema)
    parts = F.posexplode(F.array(*(F.struct(F.col(w).alias("w"), F.lit(float(v / variance)).alias("share")) for w, v in zip(names, values, strict=True))))
    return each.select("vec_id", F.expr("try_cast(deviation as long)").alias("deviation"), parts.alias("at", "_p")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.col("_p.w").alias("whitened"),
        F.col("_p.share").alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )

