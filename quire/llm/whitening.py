"""Operator 13: whitening of embeddings by leading components found with contour integration.

Spark gathers what grows with the data: exact sums of each dimension, then the sums of products of centred
entries, from one partial sum a task. The matrix that is left has a row for each dimension and no more; its leading
eigenpairs come from `contour.leading`. Then each vector is projected where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import contour
from quire.llm.common import own_columns, slices, written

#: Entries become whole numbers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries so large that their whole number is no longer exact among sums count as not finite.
LARGEST = float(1 << 34)
COMPONENTS = 8
ROWS_EACH = 1024


@dataclass
class Fit:
    n: int
    sums: list[int]  # of the whole numbers, each dimension
    values: np.ndarray
    vectors: np.ndarray  # a column for each component
    trace: float


def _whole(batch: pa.RecordBatch, d: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, whole numbers) of the usable vectors of a batch, for each length (or for d alone)."""
    column = batch.column("embedding")
    length = pc.list_value_length(column)
    for n in [d] if d is not None else pc.unique(length).drop_null().to_pylist():
        rows = np.flatnonzero(pc.fill_null(pc.equal(length, n), False).to_numpy(zero_copy_only=False))
        if not n or not len(rows):
            continue
        flat = column.take(pa.array(rows)).flatten()
        entries = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, n)
        good = (np.abs(entries) < LARGEST).all(axis=1)  # false for nulls and NaN too
        yield rows[good], np.floor(SCALE * entries[good]).astype(np.int64) + SHIFT


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of usable vectors of the greatest length that occurs, and the exact sum of each of their dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in slices(batches, ROWS_EACH):
            for rows, whole in _whole(batch):
                n, sums = total.setdefault(whole.shape[1], [0, [0] * whole.shape[1]])
                total[whole.shape[1]] = [n + len(rows), [a + b for a, b in zip(sums, whole.sum(axis=0).tolist())]]
        for d, (n, sums) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * (d + 1), pa.int32()), pa.array(range(-1, d), pa.int32()), pa.array([Decimal(x) for x in [n, *sums]], pa.decimal128(28, 0))],
                names=["d", "at", "total"],
            )

    parts = vectors.select("embedding").mapInArrow(run, "d int, at int, total decimal(28,0)")
    found = written(parts.groupBy("d", "at").agg(F.sum("total").alias("total")), "sums")
    longest = found.where("at = -1 and total > 0").agg(F.max("d")).first()[0]
    if longest is None:
        return 0, []
    rows = found.where(F.col("d") == longest).orderBy("at").collect()  # one row for each dimension
    return int(rows[0]["total"]), [int(r["total"]) for r in rows[1:]]


def _covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of the whole numbers, divisor n, from entries centred at the whole number next to the mean."""
    d = len(sums)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in slices(batches, ROWS_EACH):
            for _, whole in _whole(batch, d):
                z = (whole - centre).astype(float)
                total += z.T @ z
        i, j = np.triu_indices(d)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "total"])

    rows = vectors.select("embedding").mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    v = np.zeros((d, d))
    for r in rows:
        v[r["i"], r["j"]] = v[r["j"], r["i"]] = r["total"] / n
    off = np.array([float(s - n * int(c)) / n for s, c in zip(sums, centre)])  # at most 1/2 each
    return v - np.outer(off, off)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit:
    """Sums, covariance and leading components of the usable vectors in column `embedding`."""
    n, sums = _sums(vectors)
    if not n:
        return Fit(0, [], np.empty(0), np.empty((0, 0)), 0.0)
    v = _covariance(vectors, n, sums)
    return Fit(n, sums, *contour.leading(v, components), float(np.trace(v)))


def _deviation(whole: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """n*x - S as floats, and the exact sum of its squares (None if it is no long)."""
    high = float(np.abs(whole).max(initial=0)) * n + max(map(abs, sums))
    if high < 2.0**62:
        part = whole * n - np.array(sums, np.int64)
        if float(np.abs(part).max(initial=0)) ** 2 * len(sums) < 2.0**62:
            return part.astype(float), (part * part).sum(axis=1).tolist()
    part = whole.astype(object) * n - np.array(sums, object)
    exact = (part * part).sum(axis=1)
    return part.astype(float), [x if x < 1 << 63 else None for x in exact]


def project(vectors: DataFrame, model: Fit) -> DataFrame:
    """(vec_id, deviation, whitened array<double>) for each usable vector."""
    d, n, sums = len(model.sums), model.n, model.sums
    turn = model.vectors / np.sqrt(model.values) if n else model.vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS_EACH):
            for rows, whole in _whole(batch, d):
                part, deviation = _deviation(whole, n, sums)
                white = part / n @ turn
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(rows)),
                        pa.array(deviation, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * turn.shape[1]), pa.array(white.ravel())),
                    ],
                    names=["vec_id", "deviation", "whitened"],
                )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return own_columns(vectors, ("vec_id", "embedding")).mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(projected: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of `whitened` minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            white = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            total[:k] += white.T @ white
            total[k] += white.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "total"])

    got = np.zeros((k + 1, k))
    for r in projected.select("whitened").mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        got[r["i"], r["j"]] = r["total"] / n
    mean = got[k]  # next to zero, since the entries were centred before they were projected
    return float(np.abs(got[:k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each usable vector and component.

    Vectors that are null, empty or hold null or non-finite entries (or entries beyond 2^34) are dropped, and where lengths
    differ all but the greatest length. Components whose variance is below 1e-12 of the whole are none, so equal
    vectors alone, one vector, or an empty table give no row. Repeated and null ids are rows of their own.
    `deviation` is null where the exact sum is no long. Other columns are not read.
    """
    model = fit(vectors, components)
    k = len(model.values)
    done = written(project(vectors, model), "whitened")
    error = identity_error(done, model.n, k) if k else 0.0
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values]) if k else F.array().cast("array<double>")
    each = done.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained") if k else F.lit(None).cast("double").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
