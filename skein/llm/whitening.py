"""Whitening of embeddings: covariance by Welford's updates, components by the symmetric QR algorithm.

Entries are quantised to whole numbers first, and the fit list holds each distinct vector once. Each partition of the list
updates a mean and a centred matrix of products by one vector at a time (a rank-one update); states of partitions are merged by
the parallel formula, a group of FAN at a time, until one is left. That one, D by D for vectors of D entries, is all that the
driver sees: it is reduced to tridiagonal form and diagonalised by implicit QR steps. Rows are then projected where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import release, written

#: Fixed values of the contract: steps of the quantisation, components that are returned.
STEPS, COMPONENTS = 256, 4

#: States that are merged in one task.
FAN = 64

#: An eigenvalue of no more than this share of the largest one is rounding: nothing is divided by it.
NO_VARIANCE = 1e-12

#: Whole numbers below this are safe from overflow in int64 sums of products.
SAFE = float(1 << 62)


class State:
    """Count, mean, centred sum of products and exact sum of vectors."""

    def __init__(self, n: int, mean: np.ndarray, m2: np.ndarray, total: list[int]):
        self.n, self.mean, self.m2, self.total = n, mean, m2, total

    @classmethod
    def none(cls, d: int) -> State:
        return cls(0, np.zeros(d), np.zeros((d, d)), [0] * d)

    def add(self, rows: np.ndarray) -> None:
        """Welford's update for each row in turn: centred by the mean before it and by the mean after it."""
        step = np.empty_like(self.m2)
        for x in rows.astype(np.float64):
            self.n += 1
            before = x - self.mean
            self.mean += before / self.n
            np.multiply.outer(before, x - self.mean, out=step)
            self.m2 += step
        if rows.dtype.kind != "f":
            exact = rows if not len(rows) or float(np.abs(rows.astype(np.float64)).max()) * len(rows) < SAFE else rows.astype(object)
            self.total = [a + int(b) for a, b in zip(self.total, exact.sum(axis=0))]

    def merge(self, other: State) -> None:
        """The parallel formula: the means' difference, weighed by both counts, joins the two sums."""
        n = self.n + other.n
        if other.n:
            apart = other.mean - self.mean
            self.m2 += other.m2 + np.multiply.outer(apart, apart) * (self.n * other.n / n)
            self.mean += apart * (other.n / n)
        self.n, self.total = n, [a + b for a, b in zip(self.total, other.total)]

    def covariance(self) -> np.ndarray:
        return (self.m2 + self.m2.T) / (2 * max(self.n, 1))


_STATE = "at long, n long, mean array<double>, m2 array<double>, total array<string>"


def _vectors(column: pa.Array, d: int, kind) -> np.ndarray:
    """A column of lists of d numbers, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), d)


def _row(at: int, s: State) -> pa.RecordBatch:
    cols = [pa.array([at]), pa.array([s.n]), pa.array([s.mean]), pa.array([s.m2.reshape(-1)]), pa.array([[str(t) for t in s.total]], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(cols, names=["at", "n", "mean", "m2", "total"])


def _state(r, d: int) -> State:
    return State(int(r.n), np.array(r.mean, np.float64), np.array(r.m2, np.float64).reshape(d, d), [int(t) for t in r.total])


def moments(vectors: DataFrame, d: int) -> State:
    """Count, mean, covariance and sums of the one column of vectors (arrays of d numbers, no null)."""
    kind = np.float64 if "double" in vectors.dtypes[0][1] else np.int64

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = State.none(d)
        for b in batches:
            state.add(_vectors(b.column(0), d, kind))
        if state.n:
            yield _row(0, state)
        release()

    def merge(key, rows: pd.DataFrame) -> pd.DataFrame:
        state = State.none(d)
        for r in rows.sort_values("at").itertuples():
            state.merge(_state(r, d))
        return _row(int(key[0]), state).to_pandas()

    states = vectors.mapInArrow(update, _STATE).withColumn("at", F.monotonically_increasing_id())
    states = written(states, "moments")
    while (n := states.count()) > FAN:
        groups = -(-n // FAN)
        states = written(states.groupBy(F.pmod(F.xxhash64("at"), F.lit(groups)).alias("g")).applyInPandas(merge, _STATE), "moments")
    last = State.none(d)
    for r in sorted(states.collect(), key=lambda r: r.at):  # at most FAN states
        last.merge(_state(r, d))
    return last


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """diagonal, off-diagonal and q with a = q t q': Householder reflections, a column at a time."""
    t, n = a.astype(np.float64).copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = t[k + 1 :, k]
        if not x[1:].any():
            continue
        length, v = np.linalg.norm(x), x.copy()
        v[0] += length if x[0] >= 0 else -length
        v /= np.sqrt(v @ v)
        low = t[k + 1 :, k + 1 :]
        w = low @ v
        w -= v * (v @ w)
        low -= 2 * (np.multiply.outer(v, w) + np.multiply.outer(w, v))
        t[k + 1, k] = t[k, k + 1] = -length if x[0] >= 0 else length
        t[k + 2 :, k] = t[k, k + 2 :] = 0
        q[:, k + 1 :] -= 2 * np.multiply.outer(q[:, k + 1 :] @ v, v)
    return np.diag(t).copy(), np.diag(t, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns: QR steps with Wilkinson's shift on the tridiagonal form.

    The bulge that a shift makes is chased down by rotations, which also turn the vectors; an off-diagonal entry that has
    become small beside its neighbours splits the problem.
    """
    d, e, q = tridiagonal(a)
    hi, eps = len(d) - 1, np.finfo(np.float64).eps
    least = eps * eps * np.abs(d).max(initial=0)
    while hi > 0:
        small = eps * (np.abs(d[:-1]) + np.abs(d[1:])) + least
        e[np.abs(e) <= small] = 0.0
        if e[hi - 1] == 0:
            hi -= 1
            continue
        zeros = np.flatnonzero(e[: hi - 1] == 0)
        lo = int(zeros[-1]) + 1 if len(zeros) else 0
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k] = c * c * dk + 2 * c * s * ek + s * s * dn
            d[k + 1] = s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k < hi - 1:
                z = s * e[k + 1]
                e[k + 1] *= c
                x = e[k]
            left = q[:, k].copy()
            q[:, k] = c * left + s * q[:, k + 1]
            q[:, k + 1] = c * q[:, k + 1] - s * left
    order = np.argsort(-d, kind="stable")
    return d[order], q[:, order]


def quantised(table: DataFrame, id_col: str, vector_col: str, steps: int) -> DataFrame:
    """vec_id, x: the rows whose vector is whole and finite, as whole numbers; vectors shorter than the longest end in zeros."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    return table.where(fine).select(F.col(id_col).alias("vec_id"), F.transform(v, lambda c: F.floor(c * steps).cast("long")).alias("x"))


def _padded(x, d: int):
    return F.when(F.size(x) == d, F.col(x)).otherwise(F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size(x)))).alias(x)


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n x - total, exact: int64 where nothing can overflow, else Python's whole numbers."""
    far = float(np.abs(x.astype(np.float64)).max(initial=0)) * n + float(np.abs(total.astype(np.float64)).max(initial=0))
    if far < SAFE and far * far * x.shape[1] < SAFE:
        return x * n - total.astype(np.int64)
    return x.astype(object) * n - total


def _turned(apart: np.ndarray, n: int, turn: np.ndarray) -> np.ndarray:
    return (apart.astype(np.float64) / max(n, 1)) @ turn


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, steps: int = STEPS) -> DataFrame:
    """A row for each row with a whole, finite vector and each component: vec_id, component, n, deviation, whitened, explained,
    identity_error.

    The fit counts each distinct quantised vector once. Vectors of fewer entries than the longest count as ending in zeros; of
    fewer entries than components, there are as many components as entries (at least one, so that no row is lost). A component
    along which nothing varies (a single distinct vector, say) has a null whitened and no part in identity_error; explained is
    0 if nothing varies at all. A deviation beyond a long is null. Repeated rows each give their rows, a null id stays null,
    other columns are ignored. A table without such a vector gives an empty result.
    """
    rows = written(quantised(table, id_col, vector_col, steps), "vectors")
    d = rows.agg(F.max(F.size("x"))).first()[0]
    d = max(d or 0, 1)
    rows = rows.select("vec_id", _padded("x", d))
    fit = written(rows.select("x").distinct(), "fit")
    state = moments(fit, d)
    values, vectors = symmetric_qr(state.covariance())
    used = min(components, d)
    live = [k for k in range(used) if values[k] > NO_VARIANCE * abs(values).max()]
    scale = np.array([1 / np.sqrt(values[k]) if k in live else 0.0 for k in range(used)])
    turn, n, total = vectors[:, :used] * scale, state.n, np.array(state.total, object)
    trace = float(np.trace(state.covariance()))
    explained = [float(values[k]) / trace if trace > 0 else 0.0 for k in range(used)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(_turned(_centred(_vectors(b.column(0), d, np.int64), n, total), n, turn)), pa.list_(pa.float64()))], names=["y"])

    check = moments(fit.mapInArrow(project, "y array<double>"), used).covariance()[np.ix_(live, live)]
    error = float(np.abs(check - np.eye(len(live))).max(initial=0))
    kind = rows.schema["vec_id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apart = _centred(_vectors(b.column(1), d, np.int64), n, total)
            square = (apart * apart).sum(axis=1)
            far = [None if s > np.iinfo(np.int64).max else int(s) for s in square] if square.dtype == object else square
            y = _turned(apart, n, turn)
            for k in range(used):
                own = pa.array(y[:, k]) if k in live else pa.nulls(b.num_rows, pa.float64())
                fixed = [pa.array(np.full(b.num_rows, v)) for v in (explained[k], error)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.full(b.num_rows, k + 1, np.int32)), pa.array(np.full(b.num_rows, n, np.int64)), pa.array(far, pa.int64()), own, *fixed],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )
        release()

    return rows.mapInArrow(emit, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
