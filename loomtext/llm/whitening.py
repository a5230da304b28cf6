"""Embedding whitening: principal components by Golub-Kahan-Lanczos bidiagonalisation, rows projected on them and divided by their deviations.

The rows X, centred, are never multiplied out to a covariance: the bidiagonalisation alternates products Xv and X'u. v is a vector of one number a dimension; u, of one number a
row, stays on the rows' side, as the combination w with u = Xw. A step is one pass over the stored rows: each task takes its rows' part of Xw, and sums of it with the
rows (X'u) and with the earlier u (for full reorthogonalisation); Spark adds the parts up, two sums a dimension. The v are reorthogonalised against all earlier ones,
twice. Where a product vanishes (fewer independent directions than dimensions) the process goes on from a new seeded vector. The SVD of the small bidiagonal matrix then gives
the components and deviations; steps go on until the wanted ones have converged, or as many steps as dimensions are done.

Entries are made whole numbers first, x = floor(64 * entry) + 1000000, so counts, sums and squares are exact, and centring takes the whole part of the mean off
in whole numbers before the fraction is taken off in double precision; all that a task holds are blocks of rows.

Corner cases: a null vector and one with a null or non-finite entry, or an entry too large for a long (2 to the 56 and beyond), take no part, nor do empty ones or vectors of a length other than that which
most have (ties: the longest). Null ids and repeated rows are rows like any other. A direction without variance (relative to the largest, below TINY) has no whitened value
and isn't returned, so one row, or equal ones, give no rows; nor does an empty table. Extra columns are ignored, a missing vec_id counts as null, a missing embedding as null.
A deviation beyond a long is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import Scratch, fill_missing

#: How an entry becomes a whole number.
SCALE, SHIFT = 64, 1_000_000
#: A deviation below this part of the largest is none; a step's residual below this part of the largest deviation is converged.
TINY, CONVERGED = 1e-9, 1e-14
#: Vectors in a stored block, at most.
BLOCK = 4096
BLOCKS = "length int, n int, ids binary, known binary, x binary"


def blocks(vectors: DataFrame) -> DataFrame:
    """The usable rows of vectors(vec_id, embedding) as blocks of equally long ones: ids (long), known (whether there is an id) and x (long) as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                part = part.filter(part.column(1).is_valid())
                ids, lists = part.column(0), part.column(1)
                lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
                for length in np.unique(lengths[lengths > 0]) if len(lengths) else ():
                    some = np.flatnonzero(lengths == length)
                    entries = lists.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
                    with np.errstate(invalid="ignore"):
                        good = (np.abs(entries) < 2.0**56).all(axis=1)  # false also for NaN, which nulls have become
                    if good.any():
                        x = np.floor(SCALE * entries[good]).astype(np.int64) + SHIFT
                        own = ids.take(pa.array(some[good]))
                        row = [len(x), own.fill_null(0).to_numpy(zero_copy_only=False).tobytes(), own.is_valid().to_numpy(zero_copy_only=False).tobytes(), x.tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([int(length)], pa.int32()), pa.array([row[0]], pa.int32()), *[pa.array([b], pa.binary()) for b in row[1:]]], ["length", "n", "ids", "known", "x"])

    rows = fill_missing(vectors, vec_id="long", embedding="array<double>")
    return rows.mapInArrow(run, BLOCKS)


def _sums(stored: DataFrame, made, size: int) -> np.ndarray:
    """The sum over all blocks of made(x), a vector of the given size; made gets a block's whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for length, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total += made(np.frombuffer(x.as_buffer(), np.int64).reshape(-1, length))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["at", "value"])

    parts = stored.select("length", "x").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(size)
    for r in parts.collect():  # size rows
        out[r["at"]] = r["value"]
    return out


class Centre(NamedTuple):
    """What all rows have in common: their number, exact sums and sums of squares about the whole part of the mean."""

    n: int
    sums: tuple[int, ...]
    squares: tuple[int, ...]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def fraction(self) -> np.ndarray:
        return np.array([s % self.n / self.n for s in self.sums])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.fraction

    @property
    def trace(self) -> float:
        """Of the covariance, from whole numbers."""
        return sum(self.n * q - (s % self.n) ** 2 for s, q in zip(self.sums, self.squares, strict=True)) / self.n**2


def centre(stored: DataFrame) -> Centre:
    """Of blocks of one length; sums of whole numbers, which no task's partial sum can round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = np.frombuffer(x.as_buffer(), np.int64).reshape(-1, length)
                small = bool((np.abs(rows) < 2**40).all())
                sums = rows.sum(axis=0).tolist() if small else [sum(c) for c in rows.T.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(range(length), pa.int32()), pa.array([str(s) for s in sums])], ["at", "value"])

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = np.frombuffer(x.as_buffer(), np.int64).reshape(-1, length) - whole
                small = bool((np.abs(rows) < 2**25).all())
                sums = (rows * rows).sum(axis=0).tolist() if small else [sum(v * v for v in c) for c in rows.T.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(range(length), pa.int32()), pa.array([str(s) for s in sums])], ["at", "value"])

    def totals(made) -> tuple[int, ...]:
        exact = F.sum(F.col("value").cast("decimal(38,0)")).alias("value")
        parts = stored.select("length", "x").mapInArrow(made, "at int, value string").groupBy("at").agg(exact)
        return tuple(int(r["value"]) for r in sorted(parts.collect(), key=lambda r: r["at"]))

    n = stored.agg(F.sum("n")).first()[0]
    sums = totals(run)
    whole = np.array([s // n for s in sums], np.int64)
    return Centre(n, sums, totals(squares))


class Components(NamedTuple):
    """vectors: one column a component; variances: falling eigenvalues of the covariance; steps of the bidiagonalisation."""

    vectors: np.ndarray
    variances: np.ndarray
    steps: int


def _clean(v: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
    """v without its parts along orthonormal vectors; twice, as once leaves rounding errors."""
    if against:
        basis = np.array(against)
        for _ in range(2):
            v = v - basis.T @ (basis @ v)
    return v


def components(stored: DataFrame, mid: Centre, k: int = 32, seed: int = 13) -> Components:
    """The first k components of the centred rows, fewer if fewer have variance.

    X [v1 .. vj] = [u1 .. uj] B with B upper bidiagonal, alpha on its diagonal and beta above it.
    """
    size, random = len(mid.sums), np.random.default_rng(seed)
    fresh = lambda vs: (v := _clean(random.standard_normal(size), vs)) / np.linalg.norm(v)
    vs, ws, zs = [fresh([])], [], []  # v; w with u = Xw; X'u
    alphas, betas = [], []
    while True:
        j = len(ws)
        w = vs[j] - (betas[j - 1] * ws[j - 1] if j else 0.0)
        for again in range(2):
            basis = np.array([w, *ws]).T

            def product(x: np.ndarray, basis: np.ndarray = basis) -> np.ndarray:
                rows = mid.rows(x)
                us = rows @ basis
                u = us[:, 0]
                return np.concatenate([us.T @ u, rows.T @ u])

            got = _sums(stored, product, 1 + j + size)
            length, along, z = got[0], got[1 : 1 + j], got[1 + j :]
            for c, other, image in zip(along, ws, zs, strict=True):  # u without its parts along the earlier u
                w = w - c * other
                z = z - c * image
            if along @ along <= 1e-3 * length:
                break  # else what is left is a small difference of large numbers, and is summed anew
        alpha = np.sqrt(max(0.0, length - along @ along))
        if alpha <= TINY * max([*alphas, 0.0]) * 1e-2 or alpha == 0:
            alpha, w, z = 0.0, np.zeros(size), np.zeros(size)
        else:
            w, z = w / alpha, z / alpha
        alphas.append(alpha)
        ws.append(w)
        zs.append(z)
        nxt = _clean(z - alpha * vs[j], vs)
        beta = np.linalg.norm(nxt)
        most = max([*alphas, *betas, 0.0])
        if len(ws) == size or not most:
            break
        if beta <= TINY * most * 1e-2:
            betas.append(0.0)
            vs.append(fresh(vs))
        else:
            left, sigma, _ = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
            if len(ws) > k and (beta * np.abs(left[-1, :k]) <= CONVERGED * sigma[0]).all():
                break
            betas.append(beta)
            vs.append(nxt / beta)
    _, sigma, right = np.linalg.svd(np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1))
    keep = min(k, int((sigma > TINY * sigma[0]).sum())) if sigma[0] > 0 else 0
    vectors = np.array(vs[: len(alphas)]).T @ right[:keep].T
    return Components(vectors, sigma[:keep] ** 2 / mid.n, len(alphas))


class Whitener:
    """Fitted on all usable rows of vectors(vec_id, embedding)."""

    def __init__(self, vectors: DataFrame, k: int = 32, seed: int = 13):
        self.scratch = Scratch(vectors.sparkSession, "whitening")
        stored = self.scratch.cut(blocks(vectors), "blocks")
        lengths = stored.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
        self.stored = stored.where(F.col("length") == (lengths["length"] if lengths else 0))
        self.centre = centre(self.stored) if lengths else None
        self.components = components(self.stored, self.centre, k, seed) if lengths else Components(np.zeros((0, 0)), np.zeros(0), 0)

    def identity_error(self) -> float:
        """The largest absolute entry of the whitened rows' covariance minus the identity, summed over all rows."""
        k = len(self.components.variances)
        if not k:
            return 0.0
        mid, turn = self.centre, self._turn()

        def product(x: np.ndarray) -> np.ndarray:
            white = mid.rows(x) @ turn
            return np.concatenate([white.sum(axis=0), (white.T @ white).ravel()])

        got = _sums(self.stored, product, k + k * k)
        mean = got[:k] / mid.n
        return float(np.abs(got[k:].reshape(k, k) / mid.n - np.outer(mean, mean) - np.eye(k)).max())

    def _turn(self) -> np.ndarray:
        return self.components.vectors / np.sqrt(self.components.variances)

    def whitened(self) -> DataFrame:
        """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component."""
        k, error = len(self.components.variances), self.identity_error()
        mid, turn = self.centre, self._turn()
        explained = self.components.variances / mid.trace if k else np.zeros(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest = np.array([s % mid.n for s in mid.sums], object if mid.n >= 2**31 else np.int64)
            for batch in batches:
                for length, ids, known, x in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
                    rows = np.frombuffer(x, np.int64).reshape(-1, length)
                    off = rows - mid.whole
                    if mid.n * float(np.abs(off).max() + 1) * np.sqrt(length) < 3e9:
                        deviation = ((mid.n * off - rest) ** 2).sum(axis=1)
                    else:
                        deviation = ((mid.n * off.astype(object) - rest.astype(object)) ** 2).sum(axis=1).tolist()
                    white = mid.rows(rows) @ turn
                    n = len(rows)
                    own = pa.array(np.frombuffer(ids, np.int64), mask=~np.frombuffer(known, bool))
                    yield pa.RecordBatch.from_arrays(
                        [
                            own.take(pa.array(np.repeat(np.arange(n), k))),
                            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                            pa.array(np.full(n * k, mid.n, np.int64)),
                            pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(n), k))),
                            pa.array(white.ravel()),
                            pa.array(np.tile(explained, n)),
                            pa.array(np.full(n * k, error)),
                        ],
                        ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

        schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        if not k:
            return self.scratch.spark.createDataFrame([], schema)
        return self.stored.select("length", "ids", "known", "x").mapInArrow(run, schema)
