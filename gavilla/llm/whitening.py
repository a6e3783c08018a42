"""Embedding whitening by spectral divide and conquer.

The covariance of all vectors is summed in tasks, exactly centred. Its eigenvectors come from polar decompositions: the
polar factor U of A - s*I tells the eigenvalues above s from those below it, (U + I) / 2 projects onto the upper ones, and
the two invariant subspaces are split again until each is one component (Nakatsukasa and Higham, 2013). The polar factor is
found by the QR-based dynamically weighted Halley iteration. Only the matrix, whose side is the vector length, is on the
driver; the whitening matrix is then broadcast and applied to batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gavilla.session import materialise, settle

# An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
EPS = np.finfo(float).eps
# Entries beyond this are not exact as doubles once scaled; they count as not finite.
LARGEST = 2.0**53
# Rows that a kernel works on at a time.
STEP = 4096


# -- spectral divide and conquer ---------------------------------------------------------------------


def polar_factor(a: np.ndarray, max_rounds: int = 30) -> np.ndarray:
    """The orthogonal polar factor of a symmetric ``a`` by QR-based dynamically weighted Halley steps."""
    n = len(a)
    scale = np.linalg.norm(a)
    x, low = a / scale, EPS  # a lower bound on the least singular value; a smaller one only costs accuracy there
    for _ in range(max_rounds):
        square = min(low * low, 1.0)
        step = np.cbrt(4 * (1 - square) / square**2)
        p = np.sqrt(1 + step) + 0.5 * np.sqrt(8 - 4 * step + 8 * (2 - square) / (square * np.sqrt(1 + step)))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        top, bottom = np.vsplit(np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(n)]))[0], 2)
        after = (q / r) * x + (p - q / r) / np.sqrt(r) * (top @ bottom.T)
        low = min(low * (p + q * square) / (1 + r * square), 1.0)
        after = (after + after.T) / 2
        moved = np.linalg.norm(after - x)
        x = after
        if abs(low - 1) < 10 * EPS and moved < (5 * EPS) ** (1 / 3):
            break
    return x


def _shifts(a: np.ndarray) -> Iterator[float]:
    """Places to cut the spectrum at: the middle of the diagonal, then ever finer parts of the range that holds it."""
    yield float(np.median(np.diag(a)))
    yield float(np.trace(a) / len(a))
    spread = np.abs(a - np.diag(np.diag(a))).sum(axis=1)
    low, high = float((np.diag(a) - spread).min()), float((np.diag(a) + spread).max())
    for parts in (2, 4, 8, 16, 32, 64, 128):
        for i in range(1, parts, 2):
            yield low + (high - low) * i / parts


def _split(a: np.ndarray, norm: float) -> tuple[np.ndarray, int] | None:
    """(orthogonal basis, size of the upper part) that splits ``a`` in two invariant subspaces; None if it is a multiple of I."""
    n = len(a)
    centre = np.trace(a) / n
    if np.linalg.norm(a - centre * np.eye(n)) <= 4 * n * EPS * norm:
        return None
    for shift in _shifts(a):
        moved = a - shift * np.eye(n)
        if not np.any(moved):
            continue
        projector = (polar_factor(moved) + np.eye(n)) / 2
        upper = int(round(np.trace(projector)))
        if not 0 < upper < n:
            continue
        # Two steps of subspace iteration from the largest columns give an orthogonal basis of range and complement.
        first = np.argsort(-np.linalg.norm(projector, axis=0), kind="stable")
        basis = np.linalg.qr(projector[:, first], mode="complete")[0]
        basis = np.linalg.qr(np.hstack([projector @ basis[:, :upper], basis[:, upper:] - projector @ basis[:, upper:]]))[0]
        across = basis[:, upper:].T @ a @ basis[:, :upper]
        # An eigenvalue too near the shift leaves the projector unsettled; then another shift is taken.
        if np.linalg.norm(across) <= 64 * n * EPS * norm:
            return basis, upper
    return None


def spectral_components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in columns) of a symmetric ``v`` by falling eigenvalue."""
    n = len(v)
    norm = float(np.linalg.norm(v))
    vectors = np.eye(n)
    if norm > 0:
        todo = [(0, n)]
        while todo:
            start, end = todo.pop()
            if end - start < 2:
                continue
            own = vectors[:, start:end]
            inner = own.T @ v @ own
            found = _split((inner + inner.T) / 2, norm)
            if found is None:  # all eigenvalues of the part are one, so any basis of it will do
                continue
            basis, upper = found
            vectors[:, start:end] = own @ basis
            todo += [(start, start + upper), (start + upper, end)]
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# -- Spark -------------------------------------------------------------------------------------------


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, int64 rows) of a few thousand rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, STEP):
            part = batch.slice(start, STEP)
            yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def whole_vectors(embeddings: DataFrame, key: str = "vec_id", vec: str = "embedding") -> tuple[DataFrame, int]:
    """((key, x array<bigint>) of the rows that can be whitened, their width).

    A row goes if its vector is null, empty, holds a null, NaN or infinite entry, or one beyond 2^53 / 1024. Vectors of
    another length than most go too (of lengths equally common, the longest stays).
    """
    c = F.col(vec).cast("array<double>")
    fits = lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y * F.lit(SCALE)) < F.lit(LARGEST))
    sound = embeddings.where((F.size(vec) > 0) & F.forall(c, fits))
    x = F.transform(c, lambda y: F.floor(y * F.lit(SCALE)) + F.lit(SHIFT))
    rows = materialise(sound.select(F.col(key).alias("key"), x.alias("x")), "whole-vectors")
    widths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return (rows.where(F.size("x") == widths["width"]), widths["width"]) if widths else (rows, 0)


def column_sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """(n, exact sum of each dimension); what is collected is one row a dimension."""

    def add(batches):
        # In two halves, so that no sum leaves 64 bits.
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for _, x in _matrices(batches, width):
            n, high, low = n + len(x), high + (x >> 20).sum(axis=0), low + (x & 0xFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(high), pa.array(low)], ["dim", "n", "high", "low"])

    parts = rows.mapInArrow(add, "dim int, n bigint, high bigint, low bigint")
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    sums = [0] * width
    for r in found:
        sums[r["dim"]] = (r["high"] << 20) + r["low"]
    return (found[0]["n"] if found else 0), sums


def covariance(rows: DataFrame, width: int, n: int, sums: list[int]) -> np.ndarray:
    """Covariance (divisor n) of ``rows``, centred before multiplying; each task sends one triangle of sums."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n / n for s in sums])
    at = np.triu_indices(width)

    def add(batches):
        total, some = np.zeros((width, width)), False
        for _, x in _matrices(batches, width):
            y, some = (x - whole).astype(float) - rest, True
            total += y.T @ y
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at[0])), pa.int32()), pa.array(total[at])], ["cell", "part"])

    parts = rows.mapInArrow(add, "cell int, part double")
    out = np.zeros((width, width))
    for r in parts.groupBy("cell").agg(F.sum("part").alias("total")).collect():
        i, j = at[0][r["cell"]], at[1][r["cell"]]
        out[i, j] = out[j, i] = r["total"] / n
    return out


def whitener(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix whose columns project and scale, share of the trace) of the first ``components``.

    A component whose variance is nothing but rounding has a zero column and a share of 0.
    """
    values, vectors = spectral_components(v)
    values, vectors = values[:components], vectors[:, :components]
    real = values > len(v) * EPS * max(np.linalg.norm(v), np.finfo(float).tiny)
    scale = np.where(real, 1 / np.sqrt(np.where(real, values, 1.0)), 0.0)
    trace = np.trace(v)
    return vectors * scale, np.where(real, values / (trace if trace > 0 else 1.0), 0.0)


def whiten(embeddings: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vec: str = "embedding") -> tuple[DataFrame, list[float], int]:
    """((key, deviation, whitened array<double>), shares of the trace, n) of the rows kept by ``whole_vectors``.

    Rows are kept as often as they come, null keys too. ``deviation`` is exact, and null where it does not fit 64 bits.
    With fewer dimensions than ``components`` there are as many components as dimensions. Where a component has no variance
    (equal rows, or fewer rows than dimensions) ``whitened`` is 0.
    """
    rows, width = whole_vectors(embeddings, key, vec)
    n, sums = column_sums(rows, width) if width else (0, [])
    schema = f"key {dict(embeddings.dtypes)[key]}, deviation bigint, whitened array<double>"
    if not n:
        return embeddings.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key), [], 0
    matrix, shares = whitener(covariance(rows, width, n, sums), components)
    taken = matrix.shape[1]
    shared = embeddings.sparkSession.sparkContext.broadcast((sums, matrix))  # width x (components + 1) numbers

    def apply(batches):
        totals, projection = shared.value
        whole = np.array([s // n for s in totals], dtype=np.int64)
        left = np.array([s % n for s in totals], dtype=np.int64)
        for keys, x in _matrices(batches, width):
            near = x - whole  # n*x - S = n*near - left
            largest = float(np.abs(near).max(initial=0) + 1) * n
            if largest * largest * width < 2.0**62:
                deviation = ((n * near - left) ** 2).sum(axis=1).tolist()
            else:
                exact = (((n * near.astype(object)) - left.astype(object)) ** 2).sum(axis=1)
                deviation = [d if d < 2**63 else None for d in exact.tolist()]
            white = (near - left / n) @ projection
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * taken, pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(deviation, pa.int64()), lists], ["key", "deviation", "whitened"])

    return rows.mapInArrow(apply, schema).withColumnRenamed("key", key), shares.tolist(), n


def identity_error(white: DataFrame, shares: list[float]) -> float:
    """Largest entry of the covariance of ``whitened`` minus the identity, over the components that have variance."""
    live = [i for i, share in enumerate(shares) if share > 0]
    cells = [(i, j) for i in live for j in live if i <= j]
    if not cells:
        return 0.0
    at = lambda i: F.col("whitened")[i]
    found = white.agg(*[F.covar_pop(at(i), at(j)).alias(f"c{i}_{j}") for i, j in cells]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in cells)


def whitened_rows(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: one row a vector and component."""
    return settle(lambda: _component_rows(embeddings, components), "components")


def _component_rows(embeddings: DataFrame, components: int) -> DataFrame:
    white, shares, n = whiten(embeddings, components)
    white = materialise(white, "whitened")
    error = identity_error(white, shares)
    explained = F.array(*[F.lit(float(s)) for s in shares]) if shares else F.array().cast("array<double>")
    rows = white.select("vec_id", "deviation", F.posexplode("whitened").alias("pos", "whitened"))
    return rows.select(
        "vec_id", (F.col("pos") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("pos")).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
