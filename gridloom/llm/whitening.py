"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows of the fit list are a tall matrix A that is only ever multiplied: each step sends one direction v to the
tasks, which answer with sums over their rows for Av and its transposed product. The left vectors u are as long as the
table, so they are not stored: each is A times a short vector y that the driver keeps, and tasks make them again from their
rows. Both sides are orthogonalised against all vectors before (full reorthogonalisation), the left side by sums over the
table. The singular values and vectors of the small bidiagonal matrix give components and deviations.

Steps end when the wanted components have converged and the energy that is left outside the directions found (known exactly,
since the trace is) is less than that of the last wanted component, so that none can have been overlooked; at the
latest after as many steps as there are dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import materialize

#: Entries of a block of the fit list (2 MB as doubles).
BLOCK_ENTRIES = 1 << 18
#: Largest number of tasks of a pass. Each sends one row of sums, so the driver gets at most so many rows.
PASS_TASKS = 4096
LONG_LIMIT = 2.0**63


@dataclass(frozen=True)
class Whitening:
    """``n`` fitted vectors with sums ``total`` by dimension; by column of ``axes`` a unit component, and its variance."""

    n: int
    total: list[int]
    axes: np.ndarray
    variance: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.total])


def grid_vectors(rows: DataFrame, vector_col: str) -> DataFrame:
    """``row`` (a struct of all columns) and ``x``, the vector with each entry c as the long ``floor(256 * c)``.

    Left out are rows whose vector is null or empty, holds a null, a non-finite entry or one that no long can hold, or has
    another length than most vectors (of equally frequent lengths the larger one counts).
    """
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    scaled = F.transform(F.col("row")[vector_col], lambda c: F.floor(c.cast("double") * 256))
    bad = F.exists(
        F.col("row")[vector_col],
        lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double") * 256) >= F.lit(LONG_LIMIT)),
    )
    rows = rows.where(F.col("row")[vector_col].isNotNull() & (F.size(F.col("row")[vector_col]) > 0)).where(~bad)
    rows = rows.select("row", scaled.alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("x") == (most["d"] if most else 0))


def _packer(d: int):
    """Rows of the fit list as blocks of a matrix: ``rows, data`` (64-bit integers)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_ENTRIES // d)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, d)
            parts = [x[k : k + step] for k in range(0, len(x), step)]
            columns = [pa.array([len(p) for p in parts], pa.int32()), pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["rows", "data"])

    return kernel


class _Passes:
    """Products of the centred and scaled fit list with short vectors, one Spark job each."""

    def __init__(self, fit: DataFrame, d: int, mean: np.ndarray, n: int):
        self.spark = fit.sparkSession
        blocks = materialize(fit.mapInArrow(_packer(d), "rows int, data binary"), "blocks")
        self.blocks = blocks.coalesce(PASS_TASKS).select("data")
        self.d, self.mean, self.scale = d, mean, 1 / np.sqrt(n)

    def sums(self, of_block, *sent) -> np.ndarray:
        """The sum over all blocks of ``of_block(a, *sent)``, an array for the rows ``a`` of a block."""
        box = self.spark.sparkContext.broadcast((self.d, self.mean, self.scale, sent))  # two d x d matrices at most

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d, mean, scale, sent = box.value
            total = None
            for batch in batches:
                for data in batch.column(0):
                    a = (np.frombuffer(data.as_buffer(), "<i8").reshape(-1, d) - mean) * scale
                    part = of_block(a, *sent)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["part"])

        try:
            parts = self.blocks.mapInArrow(kernel, "part array<double>").collect()
        finally:
            box.destroy()
        return np.sum([r["part"] for r in parts], axis=0)

    def energy(self) -> float:
        return float(self.sums(lambda a: np.array([(a * a).sum()]))[0])

    def products(self, left: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """With u = Ay and U = A left: the products of U's columns with u, the square of u's length, and u times A."""

        def of_block(a: np.ndarray, left: np.ndarray, y: np.ndarray) -> np.ndarray:
            u = a @ y
            return np.concatenate([(a @ left).T @ u, [u @ u], u @ a])

        out = self.sums(of_block, left, y)
        k = left.shape[1]
        return out[:k], float(out[k]), out[k + 1 :]

    def covariance(self, axes: np.ndarray) -> np.ndarray:
        """Covariance of the rows projected on ``axes``, centred."""

        def of_block(a: np.ndarray, axes: np.ndarray, scale: float) -> np.ndarray:
            z = a @ axes / scale
            return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])

        out = self.sums(of_block, axes, self.scale) * self.scale**2
        k = axes.shape[1]
        return out[: k * k].reshape(k, k) - np.outer(out[k * k :], out[k * k :])


def _outside(w: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``w`` without its parts along the columns of ``basis``, twice for the rounding errors of the first time."""
    for _ in range(2):
        w = w - basis @ (basis.T @ w)
    return w


def bidiagonalise(passes: _Passes, wanted: int, energy: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """``axes, variance`` of the ``wanted`` leading components of the rows of ``passes``, whose squares sum to ``energy``."""
    d, random = passes.d, np.random.default_rng(seed)
    eps = np.finfo(float).eps
    right, left, back = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # V; Y with U = AY; U times A
    small = np.zeros((d, d))  # the bidiagonal matrix: U's products with AV
    floor = eps * np.sqrt(energy)
    v, beta = random.standard_normal(d), 0.0
    for k in range(d):
        v = _outside(v, right)
        while np.linalg.norm(v) < 1e-8:  # no direction of its own: any other will do
            v = _outside(random.standard_normal(d), right)
        v /= np.linalg.norm(v)
        right = np.column_stack([right, v])
        y = v.copy()
        if k and beta:
            y -= beta * left[:, -1]
            small[k - 1, k] = beta
        # u = Ay; once more where most of it lay along the vectors before it.
        for _ in range(3):
            along, square, pulled = passes.products(left, y)
            y, pulled = y - left @ along, pulled - back @ along
            alpha = np.sqrt(max(0.0, square - along @ along))
            if alpha >= 0.7 * np.sqrt(square) or alpha <= floor:
                break
        if alpha > floor * 4:
            small[k, k] = alpha
            y, pulled = y / alpha, pulled / alpha
        else:  # Av is nothing but what is known: no new left vector
            alpha, y, pulled = 0.0, np.zeros(d), np.zeros(d)
        left, back = np.column_stack([left, y]), np.column_stack([back, pulled])
        w = _outside(pulled - alpha * v, right)
        beta = float(np.linalg.norm(w))
        if beta <= floor * 4:
            beta, w = 0.0, random.standard_normal(d)
        p, s, qt = np.linalg.svd(small[: k + 1, : k + 1])
        rest = energy - float((s * s).sum())
        if k + 1 >= wanted and s[0] > 0:
            open_ends = beta * np.abs(p[k, :wanted])
            if (open_ends <= eps * s[0]).all() and rest < 0.5 * s[wanted - 1] ** 2:
                break
        v = w
    axes = right @ qt.T
    return np.linalg.qr(axes[:, :wanted])[0] if wanted else axes[:, :0], (s * s)[:wanted]


def fit(vectors: DataFrame, components: int) -> Whitening | None:
    """The whitening of ``vectors`` (``x``); each different vector counts once. None if there are no vectors."""
    # Copies are combined before the shuffle, so a vector that many rows share is a row of each task.
    distinct = materialize(vectors.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit")
    n = distinct.count()
    if n == 0:
        return None
    d = len(distinct.first()["x"])
    exact = [F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(d)]
    total = [int(s) for s in distinct.agg(*exact).first()]
    mean = np.array([s / n for s in total])
    passes = _Passes(distinct, d, mean, n)
    energy = passes.energy()
    wanted = min(components, d)
    if energy == 0:
        return Whitening(n, total, np.eye(d)[:, :wanted], np.zeros(wanted), 0.0, None)
    axes, variance = bidiagonalise(passes, wanted, energy)
    variance = np.where(variance > variance.max() * d * np.finfo(float).eps, variance, 0.0)
    whole = variance > 0
    cov = passes.covariance(axes[:, whole] / np.sqrt(variance[whole]))
    return Whitening(n, total, axes, variance, energy, float(np.abs(cov - np.eye(len(cov))).max()))


def _projector(box):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, axes, variance = box.value
        d = len(mean)
        deviation = np.sqrt(np.where(variance > 0, variance, 1.0))
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            step, parts = max(1, BLOCK_ENTRIES // d), []
            for k in range(0, len(x), step):
                z = (x[k : k + step] - mean) @ axes / deviation
                parts += [[v if s > 0 else None for v, s in zip(row, variance)] for row in z.tolist()]
            columns = [*batch.columns, pa.array(parts, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "whitened"])

    return kernel


def _deviation(model: Whitening) -> Column:
    """The sum over dimensions of ``(n * x - total)^2`` as decimal(38, 0), exact; an overflow is an error."""
    exact = "decimal(38,0)"
    offset = F.array(*[F.lit(str(s)).cast(exact) for s in model.total])
    off = F.zip_with("x", offset, lambda x, s: (x.cast(exact) * F.lit(str(model.n)).cast(exact)).cast(exact) - s)
    return F.aggregate(off, F.lit("0").cast(exact), lambda t, v: (t + (v.cast(exact) * v.cast(exact)).cast(exact)).cast(exact))


def whiten(rows: DataFrame, vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """For every row with a usable vector ``row`` (a struct of its columns), ``n``, ``deviation`` (decimal), ``whitened``
    (one entry a component, by falling variance), ``explained`` (shares of the variance) and ``identity_error``.

    See ``grid_vectors`` for the rows that are left out. A component without variance has a null whitened entry; if no
    component has any, ``explained`` is null and so is ``identity_error``. Rows with equal vectors have equal results. A table
    without usable vectors gives an empty result. ``rows`` may have any other columns.
    """
    vectors = grid_vectors(rows, vector_col)
    model = fit(vectors, components)
    kind = vectors.schema["row"].dataType.simpleString()
    fields = "row {}, x array<bigint>, whitened array<double>".format(kind)
    if model is None:
        empty = vectors.where(F.lit(False)).select("row", "x", F.array().cast("array<double>").alias("whitened"))
        model = Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, None)
        out = empty.withColumn("deviation", F.lit("0").cast("decimal(38,0)"))
    else:
        box = rows.sparkSession.sparkContext.broadcast((model.mean, model.axes, model.variance))
        out = vectors.mapInArrow(_projector(box), fields).withColumn("deviation", _deviation(model))
    shares = F.array(*[F.lit(float(v / model.trace)) if model.trace else F.lit(None).cast("double") for v in model.variance])
    return out.select(
        "row",
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        shares.cast("array<double>").alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
