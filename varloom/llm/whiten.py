"""Whitening of embeddings by the components of their covariance, with mixed-precision refinement.

Vectors become whole numbers, so sums and products can be exact: one pass sums every dimension, the next subtracts the
whole number next to the mean, multiplies in blocks that doubles hold without rounding and adds the blocks up as whole
numbers. What the mean differs from that whole number by is settled exactly at the end. The covariance is therefore
the correctly rounded one, on any partitioning.

Components: eigenvectors of the covariance in float32, then corrected by Ogita-Aishima iterations, which consist
of matrix products in extended precision and double the number of right digits each time. Eigenvalues that lie too close to be told
apart by a correction form a cluster; the matrix projected on a cluster's vectors, less the cluster's mean, is solved on
its own, which brings differences to light that the whole matrix hides. Only matrices of dimension x dimension reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm import common

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Entries at or beyond this are no embedding entries; such rows go like those with entries that aren't finite.
LARGEST = float(2**30)
#: Covariances of more dimensions aren't brought to the driver.
MAX_DIMENSIONS = 4096
#: Vectors multiplied at once; with halves of 21 bits every sum of products stays below 2**53.
BLOCK_ROWS = 1024
HALF = 1 << 20
#: Blocks of products below 2**50 that a long adds up.
LONG_BLOCKS = 4096
REFINEMENTS = 12


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and v of rows whose vector is neither null nor empty and holds finite entries below LARGEST only."""
    good = F.forall(F.col(column), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return vectors.where(F.col(column).isNotNull() & (F.size(column) > 0) & good).select("vec_id", F.col(column).alias("v"))


def whole_numbers(column: pa.Array, dimension: int) -> np.ndarray:
    """The rows as whole numbers floor(1024 c) + 100000, one row per vector."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, dimension) + OFFSET


def sums(rows: DataFrame) -> DataFrame:
    """(dimension, place, n, s): number of vectors of each dimension and the exact sum at each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            column = batch.column("v")
            sizes = pc.list_value_length(column)
            for d in pc.unique(sizes).to_pylist():
                same = column.filter(pc.equal(sizes, d))
                n, s = held.get(d, (0, np.zeros(d, np.int64)))
                for start in range(0, len(same), BLOCK_ROWS):
                    s = s + whole_numbers(same.slice(start, BLOCK_ROWS), d).sum(axis=0)
                held[d] = n + len(same), s
        for d, (n, s) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(s)],
                names=["dimension", "place", "n", "s"],
            )

    parts = rows.mapInArrow(run, "dimension int, place int, n bigint, s bigint")
    return parts.groupBy("dimension", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))


def _products(y: np.ndarray) -> np.ndarray:
    """Exact sum of products y'y of whole numbers below 2**41, in halves that doubles multiply without rounding.

    Longs where the numbers are below 2**20, as those of embeddings are; Python's whole numbers otherwise.
    """
    if np.abs(y).max() < HALF:
        z = y.astype(float)
        return (z.T @ z).astype(np.int64)
    high = (y + (HALF >> 1)) >> 20
    low = (y - (high << 20)).astype(float)
    high = high.astype(float)
    cross = (high.T @ low).astype(np.int64)
    return (high.T @ high).astype(np.int64).astype(object) * (1 << 40) + (cross.astype(object) + cross.T) * HALF + (low.T @ low).astype(np.int64)


def product_sums(rows: DataFrame, dimension: int, centre: np.ndarray) -> DataFrame:
    """(i, j, g), i <= j: exact sums of (x_i - centre_i) (x_j - centre_j) over all vectors of the dimension."""
    i, j = np.triu_indices(dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, blocks = np.zeros((dimension, dimension), object), np.zeros((dimension, dimension), np.int64), 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                found = _products(whole_numbers(batch.column("v").slice(start, BLOCK_ROWS), dimension) - centre)
                if found.dtype == object:
                    total = total + found
                else:
                    held, blocks = held + found, blocks + 1
                if blocks == LONG_BLOCKS:
                    total, held, blocks = total + held, np.zeros_like(held), 0
        total = total + held
        some = np.flatnonzero(total[i, j] != 0)
        for start in range(0, len(some), 1 << 16):
            part = some[start : start + (1 << 16)]
            values = pa.array([Decimal(int(g)) for g in total[i[part], j[part]]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(i[part].astype(np.int32)), pa.array(j[part].astype(np.int32)), values], names=["i", "j", "g"])

    parts = rows.where(F.size("v") == dimension).mapInArrow(run, "i int, j int, g decimal(38,0)")
    return parts.groupBy("i", "j").agg(F.sum("g").alias("g"))


def covariance(n: int, s: list[int], centre: np.ndarray, products: list[tuple[int, int, int]]) -> np.ndarray:
    """Covariance with divisor n, each entry the rounded exact value."""
    v = np.zeros((len(s), len(s)))
    rest = [x - n * int(c) for x, c in zip(s, centre, strict=True)]
    sums_of = {(i, j): g for i, j, g in products}
    for i in range(len(s)):
        for j in range(i, len(s)):
            v[i, j] = v[j, i] = (n * sums_of.get((i, j), 0) - rest[i] * rest[j]) / (n * n)
    return v


def _clusters(values: np.ndarray, width: float) -> list[np.ndarray]:
    """Places of ascending values with neighbours at most `width` apart, groups of two or more."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > width) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def refine(a: np.ndarray, x: np.ndarray, rounds: int = REFINEMENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors of a symmetric matrix from approximate eigenvectors, to double precision.

    Each round forms R = I - X'X and S = X'AX in extended precision and corrects X by X E, where E solves the first-order
    equations for well separated eigenvalues and restores orthogonality elsewhere. Clusters are then solved by
    themselves. It ends when a correction no longer changes a double.
    """
    wide = np.longdouble
    a, x = a.astype(wide), x.astype(wide)
    one = np.eye(len(a), dtype=wide)
    size = max(float(np.abs(a).sum(axis=1).max()), np.finfo(float).tiny)
    for _ in range(rounds):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        width = 2 * (np.sqrt(float((off * off).sum())) + size * np.sqrt(float((r * r).sum())))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > width
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        for group in _clusters(values.astype(float), width):
            basis = x[:, group]
            mean = values[group].mean()
            inner = basis.T @ (a @ basis - mean * basis)
            _, turn = np.linalg.eigh(((inner + inner.T) / 2).astype(float))
            x[:, group] = basis @ turn.astype(wide)
        if np.abs(e).max() < np.finfo(float).eps / 4 and width < size * 1e-14:
            break
    for _ in range(2):  # what rounding over a small gap took from orthogonality
        x = x + x @ ((one - x.T @ x) / 2)
    values = np.diag(x.T @ (a @ x)) / np.diag(x.T @ x)
    order = np.argsort(-values.astype(float), kind="stable")
    return values[order].astype(float), x[:, order].astype(float)


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns, largest entry positive) of a covariance."""
    size = max(float(np.abs(v).max()), np.finfo(float).tiny)
    _, x = np.linalg.eigh((v / size).astype(np.float32))
    values, x = refine(v, x)
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(v))])
    return values, x * np.where(sign == 0, 1, sign)


def square_sums(y: np.ndarray, n: int, rest: np.ndarray) -> list[int | None]:
    """Exact sum over each row of (n y - rest)^2; None where a long can't hold it. rest is at most n / 2 each way."""
    if n * (int(np.abs(y).max()) + 1) < 2**31 / np.sqrt(y.shape[1]):
        z = y * n - rest.astype(np.int64)
        return (z * z).sum(axis=1).tolist()
    sums_of = [sum(int(z) * int(z) for z in row) for row in y.astype(object) * n - rest]
    return [x if x < 2**63 else None for x in sums_of]


def whiten(vectors: DataFrame, column: str = "embedding", keep: int = COMPONENTS) -> DataFrame:
    """vec_id, component (1 to `keep`), n, deviation, whitened, explained and identity_error of every usable row.

    Rows without vec_id and repeated rows count and are returned like any other. Where vectors differ in their number
    of dimensions, the number that most rows have counts (of equals the larger); the others go, as their places can't be
    matched. A component without variance (one vector only, or all alike) has a null `whitened`, and identity_error covers
    the others (null if there are none). deviation is null where a long can't hold it. No usable vector: no rows.
    Columns other than vec_id and the vector are left aside.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = usable(vectors, column)
    found = common.materialise(sums(rows))
    most = found.where("place = 0").orderBy(F.col("n").desc(), F.col("dimension").desc()).limit(1).collect()
    if not most:
        return spark.createDataFrame([], schema)
    d, n = most[0]["dimension"], most[0]["n"]
    if d > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions: covariances of at most {MAX_DIMENSIONS} are solved")
    s = [int(r["s"]) for r in found.where(F.col("dimension") == d).orderBy("place").collect()]
    centre = np.array([(2 * x + n) // (2 * n) for x in s], np.int64)
    products = [(r["i"], r["j"], int(r["g"])) for r in product_sums(rows, d, centre).collect()]
    v = covariance(n, s, centre, products)
    values, axes = components(v)
    keep = min(keep, d)
    trace = float(np.trace(v))
    told = values[:keep] > trace * d * np.finfo(float).eps
    scale = np.where(told, 1 / np.sqrt(np.where(told, values[:keep], 1.0)), np.nan)
    turn = axes[:, :keep] * np.where(told, scale, 0.0)
    rest = np.array([x - n * int(c) for x, c in zip(s, centre, strict=True)], object)
    near = (rest / n).astype(float)

    def centred(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """x - S/n, rounded once, and x less the whole number next to the mean."""
        y = whole_numbers(column, d) - centre
        return y - near, y

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((keep + 1, keep))
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                w = centred(batch.column("v").slice(start, BLOCK_ROWS))[0] @ turn
                total[:keep] += w.T @ w
                total[keep] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "g"])

    rows = rows.where(F.size("v") == d)
    moments = np.zeros((keep + 1, keep))
    for r in rows.mapInArrow(parts, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
        moments[r["i"], r["j"]] = r["g"] / n
    mean = moments[keep]
    off = np.abs(moments[:keep] - np.outer(mean, mean) - np.eye(keep))[np.ix_(told, told)]
    error = float(off.max()) if told.any() else None
    share = [float(e) / trace if trace > 0 else 0.0 for e in values[:keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(start, BLOCK_ROWS)
                z, y = centred(some.column("v"))
                w = z @ turn
                deviation = square_sums(y, n, rest)
                m = some.num_rows
                ids = some.column("vec_id").take(pa.array(np.repeat(np.arange(m), keep)))
                empty = np.tile(~told, m)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * keep, n)),
                        pa.array([x for x in deviation for _ in range(keep)], pa.int64()),
                        pa.array(w.ravel(), pa.float64(), mask=empty),
                        pa.array(np.tile(np.array(share), m)),
                        pa.array([error] * (m * keep), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
