"""Whitening of embeddings: components of their covariance, from float32 eigenvectors refined in higher precision.

Entries become integers, so that counts, sums and products of centred entries are added exactly: results do not
depend on how rows are parted. Only tables whose size depends on the dimensions come to the driver.

1. one pass sums entries by dimension; a second adds products of entries less the rounded mean, inside tasks by
   matrix products small enough to be exact, across tasks as decimals; the rest of the mean is taken off exactly;
2. the covariance is solved in float32, and Ogita-Aishima steps (matrix products in long doubles) refine all
   eigenvectors at once; eigenvalues too close for a step to tell apart form a cluster, whose own small matrix,
   shifted by its mean and formed in high precision, is solved apart and turns the cluster's vectors;
3. a third pass measures the covariance of the whitened rows, a fourth returns them.

Defined cases: null vectors, and those with null or non-finite entries, are left out; where lengths differ, the
most common one counts (the shorter on ties) and other rows are left out; entries beyond 2**40 are that; rows with
a null or repeated id stay, as do equal rows; a component whose eigenvalue is not above rounding has a null
``whitened`` and is left out of ``identity_error``, which is null where no component is left; a deviation beyond a long is null; an
empty table gives an empty result; other columns of the table are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_slices, stored, table

SCALE, SHIFT, MOST = 64, 1_000_000, 2**40
COMPONENTS = 32
SLICE = 2048  # rows of one exact product: 2 ** 11 products below 2 ** 42


def finite_rows(df: DataFrame, vector: str, id_: str) -> DataFrame:
    """``id, v``: rows whose vector has only finite entries."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_).alias("id"), v.alias("v")).where(F.col("v").isNotNull() & fine)


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the batch, integer entries) of the vectors of each length."""
    v = batch.column(batch.schema.get_field_index("v"))
    flat, at = v.flatten().to_numpy(zero_copy_only=False), v.offsets.to_numpy()
    at = at - at[0]
    sizes = np.diff(at)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        if size:
            entries = flat[at[rows][:, None] + np.arange(size)]
            yield int(size), rows, np.clip(np.floor(SCALE * entries), -MOST, MOST).astype(np.int64) + SHIFT


def sums(rows: DataFrame) -> DataFrame:
    """``size, i, n, s``: rows and sums of each place of the vectors of each length."""
    def add(batches):
        found: dict[int, list] = {}
        for batch in small_slices(batches, SLICE):
            for size, at, x in by_length(batch):
                n, s = found.get(size, (0, 0))
                found[size] = [n + len(at), s + x.sum(axis=0).astype(object)]
        for size, (n, s) in found.items():
            yield pa.RecordBatch.from_pydict({"size": [size] * size, "i": range(size), "n": [n] * size, "s": [Decimal(int(t)) for t in s]}, schema=pa.schema([("size", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("s", pa.decimal128(38, 0))]))

    per = rows.select("v").mapInArrow(add, "size int, i int, n long, s decimal(38,0)")
    return per.groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))


def exact_products(z: np.ndarray) -> np.ndarray:
    """z'z as Python integers, from float64 products whose sums stay below 2 ** 53; entries up to 2 ** 42, SLICE rows."""
    most = int(np.abs(z).max(initial=0))
    if most * most * len(z) < 2**53:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    high = z >> 21
    low = (z - (high << 21)).astype(np.float64)
    high = high.astype(np.float64)
    whole = lambda m: m.astype(np.int64).astype(object)
    cross = whole(high.T @ low)
    return whole(high.T @ high) * 2**42 + (cross + cross.T) * 2**21 + whole(low.T @ low)


def products(rows: DataFrame, size: int, centre: np.ndarray) -> DataFrame:
    """``i, j, v``: sums of products of centred entries, i <= j."""
    def add(batches):
        total = None
        for batch in small_slices(batches, SLICE):
            for found, _, x in by_length(batch):
                if found == size:
                    own = exact_products(x - centre)
                    total = own if total is None else total + own
        if total is not None:
            i, j = np.triu_indices(size)
            for at in range(0, len(i), 65536):
                part = slice(at, at + 65536)
                yield pa.RecordBatch.from_pydict({"i": i[part], "j": j[part], "v": [Decimal(int(t)) for t in total[i[part], j[part]]]}, schema=pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.decimal128(38, 0))]))

    return rows.select("v").mapInArrow(add, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v"))


def refined(a: np.ndarray, x: np.ndarray, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of a symmetric matrix, refined from approximate vectors."""
    a, x = a.astype(np.longdouble), x.astype(np.longdouble)
    one = np.eye(len(a), dtype=np.longdouble)
    norm = np.abs(a).sum(axis=1).max()
    best = np.inf
    for _ in range(steps):
        r, s = one - x.T @ x, x.T @ (a @ x)
        e = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-e, kind="stable")
        x, r, s, e = x[:, order], r[order][:, order], s[order][:, order], e[order]
        off = s - np.diag(e)
        near = 2 * (np.linalg.norm(off.astype(float)) + norm * np.linalg.norm(r.astype(float)))
        near = max(near, 4 * len(a) * np.finfo(np.longdouble).eps * norm)
        gap = e[None, :] - e[:, None]
        told = np.abs(gap) > near
        move = np.where(told, (s + e[None, :] * r) / np.where(told, gap, 1), r / 2)
        x = x + x @ move
        parts = np.split(np.arange(len(e)), np.flatnonzero(np.diff(-e) > near) + 1)
        for part in parts:
            if len(part) > 1:  # a sub-solve: the cluster's own matrix, less its mean
                v = x[:, part]
                small = v.T @ (a @ v) - e[part].mean() * (v.T @ v)
                small = (small + small.T) / 2
                top = np.abs(small).max()
                if top > 0:
                    x[:, part] = v @ np.linalg.eigh((small / top).astype(np.float64))[1][:, ::-1]
        size = float(np.abs(move).max())
        if size < 1e-18 or (size >= best / 2 and size < 1e-14):
            break
        best = min(best, size)
    x = x + x @ (one - x.T @ x) / 2  # a cluster's vectors come from double precision and are orthogonal to that only
    x /= np.sqrt((x * x).sum(axis=0))
    e = np.diag(x.T @ (a @ x))
    order = np.argsort(-e, kind="stable")
    return e[order], x[:, order]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors to double precision: solved in float32, then refined."""
    top = np.abs(a).max(initial=0)
    if top == 0:
        return np.zeros(len(a)), np.eye(len(a))
    e, x = refined(a / top, np.linalg.eigh((a / top).astype(np.float32))[1])
    return (e * top).astype(np.float64), x.astype(np.float64)


def exact(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """n * x - s; Python integers where a long is too short."""
    if n * (MOST + SHIFT) < 2**62:
        return n * x - s.astype(np.int64)
    return n * x.astype(object) - s


def deviations(d: np.ndarray) -> list[int | None]:
    most = max(int(d.max()), -int(d.min()))
    if most * most * d.shape[1] < 2**63:
        return (d * d).sum(axis=1).tolist()
    return [t if (t := int(v @ v)) < 2**63 else None for v in d.astype(object)]


def whiten(df: DataFrame, vector: str = "embedding", id_: str = "vec_id", most: int = COMPONENTS) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` of each row and component."""
    kind = df.schema[id_].dataType.simpleString()
    out = f"`{id_}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = finite_rows(df, vector, id_)
    found = stored(sums(rows), "whitening-sums")
    first = found.where("i = 0").orderBy(F.desc("n"), "size").select("size", "n").first()
    if first is None:
        return df.sparkSession.createDataFrame([], out)
    size, n = first
    s = np.array([int(r["s"]) for r in found.where(F.col("size") == size).orderBy("i").collect()], dtype=object)  # a row a dimension
    centre = np.array([(2 * t + n) // (2 * n) for t in s], dtype=np.int64)
    rest = s - n * centre.astype(object)
    v = np.zeros((size, size))
    for r in products(rows, size, centre).toLocalIterator():  # a row a pair of dimensions
        i, j = r["i"], r["j"]
        v[i, j] = v[j, i] = (n * int(r["v"]) - int(rest[i]) * int(rest[j])) / (n * n)
    e, x = eigen(v)
    k = min(most, size)
    floor = e[0] * size * 2.0**-52
    sure = e[:k] > max(floor, 0)
    turn = x[:, :k] / np.sqrt(np.where(sure, e[:k], 1))
    explained = np.maximum(e[:k], 0) / np.trace(v) if np.trace(v) > 0 else np.zeros(k)

    def whitened(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = exact(entries, n, s)
        return d, (d / n).astype(np.float64) @ turn

    def moments(batches):
        total = np.zeros((k + 1, k))
        for batch in small_slices(batches, SLICE):
            for found, _, entries in by_length(batch):
                if found == size:
                    w = whitened(entries)[1]
                    total += np.vstack([w.T @ w, w.sum(axis=0)])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "v": total.ravel()})

    m = np.zeros((k + 1, k))
    for r in rows.select("v").mapInArrow(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # a row a pair of components
        m[r["i"], r["j"]] = r["v"] / n
    off = np.abs(m[:k] - np.outer(m[k], m[k]) - np.eye(k))[np.ix_(sure, sure)]
    error = float(off.max()) if off.size else None

    def emit(batches):
        for batch in small_slices(batches, 512):
            for found, at, entries in by_length(batch):
                if found == size:
                    d, w = whitened(entries)
                    ids = batch.column(0).take(pa.array(np.repeat(at, k)))
                    gone = np.tile(~sure, len(at))
                    yield pa.RecordBatch.from_arrays([
                        ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * k, n)),
                        pa.array(deviations(d), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                        pa.array(w.ravel(), mask=gone), pa.array(np.tile(explained, len(at))), pa.array([error] * (len(at) * k), pa.float64())],
                        [id_, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(emit, out)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table("embeddings")(spark, sf_dir))
