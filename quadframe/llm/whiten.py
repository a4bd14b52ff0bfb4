"""Whitening of embeddings: integer grid, covariance over distinct vectors, components by QDWH divide and conquer.

Each entry c becomes floor(256 c). The fit list holds each distinct grid vector once, so copies have no weight. One pass
over it gives exact sums, one the covariance of centred vectors; what comes back are sums for each dimension or pair of
dimensions, whatever the number of rows. On the driver the covariance, whose size is that of the dimensions, is
split: the polar factor of the shifted matrix, by the dynamically weighted Halley iteration in its QR and Cholesky forms,
is the matrix sign, half of it and the identity the projector on the eigenvalues above the shift; bases of it and of its
complement give two smaller matrices, which are split again until each is a single component. The components, over
the roots of their eigenvalues, are broadcast and applied to every row.

Rows whose vector is null or holds a null or non-finite entry are left out, and so are rows whose length isn't that of most
distinct vectors (of equally many, the longest). Entries beyond long integers count as the nearest long. Repeated rows and
repeated or null identifiers stay rows of their own; other columns don't matter. Components whose eigenvalue is zero up
to rounding don't exist, so there are none, and no rows, of an empty table, of a single distinct vector or of empty vectors. Equal
eigenvalues share a space in which any basis is right; one is taken for all rows. A deviation that no long holds is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Work

GRID = 256
_EPS = np.finfo(float).eps


def sign(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QDWH."""
    n, one = len(a), np.eye(len(a))
    x = a / np.linalg.norm(a)
    try:
        low = min(1.0, max(1 / np.linalg.norm(np.linalg.inv(x)), 1e-17))
    except np.linalg.LinAlgError:
        low = 1e-17
    for _ in range(20):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        p = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low * low) / (low * low * np.sqrt(1 + d))))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        before = x
        if r > 100:
            both = np.linalg.qr(np.vstack([np.sqrt(r) * x, one]))[0]
            x = q / r * x + (p - q / r) / np.sqrt(r) * both[:n] @ both[n:].T
        else:
            x = q / r * x + (p - q / r) * np.linalg.solve(one + r * x.T @ x, x.T).T
        x = (x + x.T) / 2
        low = min(1.0, low * (p + q * low * low) / (1 + r * low * low))
        if 1 - low < 10 * _EPS and np.linalg.norm(x - before) < np.cbrt(5 * _EPS):
            break
    return x


def halves(a: np.ndarray, tiny: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant spaces of a symmetric matrix; None if all its eigenvalues are equal up to tiny."""
    n, diagonal = len(a), np.diag(a)
    mean = diagonal.mean()
    spread = np.linalg.norm(a - mean * np.eye(n))
    if spread <= tiny:
        return None
    rng, best = np.random.default_rng(n), None
    # A shift that is an eigenvalue itself doesn't split well; others near the middle do.
    for shift in (np.median(diagonal), mean, *(mean + spread / np.sqrt(n) * np.array([0.11, -0.13, 0.29, -0.31, 0.53, -0.57, 0.83, -0.89]))):
        if not np.linalg.norm(a - shift * np.eye(n)):
            continue
        above = (sign(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = round(float(np.trace(above)))
        if not 0 < k < n:
            continue
        basis = np.linalg.qr(above @ np.linalg.qr(rng.standard_normal((n, n)))[0])[0]
        upper = np.linalg.qr(above @ basis[:, :k])[0]
        both = np.linalg.qr(np.hstack([upper, basis[:, k:] - above @ basis[:, k:]]))[0]
        off = np.linalg.norm(both[:, k:].T @ a @ both[:, :k])
        if best is None or off < best[0]:
            best = off, both[:, :k], both[:, k:]
        if off <= tiny:
            break
    return best and best[1:]


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows, the largest entry of each positive."""
    tiny, done, todo = 20 * len(v) * _EPS * np.linalg.norm(v), [], [np.eye(len(v))]
    while todo:
        basis = todo.pop()
        here = basis.T @ v @ basis
        two = halves((here + here.T) / 2, tiny) if basis.shape[1] > 1 else None
        if two is None:
            done.extend(basis.T)
        else:
            todo.extend(basis @ half for half in two)
    out = np.array([x / np.linalg.norm(x) for x in done])
    values = np.einsum("ij,jk,ik->i", out, v, out)
    order = np.argsort(-values, kind="stable")
    out = out[order]
    out *= np.sign(out[np.arange(len(out)), np.abs(out).argmax(axis=1)])[:, None]
    return values[order], out


@dataclass(frozen=True)
class Whitening:
    """n: vectors of the fit list; sums: theirs; values, vectors: components; trace: of the covariance; error: largest entry of whitened covariance minus identity."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float = 0.0


def grid(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places of the usable vectors and their grid."""
    lengths = np.asarray(vectors.value_lengths().fill_null(0))
    flat = np.floor(GRID * vectors.flatten().to_numpy(zero_copy_only=False).astype(float))  # null becomes NaN
    ends, wrong = np.cumsum(lengths), np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    usable = np.asarray(vectors.is_valid()) & (wrong[ends] == wrong[ends - lengths])
    out = {}
    for d in np.unique(lengths[usable]):
        at = np.flatnonzero(usable & (lengths == d))
        rows = flat[(ends[at] - d)[:, None] + np.arange(d)]
        out[int(d)] = at, np.where(rows >= 2.0**63, np.iinfo(np.int64).max, np.clip(rows, -(2.0**63), 2.0**63 - 1024).astype(np.int64))
    return out


def _spell(row: np.ndarray) -> bytes:
    """Bytes of a grid vector, each entry in as few as its largest needs."""
    most = max(int(row.max(initial=0)), -int(row.min(initial=0)) - 1)
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w - 1)
    return bytes([width]) + row.astype(f"<i{width}").tobytes()


def _read(keys: list[bytes], d: int) -> np.ndarray:
    out = np.empty((len(keys), d), np.int64)
    widths = np.array([k[0] for k in keys])
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        out[at] = np.frombuffer(b"".join([keys[i][1:] for i in at]), f"<i{w}").reshape(len(at), d)
    return out


def fit_list(rows: DataFrame, vector: str) -> DataFrame:
    """(d, key): each distinct grid vector once, with its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, (_, x) in grid(batch.column(0)).items():
                keys = list(dict.fromkeys(_spell(row) for row in x))
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(keys), pa.int32()), pa.array(keys, pa.binary())], ["d", "key"])

    return rows.select(F.col(f"`{vector}`").cast("array<double>").alias("v")).mapInArrow(run, "d int, key binary").distinct()


def centred(x: np.ndarray, n: int, sums: np.ndarray, scale: float) -> np.ndarray:
    """x - sums / n; scale bounds n x - sums."""
    return (n * x - sums.astype(np.int64)) / n if scale < 2.0**62 else x - sums.astype(float) / n


def _scale(n: int, sums: np.ndarray, most: int) -> float:
    return float(n) * most + max(map(abs, map(float, sums)), default=0.0)


def _products(keys: DataFrame, d: int, n: int, sums: np.ndarray, scale: float, matrix: np.ndarray | None) -> np.ndarray:
    """Sum over the list of y yT, y centred, or matrix y followed by a one."""
    size = d if matrix is None else len(matrix) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros((size, size)), False
        for batch in batches:
            y = centred(_read(batch.column(0).to_pylist(), d), n, sums, scale)
            y = y if matrix is None else np.hstack([y @ matrix.T, np.ones((len(y), 1))])
            total, any_ = total + y.T @ y, True
        if any_:
            i, j = np.triu_indices(size)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    out = np.zeros((size, size))
    for i, j, v in keys.select("key").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = out[j, i] = v
    return out


def fit(rows: DataFrame, vector: str, most: int | None = None) -> Whitening | None:
    """Of the vectors in a column; most: components that will be used, all by default. None without vectors."""
    work = Work(rows.sparkSession, "whiten")
    keys = work.save(fit_list(rows, vector), "list")
    # One row for each length.
    sizes = [(m, d) for d, m in keys.groupBy("d").count().collect()]
    if not sizes or not max(sizes)[1]:
        return None
    n, d = max(sizes)
    keys = keys.filter(F.col("d") == d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _read(batch.column(0).to_pylist(), d)
            top = max((abs(int(x.max())), abs(int(x.min()))))
            totals = (x if float(top) * len(x) < 2.0**62 else x.astype(object)).sum(axis=0).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(map(str, totals))), pa.array([str(top)] * d)], ["i", "total", "top"])

    parts = keys.select("key").mapInArrow(run, "i int, total string, top string").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")), F.max(F.col("top").cast("decimal(38,0)"))).collect()
    sums, top = np.array([int(t) for _, t, _ in sorted(parts)], object), max(int(m) for *_, m in parts)
    scale = _scale(n, sums, top)
    covariance = _products(keys, d, n, sums, scale, None) / n
    values, vectors = components(covariance)
    count = int((values > d * _EPS * np.abs(values).max()).sum())
    count = count if most is None else min(count, most)
    error = 0.0
    if count:
        matrix = vectors[:count] / np.sqrt(values[:count])[:, None]
        seen = _products(keys, d, n, sums, scale, matrix) / n
        error = float(np.abs(seen[:-1, :-1] - np.outer(seen[-1, :-1], seen[-1, :-1]) - np.eye(count)).max())
    work.clear()
    return Whitening(n, tuple(sums), values[:count], vectors[:count], float(np.trace(covariance)), error)


def whiten(rows: DataFrame, model: Whitening, key: str, vector: str) -> DataFrame:
    """(key, whitened array, deviation) for each usable row."""
    d, matrix = len(model.sums), model.vectors / np.sqrt(model.values)[:, None]
    shared = rows.sparkSession.sparkContext.broadcast((model.n, np.array(model.sums, object), matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, matrix = shared.value
        wrapped = np.array([s & (1 << 64) - 1 for s in sums], np.uint64)
        for batch in batches:
            at, x = grid(batch.column(1)).get(d, ((), ()))
            if not len(at):
                continue
            y = centred(x, n, sums, _scale(n, sums, int(np.abs(x.astype(float)).max())))
            # Whole numbers wrap around; where the result fits a long, it is right.
            off = np.uint64(n) * x.view(np.uint64) - wrapped
            exact = (off * off).sum(axis=1, dtype=np.uint64).view(np.int64)
            fits = (np.square(y) * float(n) ** 2).sum(axis=1) < 2.0**63 * (1 - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(list(y @ matrix.T), pa.list_(pa.float64())), pa.array(exact, mask=~fits)], ["id", "whitened", "deviation"])

    kind = rows.schema[key].dataType.simpleString()
    picked = rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return picked.mapInArrow(run, f"id {kind}, whitened array<double>, deviation long").withColumnRenamed("id", key)


def whitened_components(rows: DataFrame, key: str, vector: str, most: int) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each usable row and its first components."""
    model, kind = fit(rows, vector, most), rows.schema[key].dataType.simpleString()
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    each = whiten(rows, model, key, vector).select(key, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    return each.select(key, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(model.error).alias("identity_error"))
