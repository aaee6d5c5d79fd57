"""Whitening of embeddings by a compensated covariance.

Entries become integers, so means are exact fractions, held as double-doubles. Each task centres its different vectors
and adds up their outer products in double-double: products and sums by error-free transformations (Dekker's
product, Knuth's sum), so the large common offset of the integers costs no digits. High and low parts are merged over
tasks, a row of the matrix at a time. The symmetric matrix, of dimension squared entries whatever the number of
vectors, is brought to tridiagonal form and solved by divide and conquer (LAPACK's ``syevd`` behind ``numpy.linalg.eigh``).
A last pass over the different vectors measures how far the whitened ones' covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkey.llm.shared import in_tasks, materialised, sorted_groups

STEP, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Entries of a chunk of products.
CHUNK = 1 << 17
#: Integers beyond it are taken as it.
LARGEST = 1 << 52


# --- double-double arithmetic on arrays --------------------------------------------------------


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and its rounding error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded product and its rounding error, exactly."""
    p = a * b
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    return p, al * bl - (((p - ah * bh) - al * bh) - ah * bl)


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = a * 134217729.0
    high = t - (t - a)
    return high, a - high


def dd_add(ah: np.ndarray, al: np.ndarray, bh: np.ndarray, bl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e = two_sum(ah, bh)
    t, f = two_sum(al, bl)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


class OuterSums:
    """The upper triangle of a sum of outer products of double-double vectors, in double-double."""

    def __init__(self, dim: int):
        self.i, self.j = np.triu_indices(dim)
        self.high, self.low = np.zeros(len(self.i)), np.zeros(len(self.i))

    def add(self, high: np.ndarray, low: np.ndarray) -> None:
        step = max(1, CHUNK // max(1, len(self.i)))
        for at in range(0, len(high), step):
            h, l = high[at : at + step], low[at : at + step]
            a, b = h[:, self.i], h[:, self.j]
            p, e = two_product(a, b)
            e += a * l[:, self.j] + l[:, self.i] * b
            while len(p) > 1:  # a tree over the chunk's rows
                half = len(p) // 2
                s, f = dd_add(p[:half], e[:half], p[half : 2 * half], e[half : 2 * half])
                p, e = np.concatenate([s, p[2 * half :]]), np.concatenate([f, e[2 * half :]])
            if len(p):
                self.high, self.low = dd_add(self.high, self.low, p[0], e[0])


# --- the model ---------------------------------------------------------------------------------


@dataclass
class Whitening:
    """Of the vectors of one length: what takes a vector to its components."""

    dim: int
    n: int
    sums: list[int]
    axes: np.ndarray | None = None  # a component a row
    values: np.ndarray | None = None
    trace: float = 0.0
    identity_error: float | None = None

    def __post_init__(self) -> None:
        means = [Fraction(s, self.n) for s in self.sums]
        self.mean = np.array([float(m) for m in means], np.float64)
        self.mean_rest = np.array([float(m - Fraction(float(m))) for m in means], np.float64)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, e = two_sum(x.astype(np.float64), -self.mean)
        return two_sum(s, e - self.mean_rest)

    def fit(self, high: np.ndarray, low: np.ndarray) -> None:
        """Components from the sums of outer products, upper triangle; ``values`` by falling size."""
        v = np.zeros((self.dim, self.dim))
        v[np.triu_indices(self.dim)] = (high + low) / self.n
        v += np.triu(v, 1).T
        values, axes = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:COMPONENTS]
        axes = axes.T[order]
        signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)]) if len(axes) else np.zeros(0)
        self.axes, self.values, self.trace = axes * signs[:, None], values[order], float(np.trace(v))
        # what is zero but for rounding has no direction: its components have no whitened value
        self.values[self.values <= self.dim * np.finfo(float).eps * max(values, default=0.0)] = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        high, low = self.centred(x)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (high @ self.axes.T + low @ self.axes.T) / np.sqrt(self.values), np.nan)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of ``n * x - sums``, exactly; None beyond 64 bits."""
        most = self.n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, self.sums), default=0)
        if most < 1 << 63:
            z = x * self.n - np.array(self.sums, np.int64)
            if int(np.abs(z).max(initial=0)) ** 2 * max(self.dim, 1) < 1 << 63:
                return (z * z).sum(1).tolist()
        exact = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums)) for row in x]
        return [d if d < 1 << 63 else None for d in exact]


def integers(vectors: DataFrame) -> DataFrame:
    """``(vec_id, dim, x)`` of rows whose vector is not null and has finite entries only."""
    v = F.col("embedding")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c.cast("double") * STEP))) + OFFSET)
    return vectors.where(v.isNotNull()).where(~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.size(v).alias("dim"), x.alias("x"))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The lengths in a batch, with the rows that have them and their integers as a matrix."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        flat = batch.column("x").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield dim, at, flat.astype(np.int64).reshape(len(at), dim)


def _counts(fit: DataFrame) -> dict[int, Whitening]:
    """n and the exact sums of every length: as many rows as entries of one vector come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for dim, _, x in _by_dim(batch):
                own = found.setdefault(dim, [0, [0] * dim])
                own[0] += len(x)
                # 52-bit integers: up to 1024 of them have an exact 64-bit sum
                for at in range(0, len(x), 1024):
                    own[1] = [a + b for a, b in zip(own[1], x[at : at + 1024].sum(0).tolist())]
        for dim, (n, sums) in found.items():
            yield pa.RecordBatch.from_pylist([{"dim": dim, "i": i, "s": str(s)} for i, s in enumerate([n, *sums])], pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("s", pa.string())]))

    rows = in_tasks(fit, run, "dim int, i int, s string").groupBy("dim", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    totals: dict[int, dict[int, int]] = {}
    for r in rows:
        totals.setdefault(r["dim"], {})[r["i"]] = int(r["s"])
    return {dim: Whitening(dim, t[0], [t[i + 1] for i in range(dim)]) for dim, t in totals.items()}


def outer_sums(fit: DataFrame, models: dict[int, Whitening], whitened: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sums of outer products of the centred vectors of ``fit``, or of the whitened ones: high and low parts by length."""
    schema = pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("high", pa.list_(pa.float64())), ("low", pa.list_(pa.float64()))])
    ddl = "dim int, i int, high array<double>, low array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, OuterSums] = {}
        for batch in batches:
            for dim, _, x in _by_dim(batch):
                model = models[dim]
                if whitened:
                    y = model.whitened(x)[:, model.values > 0]
                    parts = y, np.zeros_like(y)
                else:
                    parts = model.centred(x)
                found.setdefault(dim, OuterSums(parts[0].shape[1])).add(*parts)
        for dim, sums in found.items():
            rows = [{"dim": dim, "i": i, "high": sums.high[sums.i == i], "low": sums.low[sums.i == i]} for i in np.unique(sums.i).tolist()]
            yield pa.RecordBatch.from_pylist(rows, schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for dim, i, high, low in zip(*(batch.column(c) for c in schema.names)):
                key, h, l = (dim.as_py(), i.as_py()), high.values.to_numpy(), low.values.to_numpy()
                if key == last:
                    held = dd_add(*held, h, l)
                    continue
                if last is not None:
                    yield one(last, held)
                last, held = key, (h, l)
        if last is not None:
            yield one(last, held)

    def one(key: tuple[int, int], parts: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"dim": key[0], "i": key[1], "high": parts[0], "low": parts[1]}], schema)

    # from each task a row of the matrix a record; rows merge side by side, one record after the other
    rows = in_tasks(fit, run, ddl).repartition("dim", "i").sortWithinPartitions("dim", "i").mapInArrow(merge, ddl).collect()
    found: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["dim"], r["i"])):
        found.setdefault(r["dim"], []).append((r["high"], r["low"]))
    return {dim: tuple(np.concatenate([np.array(r[k]) for r in parts]) for k in (0, 1)) for dim, parts in found.items()}


def fitted(fit: DataFrame) -> dict[int, Whitening]:
    """A whitening for every length of vector among ``fit(dim, x)``, different vectors."""
    models = _counts(fit)
    for dim, parts in outer_sums(fit, models, whitened=False).items():
        models[dim].fit(*parts)
    for model in models.values():
        if model.axes is None:  # vectors without entries
            model.fit(np.zeros(0), np.zeros(0))
    for dim, (high, low) in outer_sums(fit, models, whitened=True).items():
        size = int((models[dim].values > 0).sum())
        off = (high + low) / models[dim].n - (lambda i, j: i == j)(*np.triu_indices(size))
        models[dim].identity_error = float(np.abs(off).max()) if size else None
    return models


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row a vector and component.

    ``vectors(vec_id, embedding)``; other columns are ignored. Vectors that are null or hold null or non-finite entries
    are left out. Different vectors make the fit, repeated ones count once, every row is whitened; a null vec_id stays null.
    Vectors of another length are fitted and whitened among themselves; one without entries has no component. Where all
    different vectors agree in a direction (a single vector in all of them) the whitened value is null, and so is
    ``explained`` if nothing varies at all, and ``identity_error`` if no component has a value. Entries beyond 2**52 / 64 are taken as that. ``deviation``
    is null beyond 64 bits. No rows in, no rows out.
    """
    rows = integers(vectors)
    fit = materialised(rows.select("dim", "x").distinct(), "fit")
    models = fitted(fit)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in _by_dim(batch):
                model = models[dim]
                k = min(components, len(model.values))
                each = lambda a: a.take(pa.array(np.repeat(np.arange(len(x)), k)))
                explained = model.values[:k] / model.trace if model.trace > 0 else np.full(k, np.nan)
                every = k * len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        each(batch.column("vec_id").take(pa.array(at))), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(every, model.n), pa.int64()),
                        each(pa.array(model.deviation(x), pa.int64())), pa.array(model.whitened(x)[:, :k].ravel(), from_pandas=True), pa.array(np.tile(explained, len(x)), from_pandas=True),
                        pa.array([model.identity_error] * every, pa.float64()),
                    ],
                    schema=schema,
                )

    return in_tasks(rows, run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
