"""Embedding whitening: components of the covariance of exactly centred whole-number vectors.

Entries become whole numbers, so sums are exact, and every row is centred before anything is multiplied: with
m the mean rounded to a whole number and r = sum - n * m, an entry x leaves (x - m) - r / n, in which the
large parts cancel without rounding.  MLlib's RowMatrix adds up the Gramian of these rows; over n it is the
covariance, whose eigenvectors are found on the driver (it is dimensions x dimensions, whatever the rows).
The components then go to all tasks, which project the rows in Arrow batches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliarc.llm.common import prepare, quoted, written

WIDEST = 65_535  # dimensions, MLlib's own limit for a Gramian
LARGEST = 1 << 52  # entries saturate here, before offset is added
FLAT = 1e-12  # share of all variance at or below which a component has none
HALF = 26  # bits, so that a task's sums fit in long
DECIMALS = 10**38  # of a decimal(38,0), exclusive


def sound(v: Column) -> Column:
    """Whether a vector is there and holds neither nulls nor entries that are not finite."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def covariance(centred: DataFrame, n: int) -> np.ndarray:
    """Gramian over n of the one column of centred, arrays of doubles of one length."""
    (name,) = centred.columns
    rows = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector(name).alias(name)), name)
    return RowMatrix(rows).computeGramianMatrix().toArray() / n


def column_sums(rows: DataFrame, d: int) -> list[int]:
    """Exact sums by place of the arrays of longs in column x, each of d entries; a task sends d rows."""

    def sums(batches):
        import pyarrow as pa

        high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for b in batches:
            x = _matrix(b.column("x"), d)
            high += (x >> HALF).sum(0)
            low += (x & ((1 << HALF) - 1)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(high), pa.array(low)], ["at", "high", "low"])

    total = rows.select("x").mapInArrow(sums, "at int, high long, low long").groupBy("at")
    got = total.agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).collect()
    out = [0] * d
    for r in got:
        out[r["at"]] = (int(r["high"]) << HALF) + int(r["low"])
    return out


def _matrix(column, d: int) -> np.ndarray:
    """An Arrow column of lists of d entries as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


@dataclass
class Whitener:
    n: int
    mean: list[int]  # rounded
    rest: list[int]  # sum - n * mean
    axes: np.ndarray  # dimensions x components, unit columns by falling eigenvalue
    values: np.ndarray  # eigenvalues
    trace: float

    def __post_init__(self):
        self._mean, self._shift = np.array(self.mean, np.int64), np.array([r / self.n for r in self.rest])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; nan along components without variance."""
        y = (x - self._mean).astype(np.float64) - self._shift
        flat = self.values <= FLAT * self.trace
        return np.where(flat, np.nan, y @ self.axes / np.sqrt(np.where(flat, 1.0, self.values)))

    def deviations(self, x: np.ndarray) -> list[Decimal | None]:
        """Sum of (n * x - sum)^2 by row, exact; None beyond a decimal of 38 digits."""
        a, r, n = x - self._mean, self.rest, self.n
        most, top = max(1, int(np.abs(a).max(initial=0))), max([1, *map(abs, r)])
        kind = np.int64 if max(1, a.shape[1]) * most * max(most, top) < 1 << 62 else object
        a, r = a.astype(kind), np.array(r, kind)
        fixed = sum(int(v) ** 2 for v in self.rest)
        got = (n * n * int(s) - 2 * n * int(t) + fixed for s, t in zip((a * a).sum(1), (a * r).sum(1)))
        return [Decimal(v) if v < DECIMALS else None for v in got]


def fit(rows: DataFrame, d: int, components: int) -> Whitener:
    """The whitener of all rows' x, arrays of d longs."""
    n = rows.count()
    sums = column_sums(rows, d)
    mean = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, mean)]
    m, shift = F.lit(mean).cast("array<long>"), F.lit([r / n for r in rest]).cast("array<double>")
    v = covariance(rows.select(F.zip_with(F.zip_with("x", m, lambda x, y: (x - y).cast("double")), shift, lambda a, s: a - s).alias("y")), n)
    values, axes = np.linalg.eigh((v + v.T) / 2)
    values, axes = np.maximum(values[::-1][:components], 0), axes[:, ::-1][:, :components]
    lead = axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])]
    return Whitener(n, mean, rest, axes * np.where(lead < 0, -1.0, 1.0), values, float(np.trace(v)))


def identity_error(z: DataFrame, n: int, live: list[int]) -> float | None:
    """Largest absolute entry of (covariance of z - identity), over the components that have variance."""
    if not live:
        return None
    means = z.agg(*[F.avg(F.col("z")[i]) for i in live]).first()
    centred = z.select(F.array(*[F.col("z")[i] - F.lit(float(mean)) for i, mean in zip(live, means)]).alias("z"))
    return float(np.abs(covariance(centred, n) - np.eye(len(live))).max())


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whiten every row of vectors along the first components of all rows' covariance.

    An entry c becomes x = floor(scale * c) + offset, floor saturating at 2^52.  Rows whose vector is null or
    holds a null or an entry that is not finite are left out.  Returns for each other row and component (from 1,
    by falling eigenvalue): ``id_col``, component, n (rows fitted), deviation (decimal(38,0): sum over
    dimensions of (n * x - sum)^2, exact; null beyond 38 digits), whitened, explained (eigenvalue over trace),
    identity_error (one value: how far the covariance of whitened is from the identity).  A component's sign is
    such that its largest entry is positive.

    A component without variance (equal rows, or fewer rows than dimensions) has whitened null; explained is
    null where there is no variance at all.  The fit list is the rows of the commonest length, the longer of
    equally common ones; rows of another length are not of that space and have deviation and whitened null.
    Ids are passed through, so null and repeated ids are rows of their own; an empty table, or one of empty
    vectors, gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col("v")
    own = vectors.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vector_col)).cast("array<double>").alias("v")).where(sound(v))
    entry = lambda c: F.least(F.greatest(F.floor(c * scale), F.lit(-LARGEST)), F.lit(LARGEST)) + F.lit(offset).cast("long")
    own = written(own.select("id", F.transform("v", entry).alias("x")), "whiten-x")
    kind = own.schema["id"].dataType.simpleString()
    schema = f"id {kind}, deviation decimal(38,0), z array<double>"
    most = own.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most["d"] if most else 0
    if d > WIDEST:
        raise ValueError(f"vectors of {d} entries: at most {WIDEST} can be whitened")
    k = min(components, d)
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if not k:
        return own.limit(0).selectExpr("id", "1", "1L", "cast(0 as decimal(38,0))", "0D", "0D", "0D").toDF(*names)
    rows = own.where(F.size("x") == d)
    model = fit(rows, d, k)
    shared = spark.sparkContext.broadcast(model)

    def work(batches):
        import pyarrow as pa

        m = shared.value
        for b in batches:
            x = _matrix(b.column("x"), d)
            z = pa.array(m.project(x).ravel(), from_pandas=True)  # nan to null
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(m.deviations(x), pa.decimal128(38, 0)), pa.ListArray.from_arrays(ends, z)], ["id", "deviation", "z"])

    z = written(rows.mapInArrow(work, schema), "whiten-z")
    live = [i for i in range(k) if model.values[i] > FLAT * model.trace]
    error = identity_error(z, model.n, live)
    rest = own.where(F.size("x") != d).select("id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.array_repeat(F.lit(None).cast("double"), k).alias("z"))
    share = F.lit([float(e / model.trace) for e in model.values] if model.trace > 0 else [None] * k).cast("array<double>")
    out = z.unionByName(rest).select("id", "deviation", F.posexplode("z").alias("at", "whitened"))
    out = out.select("id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long"), "deviation", "whitened", F.get(share, F.col("at")), F.lit(error).cast("double"))
    return out.toDF(*names)
