"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Tasks summarise their vectors by count, exact sums, mean, and all singular values and right singular vectors of the centred rows;
two summaries merge by stacking their scaled vectors and one row that corrects for the distance of their means and decomposing
again, which loses nothing.  Summaries merge in a tree of fixed fan-in, so no task and no driver ever holds more of them than that.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import stored

#: Steps of an entry: entries become whole numbers of 1/SCALE.
SCALE = 256
#: Components returned.
COMPONENTS = 4
#: Vectors decomposed at once, and summaries merged at once.
BLOCK, FAN_IN = 4096, 16
#: A variance below this share of the largest is none.
NOTHING = 1e-13

SUMMARY = "part long, n long, sums array<string>, mean array<double>, scaled array<double>"


class Summary(NamedTuple):
    """Of n vectors: exact sums, mean, and rows (singular value times vector) whose Gram matrix is that of the centred vectors."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scaled: np.ndarray


def decomposed(rows: np.ndarray) -> np.ndarray:
    """Singular values times right singular vectors, all of them."""
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return values[:, None] * vectors


def summary(x: np.ndarray) -> Summary:
    """Of whole-number vectors."""
    sums = [sum(c) for c in x.astype(object).T] if np.abs(x).max() > (1 << 62) // len(x) else x.sum(axis=0).tolist()
    mean = np.array([s / len(x) for s in sums])
    return Summary(len(x), sums, mean, decomposed(x - mean))


def merged(a: Summary, b: Summary) -> Summary:
    """The summary of both sets of vectors: the last row stands for the distance of their means."""
    n, sums = a.n + b.n, [p + q for p, q in zip(a.sums, b.sums, strict=True)]
    correction = np.sqrt(a.n / n * b.n) * (a.mean - b.mean)
    return Summary(n, sums, np.array([s / n for s in sums]), decomposed(np.concatenate([a.scaled, b.scaled, correction[None, :]])))


def merge_all(parts: Iterator[Summary]) -> Summary | None:
    whole = None
    for part in parts:
        whole = part if whole is None else merged(whole, part)
    return whole


def whole_numbers(embeddings: DataFrame, vector: str, dimension: int) -> DataFrame:
    """Rows that take part, with ``x``: floor(SCALE * entry) of each entry as a long."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return embeddings.where(v.isNotNull() & (F.size(v) == dimension) & finite).withColumn("x", x)


def most_common_dimension(embeddings: DataFrame, vector: str) -> int:
    """The length that most vectors have, the smallest of equals; 0 without vectors of an entry."""
    sizes = embeddings.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), "d").first()
    return first["d"] if first else 0


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """A column of lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def written(s: Summary | None, part: int) -> Iterator[pa.RecordBatch]:
    """One row of SUMMARY, or none; exact sums travel as text."""
    if s is not None:
        columns = [pa.array([part]), pa.array([s.n]), pa.array([list(map(str, s.sums))]), pa.array([s.mean.tolist()], pa.list_(pa.float64())), pa.array([s.scaled.ravel()])]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "n", "sums", "mean", "scaled"])


def summaries(rows: dict) -> Iterator[Summary]:
    """What ``written`` wrote, from columns of Python values."""
    for n, sums, mean, scaled in zip(rows["n"], rows["sums"], rows["mean"], rows["scaled"], strict=True):
        yield Summary(n, list(map(int, sums)), np.array(mean), np.array(scaled).reshape(-1, len(mean)))


class Whitening(NamedTuple):
    """What whitens: number, exact sums and mean of the fitted vectors, components as rows, and their variances, the largest first."""

    n: int
    sums: list[int]
    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray

    def whiten(self, x: np.ndarray, k: int) -> np.ndarray:
        """Coordinates along the first k components in units of their deviations; NaN where a component has no variance."""
        e = self.variances[:k]
        scale = np.where(e > NOTHING * self.variances[0], e, np.nan)
        return (x - self.mean) @ self.components[:k].T / np.sqrt(scale)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Per row the exact sum of (n * x - S)^2; None beyond a long."""
        sums, most = self.sums, max([self.n * int(np.abs(x).max(initial=0)), *map(abs, self.sums)])
        if len(sums) * (2 * most) ** 2 < 1 << 63:
            return ((self.n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
        return [d if d < 1 << 63 else None for d in exact]


def fit_list(rows: DataFrame) -> DataFrame:
    """Each different ``x`` once."""
    return stored(rows.select("x").distinct())


def fit(vectors: DataFrame, dimension: int) -> Whitening | None:
    """The whitening of all rows of ``x``, or None without rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        blocks = (summary(matrix(b.column(0).slice(at, BLOCK), dimension)) for b in batches for at in range(0, b.num_rows, BLOCK))
        yield from written(merge_all(blocks), TaskContext.get().partitionId() // FAN_IN)

    def join(group: pa.Table) -> pa.Table:
        rows = group.to_pydict()
        return pa.Table.from_batches(written(merge_all(summaries(rows)), rows["part"][0] // FAN_IN))

    now, left = vectors.select("x").mapInArrow(part, SUMMARY), vectors.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN_IN)
        now = now.groupBy("part").applyInArrow(join, SUMMARY)
    whole = next(summaries(now.toArrow().to_pydict()), None)
    if whole is None:
        return None
    _, values, components = np.linalg.svd(whole.scaled)
    variances = np.append(values**2 / whole.n, np.zeros(dimension - len(values)))
    return Whitening(whole.n, whole.sums, whole.mean, components, variances)


def identity_error(vectors: DataFrame, model: Whitening, k: int) -> float:
    """The largest absolute entry of the covariance of the whitened ``x`` rows minus the identity, over components that have variance."""
    dimension = len(model.mean)
    real = int((model.variances[:k] > NOTHING * model.variances[0]).sum())
    if not real:
        return 0.0

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((real + 1, real))
        for batch in batches:
            y = model.whiten(matrix(batch.column(0), dimension), real)
            total += np.concatenate([y.sum(axis=0)[None, :], y.T @ y])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], names=["total"])

    cells = vectors.select("x").mapInArrow(part, "total array<double>").select(F.posexplode("total").alias("at", "v"))
    total = {r["at"]: r["v"] for r in cells.groupBy("at").agg(F.sum("v").alias("v")).collect()}
    means, products = np.split(np.array([total[i] for i in range((real + 1) * real)]).reshape(real + 1, real) / model.n, [1])
    return float(np.abs(products - means.T @ means - np.eye(real)).max())


def transform(rows: DataFrame, model: Whitening, id_column: str, k: int) -> DataFrame:
    """(id, deviation long, whitened array<double> of k coordinates) of rows with ``x``."""
    dimension = len(model.mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dimension)
            y = model.whiten(x, k)
            flat = pa.array(y.ravel(), mask=np.isnan(y.ravel()))
            whitened = pa.ListArray.from_arrays(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.deviations(x), pa.int64()), whitened], names=["id", "deviation", "whitened"])

    kind = dict(rows.dtypes)[id_column]
    return rows.select(F.col(id_column).alias("id"), "x").mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")


def whiten(embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """Per row and component: (id, component int from 1, n, deviation, whitened, explained, identity_error).

    Entries become ``x = floor(256 * entry)``.  Rows whose vector is null, empty, holds a null or an entry that is not finite,
    or has another length than most, are left out; every other row is returned, repeated ones too, a null id stays.  The fit takes
    each different vector once, so ties and copies do not weigh.  ``n`` is their number, ``deviation`` the exact sum of
    (n * x - S)^2 (null beyond a long), ``whitened`` the coordinate along the component of unit length over the root of its
    variance, ``explained`` its share of the variance, ``identity_error`` the largest absolute entry of the whitened fit list's
    covariance minus the identity.  A component without variance has a null coordinate.  There are at most as many
    components as dimensions; an entry beyond a long counts as the nearest long.  Other columns are left out, so their names
    cannot clash; an empty table gives an empty table.
    """
    rows = embeddings.select(F.col(id_column).alias("id"), F.col(vector).alias("v"))
    dimension = most_common_dimension(rows, "v")
    rows = whole_numbers(rows, "v", dimension).select("id", "x")
    vectors = fit_list(rows)
    model = fit(vectors, dimension) if dimension else None
    schema = f"{id_column} {dict(embeddings.dtypes)[id_column]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    k = min(k, dimension)
    share = model.variances / (model.variances.sum() or 1)
    explained = F.array(*(F.lit(float(v)) for v in share[:k]))
    each = transform(rows, model, "id", k).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    told = [F.col("id").alias(id_column), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(identity_error(vectors, model, k)).alias("identity_error")]
    return each.select(*told)
