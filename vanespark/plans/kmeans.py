"""Seeded k-means: k-means++ (Arthur & Vassilvitskii 2007) and Lloyd's iterations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vanespark.functions.vectors import Metric
from vanespark.operators import kernel
from vanespark.tables import written

#: Rows a trainer looks at, at most; assignment is over all rows.
SAMPLE = 50_000


def sample_rows(rows: DataFrame, n: int = SAMPLE, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of at most n rows, chosen by a hash of id and seed and ordered by id: the same however rows are dealt."""
    got = rows.select("vec_id", "embedding").orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(n).collect()
    got.sort(key=lambda r: r[0])
    return np.array([r[0] for r in got], dtype=np.int64), np.array([r[1] for r in got], dtype=np.float64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T), 0)


def seeds(x: np.ndarray, k: int, seed: int = 0) -> list[int]:
    """k places of ``x``: the first at random, each other with a chance that follows its squared distance from those before."""
    rng = np.random.Generator(np.random.Philox(seed))
    at = [int(rng.integers(len(x)))]
    near = distances(x, x[at])[:, 0]
    while len(at) < k:
        total = near.sum()
        new = int(np.searchsorted(np.cumsum(near), rng.random() * total, side="right")) if total > 0 else int(rng.integers(len(x)))
        at.append(min(new, len(x) - 1))
        near = np.minimum(near, distances(x, x[at[-1:]])[:, 0])
    return at


def strided(rows: DataFrame, n: int) -> DataFrame:
    """Every s-th row in order of vec_id, s being the least stride that leaves at most ``n`` rows.

    Places come from range partitions and their sizes: the rows are never in one task.
    """
    total = rows.count()
    if not total:
        return rows
    dealt = written(rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id").withColumn("_at", F.monotonically_increasing_id()), "strided")
    dealt = dealt.withColumn("_part", F.shiftrightunsigned("_at", 33))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("c"))
    before = sizes.select("_part", (F.sum("c").over(W.orderBy("_part")) - F.col("c")).alias("_before"))  # a row a partition
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(before, "_part").where(place % -(-total // n) == 0).select(rows.columns)


def fit(x: np.ndarray, k: int, metric: Metric = Metric.L2, seed: int = 0, max_iters: int = 50, start: np.ndarray | None = None) -> np.ndarray:
    """Centroids (k, dim), from ``start`` or from k rows that :func:`seeds` picks. k must be in 1..rows. Under cosine rows and centroids have length one.

    An empty cluster takes the row that is farthest from its centroid. Ties go to the lowest index.
    """
    if not 0 < k <= len(x):
        raise ValueError(f"k must be between 1 and {len(x)}")
    if metric.is_cosine:
        x = kernel.unit(x)
    c = x[seeds(x, k, seed)].copy() if start is None else np.array(start, dtype=np.float64)
    last = None
    for _ in range(max_iters):
        d = distances(x, c)
        own = d.argmin(axis=1)
        if last is not None and (own == last).all():
            break
        last = own
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        far = d[np.arange(len(x)), own].argsort(kind="stable")[::-1]
        for j, i in zip(np.flatnonzero(n == 0), far):
            c[j] = x[i]
        if metric.is_cosine:
            c = kernel.unit(c)
    return c


def assign(rows: DataFrame, centroids: np.ndarray, unit: bool = False) -> DataFrame:
    """``rows`` with list_id, the nearest centroid of embedding (of length one under ``unit``), ties to the lowest. Centroids are a fixed number of vectors."""
    from pyspark.sql.types import IntegerType, StructField, StructType

    at = rows.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = kernel.matrix(b.column(at), centroids.shape[1])
            if unit:
                x = kernel.unit(x)
            own = np.round(distances(x, centroids), 12).argmin(axis=1).astype(np.int32) if len(x) else np.empty(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own)], names=[*b.schema.names, "list_id"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("list_id", IntegerType())]))


def update(assigned: DataFrame) -> DataFrame:
    """One Lloyd update over all rows: (list_id, n, centroid) by partial sums in every task."""
    parts = assigned.select("list_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    means = parts.groupBy("list_id", "i").agg(F.avg("v").alias("m"), F.count("v").alias("n"))
    return means.groupBy("list_id").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centroid"))


def refine(rows: DataFrame, centroids: np.ndarray, metric: Metric = Metric.L2, rounds: int = 1) -> np.ndarray:
    """Lloyd rounds over all rows from centroids of a sample; a list that nothing falls to keeps its centroid."""
    for _ in range(rounds):
        centroids = centroids.copy()
        for r in update(assign(rows, centroids)).collect():  # as many rows as centroids
            centroids[r["list_id"]] = r["centroid"]
        if metric.is_cosine:
            centroids = kernel.unit(centroids)
    return centroids
