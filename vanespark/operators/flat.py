"""Exact search: every row is scored."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanespark.functions.vectors import Metric, normalized, score
from vanespark.operators import kernel
from vanespark.operators.topk import top_k, top_k_single
from vanespark.tables import written


class FlatIndex:
    """A table (vec_id, embedding, ...) searched exactly.

    Batches of queries go to the tasks in blocks of bounded size and meet each Arrow batch of rows in tiles of bounded size; each
    task returns k rows a query.
    """

    def __init__(self, rows: DataFrame, metric: Metric = Metric.COSINE, dim: int | None = None):
        self.rows, self.metric = rows, metric
        self._dim = dim

    @property
    def dim(self) -> int:
        if self._dim is None:
            first = self.rows.select(F.size("embedding")).first()
            self._dim = first[0] if first else 0
        return self._dim

    def count(self) -> int:
        return self.rows.count()

    def add(self, more: DataFrame) -> FlatIndex:
        return FlatIndex(self.rows.unionByName(more, allowMissingColumns=True), self.metric, self._dim)

    def without(self, ids: DataFrame) -> FlatIndex:
        """The index less the rows of ``ids`` (vec_id)."""
        return FlatIndex(self.rows.join(ids.select("vec_id").distinct(), "vec_id", "left_anti"), self.metric, self._dim)

    def search(self, queries: DataFrame, k: int, where: Column | None = None, now: int = 0, rate: float = 0.0) -> DataFrame:
        """(qid, vec_id, score, rk) of the k best rows for each of queries (qid, embedding). With ``rate`` > 0 scores weaken with
        the age of a row's ts at ``now``."""
        rows = self.rows if where is None else self.rows.where(where)
        rows = rows.select("vec_id", "embedding", *(["ts"] if rate > 0 else []))
        metric = self.metric
        parts = []
        for qids, q in kernel.query_blocks(queries, kernel.block_for(k)):

            def run(batches: Iterator[pa.RecordBatch], qids=qids, q=q) -> Iterator[pa.RecordBatch]:
                tops, scorer, every = kernel.Tops(qids, k), kernel.Scorer(metric, q), np.arange(len(qids))
                for b in batches:
                    x = kernel.matrix(b.column(1), q.shape[1])
                    fade = kernel.fading(b.column(2).to_numpy(zero_copy_only=False), now, rate) if rate > 0 else None
                    yield from tops.add(every, b.column(0).to_numpy(), scorer.of(x, fade))
                yield from tops.rest()

            parts.append(kernel.spread(rows, len(qids)).mapInArrow(run, kernel.HITS_DDL))
        if not parts:
            return rows.sparkSession.createDataFrame([], f"{kernel.HITS_DDL}, rk long")
        return top_k(reduce(DataFrame.unionByName, parts), k)

    def search_sql(self, queries: DataFrame, k: int) -> DataFrame:
        """As :meth:`search`, in column expressions alone. Vectors are columns of numbers, so that a pair's score is compiled code.

        Pairs are never sorted as a whole: the best of a sample of rows, chosen by a hash of the id, hold a query's k-th place
        from below, and of sixteen times as many rows only those that reach it are written and ranked, up to all rows. Queries
        are broadcast in blocks of bounded size.
        """
        spark = self.rows.sparkSession
        dim, n = self.rows.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)), F.count(F.lit(1))).first()
        dealt = max(spark.sparkContext.defaultParallelism, 12)
        blocks = max(1, -(-queries.count() // kernel.BLOCK_QUERIES))
        q, v = ([F.col(f"{c}{i}") for i in range(dim)] for c in "qv")
        terms = [a * b if self.metric.is_cosine else (a - b) * (a - b) for a, b in zip(q, v)]
        total = reduce(lambda s, x: s + x, terms, F.lit(0.0))
        score_ = total if self.metric.is_cosine else -total
        step = 1
        while n >= 512 * k * step:
            step *= 16
        kth = spark.range(0).select(F.col("id").alias("qid"), F.col("id").alias("_at"), F.lit(0.0).alias("_s"))
        while True:
            some = self.rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(step)) == 0) if step > 1 else self.rows
            some = _unrolled(some, "vec_id", "v", dim, self.metric).repartition(dealt, "vec_id")  # not from a file: its columns could be null
            low = _unrolled(queries, "qid", "q", dim, self.metric).join(kth, "qid", "left")
            low = low.withColumn("_low", F.coalesce(F.col("_s") - 1e-9, F.lit(-float("inf")))).withColumn("_high", F.coalesce(F.col("_s") + 4e-10, F.lit(-float("inf"))))
            # equal lengths as two comparisons: an equality would be a join by a key that all rows share
            fits = (F.col("qn") <= F.col("vn")) & (F.col("qn") >= F.col("vn")) & (score_ >= F.when(F.col("vec_id") > F.coalesce("_at", F.lit((1 << 63) - 1)), F.col("_high")).otherwise(F.col("_low")))
            of = F.pmod(F.xxhash64("qid"), F.lit(blocks))
            pairs = [some.join(F.broadcast(low.where(of == i)), fits).select("qid", "vec_id", score_.alias("score")) for i in range(blocks)]  # BLOCK_QUERIES rows
            best = top_k(written(reduce(DataFrame.unionByName, pairs), "pairs"), k)
            if step == 1:
                return best
            floors = best.where(F.col("rk") == k).select("qid", F.col("vec_id").alias("_at"), F.round("score", kernel.DECIMALS).alias("_s"))
            kth = written(floors, "floors")
            step //= 16

    def search_one(self, vector: list[float], k: int) -> DataFrame:
        """(vec_id, score) of the k best rows for one vector."""
        q = F.lit([float(x) for x in vector])
        return top_k_single(self.rows.select("vec_id", score(self.metric, q, "embedding").alias("score")), k)


def _unrolled(rows: DataFrame, id_col: str, name: str, dim: int, metric: Metric) -> DataFrame:
    """(id, length, a column for each of ``dim`` places), zeros beyond a vector's length; of length one under cosine. Vectors that
    are null or hold nulls score nothing and are left out."""
    whole = normalized("embedding") if metric.is_cosine else F.col("embedding").cast("array<double>")
    rows = rows.where(F.col("embedding").isNotNull() & ~F.exists("embedding", F.isnull)).select(id_col, whole.alias("_v"))
    places = (F.coalesce(F.get("_v", F.lit(i)), F.lit(0.0)).alias(f"{name}{i}") for i in range(dim))
    return rows.select(id_col, F.size("_v").alias(f"{name}n"), *places)
