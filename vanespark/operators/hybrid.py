"""Search over a base index, a table of later rows and tombstones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanespark.functions.vectors import Metric
from vanespark.operators.flat import FlatIndex
from vanespark.operators.protocol import AnnIndex
from vanespark.operators.topk import top_k


@dataclass(frozen=True)
class HybridIndex:
    """base: an index over rows that may be tombstoned; delta: later rows, searched exactly."""

    base: AnnIndex
    delta: DataFrame
    tombstones: DataFrame
    metric: Metric = Metric.COSINE

    @classmethod
    def over(cls, rows: DataFrame, delta: DataFrame, tombstones: DataFrame, metric: Metric = Metric.COSINE) -> HybridIndex:
        """With an exact base."""
        return cls(FlatIndex(rows, metric), delta, tombstones, metric)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, vec_id, score, rk) of the k best live rows. Dead rows leave the base's lists before anything is ranked, so k rows
        come back whenever so many live where the base looks."""
        dead = self.tombstones.select("vec_id").distinct()
        old = self.base.without(dead).search(queries, k)
        fresh = FlatIndex(self.delta, self.metric).without(dead).search(queries, k)
        return top_k(old.select("qid", "vec_id", "score").unionByName(fresh.select("qid", "vec_id", "score")), k)


def mutate(rows: DataFrame, every: int = 10, add: int = 100, first_id: int = 999_000, seed: int = 1337) -> tuple[DataFrame, DataFrame]:
    """(delta, tombstones) of a stress test: every n-th id dies, and random unit vectors join."""
    from vanespark.sources.datagen import gaussian_sphere

    dim = rows.select(F.size("embedding")).first()[0]
    delta = gaussian_sphere(rows.sparkSession, add, dim, seed, first_id=first_id)
    return delta, rows.where(F.col("vec_id") % every == 0).select("vec_id")
