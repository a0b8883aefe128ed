"""Inverted lists: rows are dealt to their nearest centroid, and a search scores the lists of the centroids nearest to it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vanespark.functions.vectors import Metric, normalized, tags_match
from vanespark.operators import kernel
from vanespark.operators.topk import top_k
from vanespark.plans import kmeans
from vanespark.tables import new_path


@dataclass(frozen=True)
class IvfParams:
    nlist: int = 64
    nprobe: int = 8
    seed: int = 0
    max_iters: int = 50
    sample: int = kmeans.SAMPLE


def unit_rows(rows: DataFrame, metric: Metric) -> DataFrame:
    return rows.withColumn("embedding", normalized("embedding").cast("array<float>")) if metric.is_cosine else rows


def probe_lists(q: np.ndarray, centroids: np.ndarray, metric: Metric, nprobe: int) -> np.ndarray:
    """For each query the nprobe best lists, ties to the lowest."""
    s = np.round(kernel.scores(metric, q, centroids), 9)
    return np.argsort(-s, axis=1, kind="stable")[:, : max(1, min(nprobe, len(centroids)))]


@dataclass(frozen=True)
class IvfIndex:
    """lists: (list_id, vec_id, embedding, tags, version, deleted). Reading lists that were saved by list prunes partitions."""

    metric: Metric
    params: IvfParams
    centroids: np.ndarray
    lists: DataFrame
    extra: dict = field(default_factory=dict)

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    @classmethod
    def build(cls, rows: DataFrame, metric: Metric = Metric.COSINE, params: IvfParams = IvfParams()) -> IvfIndex:
        """From (vec_id, embedding[, tags]). Centroids come from a bounded sample; nlist is held to its size."""
        _, x = kmeans.sample_rows(rows, params.sample, params.seed)
        if not len(x):
            raise ValueError("an index needs a row at least")
        params = replace(params, nlist=max(1, min(params.nlist, len(x))))
        c = kmeans.fit(x, params.nlist, metric, params.seed, params.max_iters)
        return cls(metric, params, c, cls._filed(rows, c, metric.is_cosine))

    @staticmethod
    def _filed(rows: DataFrame, centroids: np.ndarray, unit: bool = False) -> DataFrame:
        """Rows with the list of their nearest centroid, which under ``unit`` is that of the row brought to length one."""
        for name, value in (("tags", F.lit(None).cast("long")), ("version", F.lit(0).cast("long")), ("deleted", F.lit(False))):
            if name not in rows.columns:
                rows = rows.withColumn(name, value)
        return kmeans.assign(rows.select("vec_id", "embedding", "tags", "version", "deleted"), centroids, unit)

    def filed(self, path: str | None = None) -> IvfIndex:
        """With its lists written as Parquet by list, under ``path`` or in the shared folder: a search then assigns nothing again
        and reads only the lists it probes."""
        return replace(self, lists=filed_lists(self.lists, path))

    def without(self, ids: DataFrame) -> IvfIndex:
        """The index less the rows of ``ids`` (vec_id)."""
        return self.delete(ids)

    def probes(self, queries: DataFrame, nprobe: int | None = None) -> DataFrame:
        """(qid, list_id): the lists that a search of each query probes."""
        c, metric, n = self.centroids, self.metric, nprobe or self.params.nprobe

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = probe_lists(kernel.matrix(b.column(1), c.shape[1]), c, metric, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), at.shape[1])), pa.array(at.ravel().astype(np.int32))], names=["qid", "list_id"])

        return queries.select("qid", "embedding").mapInArrow(run, "qid long, list_id int")

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None, tag_mask: int | None = None, tag_mode: str = "all") -> DataFrame:
        """(qid, vec_id, score, rk) of the k best live rows in the probed lists."""
        rows = self.lists.where(~F.col("deleted"))
        if tag_mask is not None:
            rows = rows.where(tags_match("tags", tag_mask, tag_mode))
        parts = []
        for qids, q in kernel.query_blocks(queries, kernel.block_for(k)):
            probes = probe_lists(q, self.centroids, self.metric, nprobe or self.params.nprobe)
            some = rows.where(F.col("list_id").isin([int(x) for x in np.unique(probes)]))
            parts.append(scan(some, qids, q, probes, self.metric, k))
        if not parts:
            return rows.sparkSession.createDataFrame([], f"{kernel.HITS_DDL}, rk long")
        return top_k(reduce(DataFrame.unionByName, parts), k)

    def delete(self, ids: DataFrame) -> IvfIndex:
        """Tombstones for ``ids`` (vec_id); ids the index lacks do nothing (see :meth:`missing`)."""
        gone = ids.select("vec_id").distinct().withColumn("_gone", F.lit(True))
        lists = self.lists.join(gone, "vec_id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone")
        return replace(self, lists=lists)

    def missing(self, ids: DataFrame) -> DataFrame:
        """Those of ``ids`` that no live row has."""
        return ids.select("vec_id").distinct().join(self.lists.where(~F.col("deleted")).select("vec_id"), "vec_id", "left_anti")

    def upsert(self, rows: DataFrame) -> IvfIndex:
        """Rows (vec_id, embedding[, tags]) replace or join the index: the latest version of an id counts, and lives again.

        A row without tags keeps those its id had.
        """
        rows = rows if "tags" in rows.columns else rows.withColumn("tags", F.lit(None).cast("long"))
        top = self.lists.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
        new = self._filed(rows.withColumn("version", F.lit(top + 1).cast("long")).withColumn("deleted", F.lit(False)), self.centroids, self.metric.is_cosine)
        return replace(self, lists=latest(self.lists.unionByName(new)))

    def compact(self) -> IvfIndex:
        """Without tombstoned rows, in order of id inside each list."""
        return replace(self, lists=self.lists.where(~F.col("deleted")).repartition("list_id").sortWithinPartitions("list_id", "vec_id"))


def filed_lists(lists: DataFrame, path: str | None = None) -> DataFrame:
    """``lists`` as a table partitioned by list, in order of id inside each."""
    spark = lists.sparkSession
    path = path or new_path(spark, "lists")
    lists.repartition("list_id").sortWithinPartitions("list_id", "vec_id").write.partitionBy("list_id").parquet(path)
    return spark.read.schema(lists.schema).parquet(path).select(lists.columns)


def latest(rows: DataFrame) -> DataFrame:
    """The last version of each vec_id, with the newest tags that aren't null."""
    w = W.partitionBy("vec_id").orderBy(F.col("version").desc())
    back = w.rowsBetween(0, W.unboundedFollowing)
    rows = rows.withColumn("tags", F.first("tags", ignorenulls=True).over(back)).withColumn("_nth", F.row_number().over(w))
    return rows.where("_nth = 1").drop("_nth")


def asked(probes: np.ndarray) -> dict[int, np.ndarray]:
    """For each probed list the places of the queries that probe it."""
    return {int(c): np.flatnonzero((probes == c).any(axis=1)) for c in np.unique(probes)}


def scan(rows: DataFrame, qids: np.ndarray, q: np.ndarray, probes: np.ndarray, metric: Metric, k: int, now: int = 0, rate: float = 0.0) -> DataFrame:
    """Hits (qid, vec_id, score) by the vectors of probed lists: the k best a query and task."""
    asks = asked(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, scorer = kernel.Tops(qids, k), kernel.Scorer(metric, q)
        for b in batches:
            of, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = kernel.matrix(b.column(2), q.shape[1])
            fade = kernel.fading(b.column(3).to_numpy(zero_copy_only=False), now, rate) if rate > 0 else None
            for c in np.unique(of):
                at = np.flatnonzero(of == c)
                yield from tops.add(asks[int(c)], ids[at], scorer.of(x[at], None if fade is None else fade[at]))
        yield from tops.rest()

    rows = rows.select("list_id", "vec_id", "embedding", *(["ts"] if rate > 0 else []))
    return kernel.spread(rows, len(qids)).mapInArrow(run, kernel.HITS_DDL)
