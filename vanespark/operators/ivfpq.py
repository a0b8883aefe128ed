"""Inverted lists with product-quantised residuals: probe, score by table lookup, and rank the best again by their vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanespark.functions.vectors import Metric, decayed, tags_match
from vanespark.operators import kernel, opq
from vanespark.operators.ivf import asked, filed_lists, probe_lists, scan, unit_rows
from vanespark.operators.pq import ProductQuantizer
from vanespark.operators.topk import top_k
from vanespark.plans import kmeans

#: From so many candidates a query, a search asks whether they are all that its lists hold.
MANY = 10_000


@dataclass(frozen=True)
class IvfPqParams:
    nlist: int = 64
    nprobe: int = 8
    refine: int = 100
    m: int = 8
    nbits: int = 8
    iters: int = 15
    opq_mode: str = "none"
    seed: int = 0
    sample: int = kmeans.SAMPLE
    store_vectors: bool = True


@dataclass(frozen=True)
class IvfPqIndex:
    """lists: (list_id, vec_id, codes, embedding or null, tags, ts). Centroids are in the transformed space, as the codes are."""

    metric: Metric
    params: IvfPqParams
    transform: opq.Transform
    centroids: np.ndarray
    quantizer: ProductQuantizer
    lists: DataFrame

    @classmethod
    def build(cls, rows: DataFrame, metric: Metric = Metric.COSINE, params: IvfPqParams = IvfPqParams()) -> IvfPqIndex:
        """From (vec_id, embedding[, tags][, ts]). The transform comes from the covariance of all rows, centroids and codebooks
        from one bounded sample; all rows are encoded."""
        for name in ("tags", "ts"):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast("long"))
        _, x = kmeans.sample_rows(rows, params.sample, params.seed)
        if not len(x):
            raise ValueError("an index needs a row at least")
        params = replace(params, nlist=max(1, min(params.nlist, len(x))))
        transform = opq.train_on_all(unit_rows(rows, metric), params.m, params.opq_mode)
        unit = kernel.unit if metric.is_cosine else lambda v: v
        x = transform.apply(unit(x))
        c = kmeans.fit(x, params.nlist, metric, params.seed)
        own = kmeans.distances(x, c).argmin(axis=1)
        quantizer = ProductQuantizer.train(x - c[own], params.m, params.nbits, params.iters, params.seed)
        keep = params.store_vectors
        dim = x.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                y = transform.apply(unit(kernel.matrix(b.column(1), dim)))
                at = np.round(kmeans.distances(y, c), 12).argmin(axis=1) if len(y) else np.empty(0, dtype=int)
                codes = quantizer.encode(y - c[at])
                vec = b.column(1) if keep else pa.nulls(b.num_rows, b.column(1).type)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column(0), pa.array([r.tobytes() for r in codes], type=pa.binary()), vec, b.column(2), b.column(3)], names=["list_id", "vec_id", "codes", "embedding", "tags", "ts"])

        lists = rows.select("vec_id", "embedding", "tags", "ts").mapInArrow(run, "list_id int, vec_id long, codes binary, embedding array<float>, tags long, ts long")
        return cls(metric, params, transform, c, quantizer, lists)

    def filed(self, path: str | None = None) -> IvfPqIndex:
        """With its lists written as Parquet by list, under ``path`` or in the shared folder: a search then reads the rows as
        they were encoded, and only the lists it probes."""
        return replace(self, lists=filed_lists(self.lists, path))

    def without(self, ids: DataFrame) -> IvfPqIndex:
        """The index less the rows of ``ids`` (vec_id)."""
        return replace(self, lists=self.lists.join(ids.select("vec_id").distinct(), "vec_id", "left_anti").select(self.lists.columns))

    def candidates(self, queries: DataFrame, n: int, nprobe: int | None = None, tag_mask: int | None = None, tag_mode: str = "any", now: int = 0, rate: float = 0.0) -> DataFrame:
        """(qid, vec_id, score, rk): the n best rows by table lookup. The inner product with a row is that with its list's
        centroid and that with its residual, so scores of different lists compare."""
        rows = self.lists if tag_mask is None else self.lists.where(tags_match("tags", tag_mask, tag_mode))
        parts = []
        for qids, q in kernel.query_blocks(queries, kernel.block_for(n)):
            q, probes = self._asks(q, nprobe)
            some = rows.where(F.col("list_id").isin([int(x) for x in np.unique(probes)]))
            parts.append(self._scan(some, qids, q, probes, n, now, rate))
        if not parts:
            return self.lists.sparkSession.createDataFrame([], f"{kernel.HITS_DDL}, rk long")
        return top_k(reduce(DataFrame.unionByName, parts), n)

    def _asks(self, q: np.ndarray, nprobe: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The queries as the codes see them, and the lists they probe."""
        q = self.transform.apply(kernel.unit(q) if self.metric.is_cosine else q)
        return q, probe_lists(q, self.centroids, Metric.L2, nprobe or self.params.nprobe)

    @cached_property
    def sizes(self) -> np.ndarray:
        """Rows of each list, falling."""
        return np.sort([r[1] for r in self.lists.groupBy("list_id").count().collect()])[::-1]

    def _scan(self, rows: DataFrame, qids: np.ndarray, q: np.ndarray, probes: np.ndarray, n: int, now: int, rate: float) -> DataFrame:
        asks, metric, centroids, pq = asked(probes), self.metric, self.centroids, self.quantizer

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a sum of looked up products or distances is that of the query and the decoded row: one product of matrices
            tops, scorer = kernel.Tops(qids, n), kernel.Scorer(metric, q)
            for b in batches:
                of, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
                codes = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint8).reshape(-1, pq.m)
                fade = kernel.fading(b.column(3).to_numpy(zero_copy_only=False), now, rate) if rate > 0 else None
                for c in np.unique(of):
                    at = np.flatnonzero(of == c)
                    x = centroids[c] + pq.decode(codes[at])
                    yield from tops.add(asks[int(c)], ids[at], scorer.of(x, None if fade is None else fade[at], whole=False))
            yield from tops.rest()

        return kernel.spread(rows.select("list_id", "vec_id", "codes", "ts"), len(qids)).mapInArrow(run, kernel.HITS_DDL)

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None, refine: int | None = None, tag_mask: int | None = None, tag_mode: str = "any", now: int = 0, rate: float = 0.0) -> DataFrame:
        """(qid, vec_id, score, rk). With stored vectors the best max(refine, k) are scored exactly, with the same decay; else
        the lookup's scores stand."""
        n = max(refine if refine is not None else self.params.refine, k)
        if self.params.store_vectors and n >= MANY and n >= self.sizes[: nprobe or self.params.nprobe].sum():
            return self._exact(queries, k, nprobe, tag_mask, tag_mode, now, rate)
        found = self.candidates(queries, n, nprobe, tag_mask, tag_mode, now, rate)
        if not self.params.store_vectors:
            return found.where(F.col("rk") <= k)
        return rescored(found, queries, self.lists.select("vec_id", "embedding", "ts"), self.metric, k, now, rate)

    def _exact(self, queries: DataFrame, k: int, nprobe: int | None, tag_mask: int | None, tag_mode: str, now: int, rate: float) -> DataFrame:
        """A search that ranks again whatever it probes: the vectors of the probed lists are scored where they are, and no list of
        all pairs is written for that."""
        rows = self.lists if tag_mask is None else self.lists.where(tags_match("tags", tag_mask, tag_mode))
        parts = []
        for qids, q in kernel.query_blocks(queries, kernel.block_for(k)):
            probes = self._asks(q, nprobe)[1]
            some = rows.where(F.col("list_id").isin([int(x) for x in np.unique(probes)]))
            parts.append(scan(some, qids, q, probes, self.metric, k, now, rate))
        if not parts:
            return self.lists.sparkSession.createDataFrame([], f"{kernel.HITS_DDL}, rk long")
        return top_k(reduce(DataFrame.unionByName, parts), k)


def rescored(found: DataFrame, queries: DataFrame, rows: DataFrame, metric: Metric, k: int, now: int = 0, rate: float = 0.0) -> DataFrame:
    """The k best of candidates (qid, vec_id) by their vectors, which are fetched only now (late materialisation)."""
    from vanespark.functions.vectors import score

    q = queries.select("qid", F.col("embedding").alias("_q"))
    full = found.select("qid", "vec_id").join(rows, "vec_id").join(q, "qid")
    s = score(metric, "_q", "embedding")
    if rate > 0:
        s = decayed(s, "ts", now, rate)
    return top_k(full.select("qid", "vec_id", s.alias("score")), k)
