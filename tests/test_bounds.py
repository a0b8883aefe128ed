"""What a search holds and writes is bounded, whatever the tables."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vanespark.functions.vectors import Metric
from vanespark.operators import flat, ivf, ivfpq, kernel, opq, pq


def _in_a_task(q, x, k, metric=Metric.COSINE, now=0, rate=0.0):
    """(hits, peak bytes) of the function that FlatIndex.search gives to a task, over one Arrow batch."""
    class Rows:
        def select(self, *_):
            return self

        def repartition(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.run = run
            return self

        sparkSession = type("S", (), {"sparkContext": type("C", (), {"defaultParallelism": 1})})

    rows = Rows()
    blocks, ranked = kernel.query_blocks, flat.top_k
    kernel.query_blocks, flat.top_k = (lambda *_: [(np.arange(len(q)), q)]), (lambda df, _: df)
    try:
        flat.FlatIndex(rows, metric).search(None, k, now=now, rate=rate)
    finally:
        kernel.query_blocks, flat.top_k = blocks, ranked
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(list(x), pa.list_(pa.float64())), pa.array(np.arange(len(x)))], names=["vec_id", "embedding", "ts"])
    tracemalloc.start()
    got = [b for b in rows.run([batch])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    best: dict = {}
    for b in got:
        for i, v, s in zip(*(b.column(j).to_pylist() for j in range(3))):
            best.setdefault(i, []).append((-round(s, 9), v))
    return {i: [v for _, v in sorted(r)[:k]] for i, r in best.items()}, peak


def test_a_block_of_queries_and_a_batch_of_rows_meet_in_tiles():
    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(4096, 16)), rng.normal(size=(10_000, 16))
    x[5_000:7_000] = x[:2_000]  # ties go to the lower id
    got, peak = _in_a_task(q, x, 5)
    s = np.round(kernel.scores(Metric.COSINE, q[:200], x), 9)
    assert len(got) == 4096
    for i in range(200):
        assert got[i] == list(np.lexsort((np.arange(len(x)), -s[i]))[:5])
    assert peak < 100e6  # the whole matrix alone has 328 MB


def test_hits_beyond_what_a_task_holds_are_given_out_early(monkeypatch):
    monkeypatch.setattr(kernel, "HELD", 1000)
    rng = np.random.default_rng(2)
    q, x = rng.normal(size=(30, 8)), rng.normal(size=(5_000, 8))
    x[7] = np.nan
    got, _ = _in_a_task(q, x, 60, Metric.L2)
    s = kernel.scores(Metric.L2, q, np.delete(x, 7, axis=0))
    ids = np.delete(np.arange(5_000), 7)
    assert all(got[i] == list(ids[np.lexsort((ids, -np.round(s[i], 9)))[:60]]) for i in range(30))


class _Rows:
    """A table that keeps the function a search gives to its tasks."""

    sparkSession = type("S", (), {"sparkContext": type("C", (), {"defaultParallelism": 1})})

    def select(self, *_):
        return self

    def repartition(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self


def _traced(run, batch):
    """(qid -> ids, best first, and peak bytes) of a task over one Arrow batch."""
    tracemalloc.start()
    got = list(run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    hits: dict = {}
    for b in got:
        for i, v, s in zip(*(b.column(j).to_pylist() for j in range(3))):
            hits.setdefault(i, []).append((-round(s, 9), v))
    return {i: [v for _, v in sorted(r)] for i, r in hits.items()}, peak


@pytest.mark.parametrize("metric, rate", [(Metric.L2, 0.0), (Metric.COSINE, 0.01)])
def test_decay_and_lengths_are_of_a_tile(metric, rate):
    rng = np.random.default_rng(4)
    q, x = rng.normal(size=(4096, 16)), rng.normal(size=(10_000, 16))
    got, peak = _in_a_task(q, x, 5, metric, now=1500, rate=rate)
    s = kernel.scores(metric, q[:100], x)
    s = np.round(kernel.decayed(s, kernel.fading(np.arange(len(x)), 1500, rate)) if rate else s, 9)
    assert all(got[i] == list(np.lexsort((np.arange(len(x)), -s[i]))[:5]) for i in range(100))
    assert len(got) == 4096 and peak < 100e6


def test_lists_that_are_probed_meet_their_queries_in_tiles():
    rng = np.random.default_rng(5)
    q, x, of = rng.normal(size=(4096, 16)), rng.normal(size=(10_000, 16)), np.arange(10_000) % 2
    rows, probes = _Rows(), np.array([[0, 1], [1, 2]])[np.arange(4096) % 2]
    ivf.scan(rows, np.arange(4096), q, probes, Metric.COSINE, 5)
    batch = pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(np.arange(len(x))), pa.array(list(x), pa.list_(pa.float64()))], names=["list_id", "vec_id", "embedding"])
    got, peak = _traced(rows.run, batch)
    s = np.round(kernel.scores(Metric.COSINE, q[:100], x), 9)
    for i in range(100):
        seen = np.flatnonzero(np.isin(of, probes[i]))
        assert got[i] == list(seen[np.lexsort((seen, -s[i, seen]))[:5]])
    assert len(got) == 4096 and peak < 100e6


def test_candidates_by_codes_come_from_tiles():
    rng = np.random.default_rng(6)
    books = pq.ProductQuantizer(rng.normal(size=(4, 32, 4)))
    q, codes = rng.normal(size=(4096, 16)), books.encode(rng.normal(size=(10_000, 16)))
    rows = _Rows()
    index = ivfpq.IvfPqIndex(Metric.COSINE, ivfpq.IvfPqParams(nlist=1, nprobe=1), opq.Transform(16), np.zeros((1, 16)), books, rows)
    index._scan(rows, np.arange(4096), kernel.unit(q), np.zeros((4096, 1), dtype=int), 40, 0, 0.0)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(10_000), pa.int32()), pa.array(np.arange(10_000)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.arange(10_000))], names=["list_id", "vec_id", "codes", "ts"])
    got, peak = _traced(rows.run, batch)
    s = np.round(kernel.unit(q[:100]) @ books.decode(codes).T, 9)
    assert all(got[i] == list(np.lexsort((np.arange(10_000), -s[i]))[:40]) for i in range(100))
    assert len(got) == 4096 and peak < 150e6


def test_ranking_all_of_the_probed_rows_again_writes_no_list_of_pairs(spark, sf):
    from vanespark.operators.flat import FlatIndex
    from vanespark.operators.ivfpq import IvfPqIndex, IvfPqParams

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("ts", F.col("vec_id") * 3)
    asks = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    index = IvfPqIndex.build(rows, params=IvfPqParams(nlist=4, nprobe=4, refine=1 << 30, m=8, nbits=4)).filed()
    found = index.search(asks, 5, now=1500, rate=0.01)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    key = lambda hits: {(r.qid, r.rk, r.vec_id, round(r.score, 6)) for r in hits.collect()}
    assert key(found) == key(FlatIndex(rows).search(asks, 5, now=1500, rate=0.01))


def test_a_sweep_makes_the_truth_once(spark):
    from vanespark.plans import evaluate

    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    truth = spark.range(6).selectExpr("id AS qid", "id AS vec_id").mapInArrow(run, "qid long, vec_id long")
    asks = spark.range(6).selectExpr("id AS qid", "array(1.0f, float(id)) AS embedding")
    answer = lambda n: lambda q, k: q.selectExpr("qid", "qid AS vec_id", "1L AS rk").where(f"qid < {n}")
    got = {r.config: r for r in evaluate.sweep(answer, truth, asks, 1, singles=1, n=[3, 6]).collect()}
    assert made.value == 6
    assert [got[f"n={n}"].recall for n in (3, 6)] == [0.5, 1.0] and all(r.deterministic for r in got.values())
    shaky = lambda n: lambda q, k: q.selectExpr("qid", "uuid() AS vec_id", "1L AS rk").selectExpr("qid", "xxhash64(vec_id) AS vec_id", "rk")
    assert not evaluate.sweep(shaky, truth, asks, 1, singles=0, n=[1]).first().deterministic


def test_the_sql_form_sorts_no_table_of_all_pairs(spark):
    from vanespark.operators.flat import FlatIndex

    rng = np.random.default_rng(3)
    x = rng.normal(size=(6_000, 4)).round(1)
    x[3_000:] = x[0]  # many copies: ties at the last place
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(6_000, None), (6_001, [1.0]), (6_002, [0.0] * 4), (6_003, [float("nan")] * 4)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4)
    asks = rows.where("vec_id % 500 = 0 AND vec_id < 6000").selectExpr("vec_id AS qid", "embedding")
    whole = rows.where("vec_id < 6000 OR vec_id = 6002")
    key = lambda hits: {(r.qid, r.rk, r.vec_id, round(r.score, 6)) for r in hits.collect()}
    for metric in Metric:
        found = FlatIndex(rows, metric).search_sql(asks, 5)
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
        assert key(found) == key(FlatIndex(whole, metric).search(asks, 5))
        pairs = found._jdf.queryExecution().optimizedPlan().collectLeaves().head().relation().location().inputFiles()
        assert spark.read.parquet(*pairs).count() < 12 * 6_000 / 10
