import pytest

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from tests.oracle import assert_same
from vanespark import queries as q
from vanespark.operators.flat import FlatIndex
from vanespark.plans import evaluate, kmeans

SQL = q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, name):
    assert_same(q.queries()[name](spark, sf), SQL[name], sf)


def _embeddings(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    return rows, q._asks(rows)


def test_trained_lists_find_most_neighbours(spark):
    sf = "/root/testdata/sf0.1"
    rows, asks = _embeddings(spark, sf)
    truth = FlatIndex(rows).search(asks, q.K)
    assert evaluate.recall(truth, q.queries()["ivf_trained_search"](spark, sf), q.K).agg(F.avg("recall")).first()[0] >= 0.9
    old = q._tagged(rows)
    truth = FlatIndex(old).search(asks, q.K, now=q.NOW, rate=0.0005)
    assert evaluate.recall(truth, q.queries()["ivfpq_opq_search"](spark, sf), q.K).agg(F.avg("recall")).first()[0] >= 0.9


def test_kmeans_fit_is_that_of_numpy(spark, sf):
    rows, _ = _embeddings(spark, sf)
    x = np.array([r.embedding for r in rows.orderBy("vec_id").collect()], dtype=np.float64)
    c = kmeans.fit(x, q.NLIST, seed=3)
    for _ in range(2):
        own = ((x[:, None] - c[None]) ** 2).sum(-1).round(12).argmin(1)
        c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(q.NLIST)])
    own = ((x[:, None] - c[None]) ** 2).sum(-1).round(12).argmin(1)
    got = {r.list_id: r for r in q.queries()["kmeans_fit"](spark, sf).collect()}
    assert {j: r.n for j, r in got.items()} == {j: int((own == j).sum()) for j in range(q.NLIST) if (own == j).any()}
    assert all(np.allclose(r.centroid, x[own == j].mean(0)) for j, r in got.items())


def test_text_embed_is_that_of_plain_integers(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.vec_id: r.embedding for r in q.queries()["text_embed"](spark, sf).collect()}
    assert set(got) == set(texts)
    m = (1 << 64) - 1
    for i in sorted(texts)[:40]:
        h = 0xCBF29CE484222325
        for b in texts[i].encode():
            h = (h ^ b) * 0x100000001B3 & m
        state, out = h ^ 1, []
        for _ in range(16):
            state = state + 0x9E3779B97F4A7C15 & m
            z = (state ^ state >> 30) * 0xBF58476D1CE4E5B9 & m
            z = (z ^ z >> 27) * 0x94D049BB133111EB & m
            out.append(((z ^ z >> 31) >> 11) / (1 << 53) - 0.5)
        out = np.array(out) / np.linalg.norm(out)
        assert np.allclose(got[i], out, atol=1e-6)


def test_sweep_recall_grows_with_probes_and_refinement(spark, sf):
    got = {r.config: r for r in q.queries()["sweep_nprobe_refine"](spark, sf).collect()}
    assert set(got) == {f"nprobe={n}, refine={m}" for n in (4, 16) for m in (20, 80)} and all(r.deterministic for r in got.values())
    assert got["nprobe=16, refine=80"].recall >= max(0.9, got["nprobe=4, refine=20"].recall)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
