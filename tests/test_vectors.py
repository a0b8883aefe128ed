import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vanespark.functions import context, hashing, vectors
from vanespark.functions.embed import RandomEmbedder, embed_table
from vanespark.functions.vectors import Metric
from vanespark.operators import kernel, opq
from vanespark.operators.flat import FlatIndex
from vanespark.operators.hybrid import HybridIndex, mutate
from vanespark.operators.ivf import IvfIndex, IvfParams
from vanespark.operators.ivfpq import IvfPqIndex, IvfPqParams
from vanespark.operators.pq import ProductQuantizer
from vanespark.plans import evaluate, kmeans
from vanespark.sources import datagen, files, store


def hits(df):
    return sorted((r["qid"], r["rk"], r["vec_id"]) for r in df.collect())


@pytest.fixture(scope="module")
def rows(spark):
    return datagen.hierarchical(spark, 400, 16, seed=3).cache()


@pytest.fixture(scope="module")
def asks(rows):
    return datagen.perturbed_queries(rows, 20).cache()


def test_splitmix_first_output_and_bounds():
    assert hashing.splitmix(0, 1)[0] == 0xE220A8397B1DCDAF
    x = hashing.splitmix(7, 1000)
    assert 0 <= hashing.unit_floats(x).min() and hashing.unit_floats(x).max() < 1
    assert set(hashing.bounded(x, 3)) == {0, 1, 2}


def test_metric_names():
    assert Metric.parse(" L2 ") is Metric.L2
    with pytest.raises(ValueError):
        Metric.parse("hamming")


def test_ties_zeros_and_nan(spark):
    rows = spark.createDataFrame([(2, [1.0] * 8), (1, [1.0] * 8), (3, [0.0] * 8)], "vec_id long, embedding array<float>")
    ones = spark.createDataFrame([(0, [1.0] * 8), (1, [0.0] * 8)], "qid long, embedding array<float>")
    for found in (FlatIndex(rows).search(ones, 3), FlatIndex(rows).search_sql(ones, 3)):
        got = hits(found)
        assert [v for q, _, v in got if q == 0] == [1, 2, 3]
        assert [v for q, _, v in got if q == 1] == [1, 2, 3]
    bad = spark.createDataFrame([(9, [float("nan")] * 8)], rows.schema)
    assert {v for *_, v in hits(FlatIndex(rows.union(bad)).search(ones, 4))} == {1, 2, 3}


def test_more_asked_than_there_is_and_nothing_asked(spark, rows, asks):
    assert FlatIndex(rows).search(asks.limit(1), 1000).count() == 400
    assert FlatIndex(rows).search(asks.limit(0), 5).count() == 0
    assert FlatIndex(rows.limit(0)).search(asks, 5).count() == 0


def test_wrong_length_is_an_error(spark, asks):
    short = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="16 components"):
        FlatIndex(short).search(asks, 1).collect()


def test_probing_all_lists_is_exact(rows, asks):
    flat = hits(FlatIndex(rows).search(asks, 10))
    index = IvfIndex.build(rows, params=IvfParams(nlist=16, nprobe=16))
    assert hits(index.search(asks, 10)) == flat
    few = [evaluate.recall(FlatIndex(rows).search(asks, 10), index.search(asks, 10, nprobe=n), 10).agg(F.avg("recall")).first()[0] for n in (1, 4, 16)]
    assert few == sorted(few) and few[-1] == 1.0


def test_refining_everything_is_exact(rows, asks):
    for metric in Metric:
        flat = hits(FlatIndex(rows, metric).search(asks, 5))
        index = IvfPqIndex.build(rows, metric, IvfPqParams(nlist=8, nprobe=8, refine=400, m=4, nbits=5, opq_mode="pca-perm"))
        assert hits(index.search(asks, 5)) == flat


def test_quantised_search_finds_most(rows, asks):
    index = IvfPqIndex.build(rows, params=IvfPqParams(nlist=8, nprobe=6, refine=50, m=8, nbits=6))
    r = evaluate.measure(lambda q, k: index.search(q, k), FlatIndex(rows).search(asks, 5), asks, 5)
    assert r.recall >= 0.9 and r.deterministic


def test_no_decay_at_rate_zero_and_signs(spark):
    t = spark.createDataFrame([(0.5, 0), (-0.5, 0), (0.5, 200)], "s double, ts long")
    same = t.select(vectors.decayed("s", "ts", 100, 0.0).alias("x")).collect()
    assert [r.x for r in same] == [0.5, -0.5, 0.5]
    got = [r.x for r in t.select(vectors.decayed("s", "ts", 100, 0.01).alias("x")).collect()]
    assert got == pytest.approx([0.5 * math.exp(-1), -0.5 * math.exp(1), 0.5])


def test_tags_all_any_and_null(spark):
    t = spark.createDataFrame([(3,), (1,), (None,)], "tags long")
    assert [r[0] for r in t.select(vectors.tags_match("tags", 3)).collect()] == [True, False, False]
    assert [r[0] for r in t.select(vectors.tags_match("tags", 3, "any")).collect()] == [True, True, False]


def test_upsert_delete_compact_save_load(spark, rows, asks, tmp_path):
    index = IvfIndex.build(rows, params=IvfParams(nlist=8, nprobe=8))
    gone = rows.where("vec_id < 5")
    less = index.delete(gone)
    assert less.missing(rows.where("vec_id between 3 and 6")).count() == 2
    assert not {v for *_, v in hits(less.search(asks, 400))} & {0, 1, 2, 3, 4}
    back = less.upsert(gone.withColumn("tags", F.lit(6).cast("long"))).compact()
    assert hits(back.search(asks, 10)) == hits(index.search(asks, 10))
    assert {v for *_, v in hits(back.search(asks, 400, tag_mask=2))} == {0, 1, 2, 3, 4}
    path = f"file://{tmp_path}/index"
    print_of = store.save(back, path)
    loaded = store.load(spark, path)
    assert hits(loaded.search(asks, 10)) == hits(back.search(asks, 10))
    assert store.save(loaded, f"file://{tmp_path}/again") == print_of
    with pytest.raises(ValueError):
        spark.read.parquet(f"{path}/lists").limit(3).write.mode("overwrite").parquet(f"{path}/lists2")
        import shutil

        shutil.rmtree(tmp_path / "index/lists")
        shutil.move(tmp_path / "index/lists2", tmp_path / "index/lists")
        store.load(spark, path)


def test_quantised_save_load(spark, rows, asks, tmp_path):
    index = IvfPqIndex.build(rows, params=IvfPqParams(nlist=4, nprobe=4, m=4, nbits=4, opq_mode="pca-perm"))
    store.save(index, f"file://{tmp_path}/pq")
    assert hits(store.load(spark, f"file://{tmp_path}/pq").search(asks, 5)) == hits(index.search(asks, 5))


def test_hybrid_after_mutation_is_exact_over_live_rows(rows, asks):
    delta, dead = mutate(rows.select("vec_id", "embedding"), add=20)
    live = rows.join(dead, "vec_id", "left_anti").unionByName(delta)
    got = HybridIndex.over(rows, delta, dead).search(asks, 7)
    assert hits(got) == hits(FlatIndex(live).search(asks, 7))
    for base in (IvfIndex.build(rows, params=IvfParams(nlist=8, nprobe=8)), IvfPqIndex.build(rows, params=IvfPqParams(nlist=8, nprobe=8, refine=400, m=4, nbits=4))):
        assert hits(HybridIndex(base, delta, dead).search(asks, 7)) == hits(FlatIndex(live).search(asks, 7))


def test_hybrid_over_lists_gives_k_rows_though_the_best_are_dead(rows, asks):
    few = asks.limit(10)
    index = IvfPqIndex.build(rows, params=IvfPqParams(nlist=4, nprobe=4, refine=5, m=4, nbits=4)).filed()
    dead = index.search(few, 20).select("vec_id").distinct()
    got = HybridIndex(index, rows.select("vec_id", "embedding").limit(0), dead).search(few, 5)
    assert got.count() == 50 and got.join(dead, "vec_id", "left_semi").count() == 0


def test_transforms():
    x = np.random.default_rng(1).standard_normal((300, 12)) * np.arange(1, 13)
    t = opq.train(x, 4)
    assert np.allclose(t.rotation @ t.rotation.T, np.eye(12)) and sorted(t.permutation) == list(range(12))
    assert np.allclose(np.linalg.norm(t.apply(x), axis=1), np.linalg.norm(x, axis=1))
    assert opq.train(x, 4, "none").is_identity and t.fingerprint() == opq.train(x, 4).fingerprint()
    with pytest.raises(ValueError):
        opq.Transform(3, None, np.array([0, 0, 1]))
    weights = [x.var(axis=0)[opq.balanced(x.var(axis=0), 4)].reshape(4, 3).sum(1)]
    assert np.max(weights) < 2 * np.min(weights)


def test_quantizer_lookup_is_the_score_of_the_decoded():
    x = np.random.default_rng(2).standard_normal((200, 8))
    pq = ProductQuantizer.train(x, 4, 4)
    codes = pq.encode(x)
    assert np.allclose(pq.lookup(pq.table_ip(x[:3]), codes), x[:3] @ pq.decode(codes).T)
    assert np.allclose(-pq.lookup(pq.table_l2(x[:3]), codes), kernel.scores(Metric.L2, x[:3], pq.decode(codes)))


def test_kmeans_edges():
    x = np.repeat(np.eye(3), 4, axis=0)
    c = kmeans.fit(x, 3, seed=1)
    assert sorted(map(tuple, c.round(6))) == sorted(map(tuple, np.eye(3)))
    assert (kmeans.fit(x, 3, seed=1) == c).all()
    kmeans.fit(np.zeros((5, 2)), 4)
    with pytest.raises(ValueError):
        kmeans.fit(x, 13)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(-2, 2), min_size=6, max_size=6), min_size=1, max_size=4), st.integers(1, 8))
def test_best_is_a_sort(s, k):
    s, ids = np.array(s, dtype=float), np.array([5, 3, 9, 1, 7, 2])
    row, col = kernel.best(s, ids, k)
    for i in range(len(s)):
        want = sorted(range(6), key=lambda j: (-s[i, j], ids[j]))[:k]
        assert list(col[row == i]) == want


def test_percentiles_and_bounds(spark):
    t = spark.range(200).select(F.col("id").cast("double").alias("x"))
    ranks = {"a": ("nearest", 0.5), "b": ("floor", 0.5), "c": ("nearest", 1.0), "d": ("floor", 1.0), "e": ("nearest", 0.0)}
    assert tuple(evaluate.percentiles(t.withColumn("g", F.lit(1)), ["g"], "x", **ranks).first()) == (1, 100.0, 100.0, 199.0, 199.0, 0.0)
    assert evaluate.percentiles(t.limit(0), [], "x", **ranks).first()["a"] is None
    rng = np.random.default_rng(3)
    xs = [(int(g), None if rng.random() < 0.1 else float(x)) for g, x in zip(rng.integers(0, 4, 500), rng.choice([-1e9, -3.5, -1e-7, 0.0, 2.0, 2.0000001, 7.0, 1e300, float("inf"), -float("inf")], 500))]
    xs += [(None, 4.0), (None, 1.0), (9, None)]
    got = {r.g: r for r in evaluate.percentiles(spark.createDataFrame(xs, "g int, x double"), ["g"], "x", p=("nearest", 0.4), q=("floor", 0.9)).collect()}
    for g in (0, 1, 2, 3, None):
        own = [x for h, x in xs if h == g and x is not None]
        assert (got[g].p, got[g].q) == (evaluate.percentile(own, 0.4), evaluate.floor_percentile(own, 0.9))
    assert set(got) == {0, 1, 2, 3, None}
    assert evaluate.wilson_lower_value(0, 0) == 0 and 0.9 < evaluate.wilson_lower_value(98, 100) < 0.98
    truth = spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "qid long, vec_id long")
    found = spark.createDataFrame([(1, 2)], "qid long, vec_id long")
    assert {tuple(r) for r in evaluate.recall_shared(truth, found).collect()} == {(1, 1, 1.0), (2, 0, None)}


def test_context_features(spark):
    t = spark.createDataFrame([(["domain:rust", "topic:rag"], "wiki", None, 1_700_000_000), (None, None, None, 0)], "tags array<string>, source string, session string, ts long")
    enc = t.select(context.encode_context(context.all_tags(F.col("tags"), F.col("source"), F.col("session"))).alias("c"), context.encode_time(F.col("ts")).alias("t")).collect()
    assert np.linalg.norm(enc[0].c) == pytest.approx(1) and np.linalg.norm(enc[0].t) == pytest.approx(1) and not any(enc[1].c)
    want = sorted({hashing.fnv1a(x.encode()) % 32 for x in ("domain:rust", "topic:rag", "source:wiki")})
    assert [i for i, v in enumerate(enc[0].c) if v] == want
    m = t.select(context.encode(F.array(*[F.lit(0.1)] * 128), F.col("tags"), F.col("source"), F.col("session"), F.col("ts")).alias("m")).first().m
    assert len(m) == 168 and np.linalg.norm(m) == pytest.approx(1)


def test_context_suites(spark):
    m = datagen.memories(spark, 20)
    rows = m.select("vec_id", context.encode(F.col("semantic"), F.col("tags"), F.col("source"), F.lit(None).cast("string"), F.col("ts_s")).alias("embedding"), "domain", "topic").cache()
    q = rows.where("vec_id % 9 = 0").select(F.col("vec_id").alias("qid"), "embedding", "domain", "topic")
    exact = FlatIndex(rows).search(q, 5)
    e = evaluate.context_errors(exact, exact, m, q).first()
    assert e.wrong_context == 0 and e.wrong_first == 0


def test_embedder_does_not_depend_on_order(spark):
    e = RandomEmbedder(8, seed=3)
    a, b = e.embed(["x", "y"]), e.embed(["y", "x"])
    assert (a[0] == b[1]).all() and np.allclose(np.linalg.norm(a, axis=1), 1)
    t = spark.createDataFrame([(1, None), (2, "x")], "id long, text string")
    assert embed_table(t, e).count() == 2


def test_files(spark, tmp_path):
    rows = datagen.uniform(spark, 30, 4)
    files.write_vector_csv(rows, f"file://{tmp_path}/v")
    back = files.read_vector_csv(spark, f"file://{tmp_path}/v", 4)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    (tmp_path / "odd.csv").write_text("1,2,3,4\n\n2,x,1,1\n3,1\n")
    assert [r.vec_id for r in files.read_vector_csv(spark, f"file://{tmp_path}/odd.csv", 2, strict=False).collect()] == [1]
    with pytest.raises(Exception, match="not a vector"):
        files.read_vector_csv(spark, f"file://{tmp_path}/odd.csv", 2).collect()
    (tmp_path / "t.jsonl").write_text('{"id": 1, "text": "a"}\n{"id": 2}\n')
    assert [tuple(r) for r in files.read_jsonl(spark, f"file://{tmp_path}/t.jsonl").orderBy("id").collect()] == [(1, "a"), (2, "")]
    (tmp_path / "bad.jsonl").write_text('{"id": -1, "text": "a"}\n')
    with pytest.raises(Exception, match="whole number"):
        files.read_jsonl(spark, f"file://{tmp_path}/bad.jsonl").collect()
    assert files.parse_list("1, 2,x,,3") == [1, 2, 3]


@pytest.mark.parametrize("make", [datagen.uniform, datagen.gaussian_sphere, datagen.decaying, datagen.hierarchical, datagen.power_law])
def test_generators_depend_on_seed_and_id_alone(spark, make):
    a = {r.vec_id: r.embedding for r in make(spark, 20, 6).collect()}
    b = {r.vec_id: r.embedding for r in make(spark, 20, 6).repartition(7).collect()}
    assert a == b and all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in a.values())


def test_freeze_under_stress(spark, rows, asks):
    run, ok = evaluate.freeze(rows.select("vec_id", "embedding"), asks, 5, IvfPqParams(nlist=8, nprobe=8, refine=200, m=4, nbits=4), stress=True)
    assert ok and run.recall >= 0.9 and 0 < run.p50_ms <= run.p95_ms <= run.p99_ms and run.qps > 0
    assert not evaluate.passes(run, 0.9, p95_ms=run.p95_ms / 2) and evaluate.passes(run, 0.9, p95_ms=run.p95_ms) and not evaluate.passes(run, recall=1.1)
    untimed = evaluate.measure(FlatIndex(rows).search, FlatIndex(rows).search(asks, 3), asks, 3, singles=0)
    assert evaluate.passes(untimed, 0.5)
    with pytest.raises(ValueError, match="timed"):
        evaluate.passes(untimed, 0.5, p95_ms=1e9)
    c = evaluate.curve(lambda n: lambda q, k: FlatIndex(rows).search(q, k), FlatIndex(rows).search(asks, 3), asks, 3, 2)
    assert [r.config for r in c.collect()] == ["nprobe=1", "nprobe=2"] and all(r.p95_ms > 0 for r in c.collect())
    assert evaluate.enforced(c, 0.9) and evaluate.enforced(c, 0.9, every=True) and not evaluate.enforced(c, 1.0) and not evaluate.enforced(c.limit(0), 0.0)
    evaluate.show(c)


def test_stream_into_delta(spark, rows, tmp_path):
    from vanespark.streaming.delta import append_rows, live_rows

    src = f"file://{tmp_path}/in"
    rows.where("vec_id < 10").withColumn("tags", F.lit(1).cast("long")).write.parquet(src)
    for _ in range(2):
        append_rows(spark.readStream.schema("vec_id long, embedding array<float>, tags long").parquet(src), f"file://{tmp_path}/delta", f"file://{tmp_path}/cp").awaitTermination()
        spark.createDataFrame([(3, [0.0] * 16, None)], "vec_id long, embedding array<float>, tags long").write.mode("append").parquet(src)
    live = live_rows(spark.read.parquet(f"file://{tmp_path}/delta"), spark.createDataFrame([(4,)], "vec_id long"))
    got = {r.vec_id: r for r in live.collect()}
    assert set(got) == set(range(10)) - {4} and got[3].embedding == [0.0] * 16 and got[3].tags == 1


def test_time_geometry_load_and_csv(spark, tmp_path):
    m = datagen.memories(spark, 15).cache()
    rows = m.select("vec_id", context.encode(F.col("semantic"), F.col("tags"), F.col("source"), F.lit(None).cast("string"), F.col("ts_s")).alias("embedding")).cache()
    one = m.where("vec_id = 0").select("semantic", "tags", "source")
    anchors = one.crossJoin(spark.createDataFrame([(1, 1_700_000_000), (2, 1_700_000_000 + 600 * 86400)], "qid long, at long"))
    q = anchors.select("qid", context.encode(F.col("semantic"), F.col("tags"), F.col("source"), F.lit(None).cast("string"), F.col("at"), context.Scales(0.2, 0.2, 1.0)).alias("embedding"))
    day = {r.qid: r.day for r in evaluate.mean_day(FlatIndex(rows).search(q, 10), m).collect()}
    assert day[1] < day[2]
    got = evaluate.load(FlatIndex(rows.limit(0).unionByName(datagen.uniform(spark, 50, 8))).search, lambda turn: datagen.agent_queries(spark, 5, 8, turn), 3, 0.1)
    assert got["batches"] >= 4 and got["queries"] == 5 * got["batches"] and got["qps"] > 0
    index = IvfIndex.build(rows, params=IvfParams(nlist=4, nprobe=4))
    run = evaluate.measure(index.search, FlatIndex(rows).search(q, 3), q, 3, "nprobe=4", singles=1)
    evaluate.sweep_file(evaluate.runs_table(q, [run]), index, rows.count(), f"file://{tmp_path}/runs")
    back = spark.read.option("header", True).csv(f"file://{tmp_path}/runs")
    assert len(back.columns) == len(evaluate.SETTINGS + evaluate.RESULTS) == 26
    r = back.first()
    assert (r.recall, r.probes, r.lists, r.rows, r.reranked) == ("1.0", "4", "4", str(rows.count()), None) and float(r.p95_ms) > 0


def test_filed_lists_are_pruned(rows, asks):
    index = IvfIndex.build(rows, params=IvfParams(nlist=16, nprobe=1)).filed()
    one = asks.limit(1)
    assert hits(index.search(one, 5)) == hits(IvfIndex.build(rows, params=IvfParams(nlist=16, nprobe=1)).search(one, 5))
    plan = index.search(one, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list_id" in plan.replace("isnotnull(list_id#", "list_id") or "PartitionFilters: [isnotnull(list_id" in plan


def test_covariance_of_all_places(spark, rows):
    x = np.array([r.embedding for r in rows.select("embedding").collect()], dtype=np.float64)
    got = {(r.i, r.j): r["cov"] for r in opq.covariance(rows.repartition(5)).collect()}
    assert len(got) == 16 * 17 // 2 and np.allclose([got[i, j] for i, j in got], [np.cov(x.T, bias=True)[i, j] for i, j in got])
    a, b = opq.train(x, 4), opq.train_on_all(rows, 4)
    assert np.allclose(a.rotation, b.rotation, atol=1e-6) and (a.permutation == b.permutation).all()
    assert opq.train_on_all(rows, 4, "none").is_identity and opq.covariance(rows.limit(0)).count() == 0


def test_fnv_of_many_texts():
    texts = [b"", b"a", b"foobar", b"x" * 1000, bytes(range(256))] * 3 + [b"q" * k for k in range(30)]
    assert hashing.fnv1a_all(texts).tolist() == [hashing.fnv1a(t) for t in texts] and len(hashing.fnv1a_all([])) == 0
    assert hashing.fnv1a(b"foobar") == 0x85944171F73967E8
