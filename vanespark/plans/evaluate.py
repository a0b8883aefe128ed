"""Recall, confidence bounds, percentiles, and runs of configurations against exact search."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from itertools import count, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vanespark.tables import written

Search = Callable[[DataFrame, int], DataFrame]


def recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(qid, hits, recall) for each query of ``truth`` (qid, vec_id): its ids that were found, by k."""
    pairs = truth.select("qid", "vec_id").distinct().join(found.select("qid", "vec_id", F.lit(1).alias("hit")).distinct(), ["qid", "vec_id"], "left")
    return pairs.groupBy("qid").agg(F.count("hit").alias("hits")).withColumn("recall", F.col("hits") / F.lit(float(k)))


def recall_shared(truth: DataFrame, found: DataFrame) -> DataFrame:
    """As :func:`recall`, by the smaller number of ids of either side; null where one side has none."""
    n = found.groupBy("qid").agg(F.countDistinct("vec_id").alias("m"))
    t = truth.groupBy("qid").agg(F.countDistinct("vec_id").alias("n")).join(n, "qid", "left")
    hits = recall(truth, found, 1).select("qid", "hits")
    return t.join(hits, "qid").select("qid", "hits", (F.col("hits") / F.nullif(F.least("n", F.coalesce("m", F.lit(0))), F.lit(0))).alias("recall"))


def wilson_lower(successes: Column, n: Column, z: float = 1.96) -> Column:
    """Lower end of the Wilson score interval (1927); 0 without trials."""
    p, zz = successes / n, z * z
    low = (p + zz / (2 * n) - z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)
    return F.when(n > 0, F.greatest(low, F.lit(0.0))).otherwise(F.lit(0.0))


def wilson_lower_value(successes: float, n: float, z: float = 1.96) -> float:
    if n <= 0:
        return 0.0
    p = successes / n
    return max(0.0, (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def percentiles(rows: DataFrame, by: list[str], value: str, **ranks: tuple[str, float]) -> DataFrame:
    """(by..., a column for each of ``ranks``) over the non-null values of each group. A rank is ("nearest", p), the value at
    place round(p * (n - 1)), half up, of n sorted ones, or ("floor", p), that at place floor(p * n), the last at most.

    A group is first counted in classes of a coarse scale that keeps the order, at most some hundred thousands whatever its size;
    only the classes that hold a wanted place are ordered value by value. NaN counts as the largest value.
    """
    x = F.col("_x")
    rows = rows.select(*by, F.col(value).cast("double").alias("_x")).where("_x is not null")
    coarse = F.when(F.isnan("_x") | (x == float("inf")), 1 << 40).when(x == -float("inf"), -(1 << 40)).otherwise(F.floor(F.signum("_x") * F.log1p(F.abs("_x")) * 500)).cast("long")
    rows = rows.withColumn("_class", coarse)
    classes = rows.groupBy(*by, "_class").agg(F.count(F.lit(1)).alias("_m"))
    n = F.sum("_m").over(W.partitionBy(*by))
    upto = F.sum("_m").over(W.partitionBy(*by).orderBy("_class"))
    places = [F.struct(F.lit(k).alias("k"), (F.floor(F.lit(q) * (F.col("_n") - 1) + 0.5) if kind == "nearest" else F.least(F.floor(F.lit(q) * F.col("_n")), F.col("_n") - 1)).cast("long").alias("at")) for k, (kind, q) in ranks.items()]
    wanted = classes.withColumn("_n", n).withColumn("_before", upto - F.col("_m")).withColumn("_w", F.explode(F.array(*places)))
    wanted = wanted.where("_w.at >= _before and _w.at < _before + _m").select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_class").alias("_c"), F.col("_w.k").alias("_k"), (F.col("_w.at") - F.col("_before")).alias("_at"))
    same = F.col("_class") == F.col("_c")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    close = rows.join(wanted.select("_c", *(f"_by{i}" for i in range(len(by)))).distinct(), same, "left_semi")
    placed = close.withColumn("_nth", F.row_number().over(W.partitionBy(*by, "_class").orderBy("_x")) - 1)
    found = placed.join(wanted, same & (F.col("_nth") == F.col("_at")))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("_k") == k, F.col("_x"))).alias(k) for k in ranks))


def percentile(xs: list[float], p: float) -> float:
    xs = sorted(xs)
    return xs[int(math.floor(p * (len(xs) - 1) + 0.5))] if xs else 0.0


def floor_percentile(xs: list[float], p: float) -> float:
    xs = sorted(xs)
    return xs[min(int(math.floor(p * len(xs))), len(xs) - 1)] if xs else 0.0


@dataclass(frozen=True)
class Run:
    """One configuration's results. Latencies are of lone queries, null if none was timed; qps is lone queries by the sum of their
    latencies, batch_qps all queries by the seconds of the one batch."""

    config: str
    k: int
    queries: int
    recall: float
    lb95: float
    batch_s: float
    batch_qps: float
    singles: int
    qps: float | None
    p50_ms: float | None
    p90_ms: float | None
    p95_ms: float | None
    p99_ms: float | None
    deterministic: bool


#: Lone queries that are timed, after one that isn't.
SINGLES = 20


def measure(search: Search, truth: DataFrame, queries: DataFrame, k: int, config: str = "", singles: int = SINGLES) -> Run:
    """Recall and its lower bound, seconds for the whole batch, its repeatability, and latencies of ``singles`` lone queries."""
    search(queries.limit(1), k).collect()
    began = time.perf_counter()
    first = written(search(queries, k).select("qid", "rk", "vec_id"), "hits")
    took = time.perf_counter() - began
    twice = first.unionByName(search(queries, k).select("qid", "rk", "vec_id")).groupBy("qid", "rk", "vec_id").agg(F.count(F.lit(1)).alias("n"))
    same = twice.where("n <> 2").isEmpty()
    spark = queries.sparkSession
    hits = recall(truth, first, k).agg(F.sum("hits"), F.count(F.lit(1))).first()
    n = (hits[1] or 0) * k
    lone = []
    for r in queries.limit(singles).collect():
        one = spark.createDataFrame([r], queries.schema)
        t = time.perf_counter()
        search(one, k).collect()
        lone.append((time.perf_counter() - t) * 1000)
    share = (hits[0] or 0) / n if n else 0.0
    at = [percentile(lone, p) if lone else None for p in (0.5, 0.9, 0.95, 0.99)]
    return Run(config, k, hits[1] or 0, share, wilson_lower_value(hits[0] or 0, n), took, (hits[1] or 0) / took, len(lone), len(lone) / sum(lone) * 1000 if lone else None, *at, same)


def curve(search_at: Callable[[int], Search], truth: DataFrame, queries: DataFrame, k: int, most: int, singles: int = SINGLES) -> DataFrame:
    """Runs for nprobe 1, 2, 4, ... up to ``most``."""
    truth = written(truth, "truth")
    steps = [1 << i for i in range(most.bit_length()) if 1 << i <= most]
    return runs_table(queries, [measure(search_at(n), truth, queries, k, f"nprobe={n}", singles) for n in steps])


def sweep(search_at: Callable[..., Search], truth: DataFrame, queries: DataFrame, k: int, singles: int = SINGLES, **grid: list) -> DataFrame:
    """Runs for every combination of the grid's values."""
    names, truth = list(grid), written(truth, "truth")
    out = []
    for values in product(*grid.values()):
        config = dict(zip(names, values))
        out.append(measure(search_at(**config), truth, queries, k, ", ".join(f"{n}={v}" for n, v in config.items()), singles))
    return runs_table(queries, out)


def enforced(runs: DataFrame, target: float, every: bool = False) -> bool:
    """Whether the best run's lower bound, or with ``every`` that of each run, reaches ``target``; false without runs."""
    got = [r["lb95"] for r in runs.select("lb95").collect()]
    return bool(got) and (min(got) if every else max(got)) >= target


_RUN_DDL = "config string, k int, queries long, recall double, lb95 double, batch_s double, batch_qps double, singles long, qps double, p50_ms double, p90_ms double, p95_ms double, p99_ms double, deterministic boolean"


def runs_table(queries: DataFrame, runs: list[Run]) -> DataFrame:
    return queries.sparkSession.createDataFrame([tuple(asdict(r).values()) for r in runs], _RUN_DDL)


def show(runs: DataFrame) -> None:
    """Print a table of runs."""
    runs.select("config", *(F.round(c, 3).alias(c) for c in ("recall", "lb95", "p50_ms", "p95_ms", "qps")), "deterministic").show(1000, truncate=False)


def passes(run: Run, lb95: float = 0.9, p95_ms: float | None = None, recall: float | None = None) -> bool:
    """The gates of a freeze. A latency gate without a timed query is an error."""
    if p95_ms is not None and run.p95_ms is None:
        raise ValueError("no lone query was timed: measure with singles > 0")
    return run.lb95 >= lb95 and (recall is None or run.recall >= recall) and (p95_ms is None or run.p95_ms <= p95_ms)


def freeze(rows: DataFrame, queries: DataFrame, k: int, params=None, metric=None, lb95: float = 0.9, p95_ms: float | None = None, stress: bool = False, recall: float | None = None, singles: int = SINGLES) -> tuple[Run, bool]:
    """Build, file the lists, search against the truth over live rows, and hold the gates; with ``stress`` after deletions and
    additions."""
    from vanespark.functions.vectors import Metric
    from vanespark.operators.flat import FlatIndex
    from vanespark.operators.hybrid import HybridIndex, mutate
    from vanespark.operators.ivfpq import IvfPqIndex, IvfPqParams

    metric, params = metric or Metric.COSINE, params or IvfPqParams()
    index = IvfPqIndex.build(rows, metric, params).filed()
    live = rows
    if stress:
        delta, dead = mutate(rows)
        index = HybridIndex(index, delta, dead, metric)
        live = rows.select("vec_id", "embedding").join(dead, "vec_id", "left_anti").unionByName(delta)
    truth = FlatIndex(live, metric).search(queries, k)
    run = measure(index.search, truth, queries, k, str(params), singles)
    return run, passes(run, lb95, p95_ms, recall)


def context_errors(hits: DataFrame, truth: DataFrame, memories: DataFrame, queries: DataFrame) -> DataFrame:
    """(wrong_context, wrong_first): the share of hits of another domain or topic than the query's, and of queries whose best hit isn't the truth's."""
    about = memories.select("vec_id", F.col("domain").alias("d"), F.col("topic").alias("t"))
    joined = hits.join(about, "vec_id").join(queries.select("qid", "domain", "topic"), "qid")
    wrong = joined.agg(F.avg(((F.col("d") != F.col("domain")) | (F.col("t") != F.col("topic"))).cast("int")).alias("wrong_context"))
    first = truth.where("rk = 1").select("qid", F.col("vec_id").alias("want")).join(hits.where("rk = 1").select("qid", "vec_id"), "qid", "left")
    return wrong.join(first.agg(F.avg((~F.col("want").eqNullSafe(F.col("vec_id"))).cast("int")).alias("wrong_first")))


def mean_day(hits: DataFrame, memories: DataFrame) -> DataFrame:
    """(qid, day): the mean day_idx of each query's hits; an early anchor's should be below a later one's."""
    return hits.join(memories.select("vec_id", "day_idx"), "vec_id").groupBy("qid").agg(F.avg("day_idx").alias("day"))


def load(search: Search, agents: Callable[[int], DataFrame], k: int, seconds: float, threads: int = 4) -> dict[str, float]:
    """``threads`` agents ask batches of ``agents(turn)`` at once for a time, each turn once: queries per second of wall time, and
    percentiles of a batch's latency in ms."""
    turns, took, asked = count(), [], []
    began = time.perf_counter()

    def agent(_: int) -> None:
        while True:
            queries = agents(next(turns))
            t = time.perf_counter()
            asked.append(len({r["qid"] for r in search(queries, k).collect()}))
            took.append((time.perf_counter() - t) * 1000)
            if time.perf_counter() - began >= seconds:
                return

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(agent, range(threads)))
    return {"batches": len(took), "queries": sum(asked), "qps": sum(asked) / (time.perf_counter() - began), "p50_ms": floor_percentile(took, 0.5), "p99_ms": floor_percentile(took, 0.99)}


#: What a row of the sweep file says: of the data and the index, then of the run.
SETTINGS = ("index_kind", "metric_name", "rows", "dims", "lists", "probes", "reranked", "parts", "bits", "training_rounds", "transform_used", "transform_mode", "sample_rows", "vectors_kept", "tasks")
RESULTS = ("k", "queries", "recall", "lb95", "p50_ms", "p90_ms", "p95_ms", "p99_ms", "qps", "batch_s", "deterministic")


def sweep_file(runs: DataFrame, index, rows: int, path: str) -> None:
    """Write ``runs`` as one CSV file with a header: 26 columns, settings of ``index`` first. probes and reranked come from a run's
    config where it names nprobe and refine."""
    p = index.params
    named = lambda name, other: F.coalesce(F.nullif(F.regexp_extract("config", rf"\b{name}=(\d+)", 1), F.lit("")).cast("int"), F.lit(other))
    mode = getattr(p, "opq_mode", "none")
    values = [type(index).__name__, index.metric.value, rows, index.centroids.shape[1], p.nlist, None, None, getattr(p, "m", None), getattr(p, "nbits", None), getattr(p, "iters", getattr(p, "max_iters", None)), mode != "none", mode, p.sample, getattr(p, "store_vectors", True), runs.sparkSession.sparkContext.defaultParallelism]
    own = {c: F.lit(v).cast("string") if v is None else F.lit(v) for c, v in zip(SETTINGS, values)} | {"probes": named("nprobe", p.nprobe), "reranked": named("refine", getattr(p, "refine", None))}
    table = runs.select(*(own[c].alias(c) for c in SETTINGS), *RESULTS)
    table.coalesce(1).write.option("header", True).csv(path)  # a row a configuration
