"""Registered queries for the vector search operators, and DuckDB SQL that gives the same rows.

Searches ask with every row whose id is divisible by 20, against all rows. Where an operator needs a trained model, SQL can't
follow the training, so those queries take rows of the table as centroids (vec_id < 16) and codewords (vec_id < 32); queries
with trained models are checked by tests and have no SQL.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanespark.functions import context, embed, hashing, vectors
from vanespark.functions.vectors import Metric
from vanespark.operators import opq
from vanespark.operators.flat import FlatIndex
from vanespark.operators.hybrid import HybridIndex, mutate
from vanespark.operators.ivf import IvfIndex, IvfParams, latest
from vanespark.operators.ivfpq import IvfPqIndex, IvfPqParams, rescored
from vanespark.operators.pq import ProductQuantizer
from vanespark.plans import evaluate, kmeans
from vanespark.sources import datagen, files, store
from vanespark.tables import new_path

K = 5
NLIST, NPROBE, M, WORDS, REFINE = 16, 4, 8, 32, 40
NOW, RATE = 1500, 0.01

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _rows(spark: SparkSession, sf_dir: str, name: str = "embeddings") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _asks(rows: DataFrame) -> DataFrame:
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def _out(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "vec_id", F.round("score", 6).alias("score"), "rk")


def _fixed(rows: DataFrame, n: int) -> np.ndarray:
    return np.array([r[0] for r in rows.where(F.col("vec_id") < n).orderBy("vec_id").select("embedding").collect()], dtype=np.float64)


def _tagged(rows: DataFrame) -> DataFrame:
    """Tags and a time for each row: a bit for the label and one for odd ids; ts is three times the id."""
    bit = F.expr("shiftleft(1L, coalesce(label, 0))").bitwiseOR(F.expr("shiftleft(vec_id % 2, 12)"))
    return rows.withColumn("tags", bit).withColumn("ts", F.col("vec_id") * 3)


def _books(rows: DataFrame) -> ProductQuantizer:
    return ProductQuantizer(_fixed(rows, WORDS).reshape(WORDS, M, -1).transpose(1, 0, 2).copy())


# SQL pieces

_Q = "q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0)"
_E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label, (1::BIGINT << coalesce(label, 0)) | ((vec_id % 2) << 12) AS tags, vec_id * 3 AS ts FROM embeddings)"
_C = f"c AS (SELECT vec_id::INT AS list_id, embedding::DOUBLE[] AS cv FROM embeddings WHERE vec_id < {NLIST})"
_ASSIGN = "l AS (SELECT vec_id, arg_min(list_id, struct_pack(d := round(d, 12), i := list_id)) AS list_id FROM (SELECT e.vec_id, c.list_id, pow(list_distance(v, cv), 2) AS d FROM e, c) GROUP BY vec_id)"
_COS = "list_cosine_similarity(qv, v)"


def _ranked(scored: str, k: int = K, also: str = "") -> str:
    return f"""{scored},
r AS (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rk FROM s)
SELECT qid, vec_id, round(score, 6) AS score, rk FROM r WHERE rk <= {k}{also}"""


# exact search and scalar math


@_query(_ranked(f"WITH {_Q}, {_E}, s AS (SELECT qid, vec_id, {_COS} AS score FROM q, e)"))
def flat_cosine_topk(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return _out(FlatIndex(rows).search(_asks(rows), K))


@_query(_ranked(f"WITH {_Q}, {_E}, s AS (SELECT qid, vec_id, -pow(list_distance(qv, v), 2) AS score FROM q, e)"))
def flat_l2_topk(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return _out(FlatIndex(rows, Metric.L2).search(_asks(rows), K))


@_query(_ranked(f"WITH {_Q}, {_E}, s AS (SELECT qid, vec_id, {_COS} AS score FROM q, e)"))
def flat_sql_topk(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return _out(FlatIndex(rows).search_sql(_asks(rows), K))


@_query("""SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, list_cosine_similarity((SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7), embedding::DOUBLE[]) AS score FROM embeddings)
ORDER BY round(score, 9) DESC, vec_id LIMIT 10""")
def single_query_topk(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    vector = rows.where("vec_id = 7").first()["embedding"]
    return FlatIndex(rows).search_one(vector, 10).select("vec_id", F.round("score", 6).alias("score"))


@_query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT vec_id, (i - 1)::INT AS i, round(CASE WHEN n = 0 THEN v[i] ELSE v[i] / n END, 6) AS x FROM n, range(1, 65) t(i)""")
def normalize_vectors(spark, sf_dir):
    return _rows(spark, sf_dir).select("vec_id", F.posexplode(vectors.normalized("embedding")).alias("i", "x")).withColumn("x", F.round("x", 6))


@_query("SELECT vec_id, 0.0::DOUBLE AS cosine, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS l2 FROM embeddings")
def score_zero_vector(spark, sf_dir):
    zero = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 0)
    return _rows(spark, sf_dir).select("vec_id", vectors.cosine("embedding", zero).alias("cosine"), F.round(vectors.l2_squared("embedding", zero), 6).alias("l2"))


@_query(f"WITH {_E}, {_C} SELECT vec_id, list_id, round(list_inner_product(v, cv), 6) AS dot, round(pow(list_distance(v, cv), 2), 6) AS l2 FROM e, c")
def pairwise_scores(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    c = rows.where(F.col("vec_id") < NLIST).select(F.col("vec_id").cast("int").alias("list_id"), F.col("embedding").alias("cv"))
    both = rows.join(F.broadcast(c))  # NLIST rows
    return both.select("vec_id", "list_id", F.round(vectors.dot("embedding", "cv"), 6).alias("dot"), F.round(vectors.l2_squared("embedding", "cv"), 6).alias("l2"))


# inverted lists


@_query(f"WITH {_E}, {_C}, {_ASSIGN} SELECT vec_id, list_id FROM l")
def assign_nearest_centroid(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("vec_id", "embedding")
    return kmeans.assign(rows, _fixed(rows, NLIST)).select("vec_id", "list_id")


@_query(f"""WITH {_E}, {_C}, {_ASSIGN} SELECT list_id, (i - 1)::INT AS i, count(*) AS n, round(avg(v[i]), 6) AS x
FROM l JOIN e USING (vec_id), range(1, 65) t(i) GROUP BY list_id, i""")
def lloyd_update_mean(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("vec_id", "embedding")
    means = kmeans.update(kmeans.assign(rows, _fixed(rows, NLIST)))
    return means.select("list_id", F.posexplode("centroid").alias("i", "x"), "n").select("list_id", "i", "n", F.round("x", 6).alias("x"))


_PROBE = f"p AS (SELECT qid, list_id FROM (SELECT qid, list_id, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(qv, cv), 9) DESC, list_id) AS n FROM q, c) WHERE n <= {NPROBE})"


@_query(f"WITH {_Q}, {_C}, {_PROBE} SELECT qid, list_id FROM p")
def probe_lists_topn(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return _ivf(rows).probes(_asks(rows))


def _ivf(rows: DataFrame) -> IvfIndex:
    c = _fixed(rows, NLIST)
    return IvfIndex(Metric.COSINE, IvfParams(nlist=NLIST, nprobe=NPROBE), c, IvfIndex._filed(_tagged(rows), c))


_IVF = f"WITH {_Q}, {_E}, {_C}, {_ASSIGN}, {_PROBE}, s AS (SELECT qid, vec_id, {_COS} AS score FROM q JOIN p USING (qid) JOIN l USING (list_id) JOIN e USING (vec_id)"


@_query(_ranked(f"{_IVF} WHERE vec_id % 10 <> 3)"))
def ivf_search_tombstone(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    index = _ivf(rows).delete(rows.where("vec_id % 10 = 3"))
    return _out(index.search(_asks(rows), K))


@_query(_ranked(f"{_IVF} WHERE tags & {1 << 12 | 2} = {1 << 12 | 2})"))
def ivf_search_tags_all(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return _out(_ivf(rows).search(_asks(rows), K, tag_mask=1 << 12 | 2, tag_mode="all"))


@_query(_ranked(f"{_IVF} WHERE tags & 6 <> 0)"))
def ivf_search_tags_any(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return _out(_ivf(rows).search(_asks(rows), K, tag_mask=6, tag_mode="any"))


_LIVE = """u AS (SELECT vec_id, v, tags, 0 AS version FROM e UNION ALL SELECT vec_id, list_transform(v, lambda x: -x), tags, 1 FROM e WHERE vec_id % 7 = 0
UNION ALL SELECT vec_id + 1000000, v, tags, 1 FROM e WHERE vec_id % 7 = 1),
w AS (SELECT vec_id, v, tags, version FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY version DESC) AS n FROM u) WHERE n = 1)"""


@_query(f"WITH {_E}, {_LIVE} SELECT vec_id, version::BIGINT AS version, round(list_sum(v), 4) AS total, tags FROM w")
def upsert_latest_wins(spark, sf_dir):
    rows = _tagged(_rows(spark, sf_dir)).select("vec_id", "embedding", "tags").withColumn("version", F.lit(0).cast("long"))
    flipped = rows.where("vec_id % 7 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)).withColumn("tags", F.lit(None).cast("long"))
    added = rows.where("vec_id % 7 = 1").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    now = latest(rows.unionByName(flipped.unionByName(added).withColumn("version", F.lit(1).cast("long"))))
    return now.select("vec_id", "version", F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 4).alias("total"), "tags")


@_query(f"WITH {_E}, {_C}, {_ASSIGN} SELECT list_id, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id FROM l WHERE vec_id % 10 <> 3 GROUP BY list_id")
def compact_lists(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    lists = _ivf(rows).delete(rows.where("vec_id % 10 = 3")).compact().lists
    return lists.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


# decay, hybrid

_DECAY = f"greatest(exp(-{RATE} * greatest({NOW} - ts, 0)), 1e-9)"


@_query(_ranked(f"WITH {_Q}, {_E}, b AS (SELECT qid, vec_id, {_COS} AS x, {_DECAY} AS f FROM q, e), s AS (SELECT qid, vec_id, CASE WHEN x > 0 THEN x * f ELSE x / f END AS score FROM b)"))
def temporal_decay_topk(spark, sf_dir):
    rows = _tagged(_rows(spark, sf_dir))
    return _out(FlatIndex(rows).search(_asks(rows), K, now=NOW, rate=RATE))


@_query(_ranked(f"""WITH {_Q}, {_E}, h AS (SELECT vec_id, v FROM e WHERE vec_id % 10 <> 3
UNION ALL SELECT vec_id + 1000000, v FROM e WHERE vec_id % 3 = 0 AND (vec_id + 1000000) % 10 <> 3), s AS (SELECT qid, vec_id, {_COS} AS score FROM q, h)"""))
def hybrid_search(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("vec_id", "embedding")
    delta = rows.where("vec_id % 3 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    dead = rows.unionByName(delta).where("vec_id % 10 = 3").select("vec_id")
    return _out(HybridIndex.over(rows, delta, dead).search(_asks(rows), K))


# product quantisation

_W = f"cw AS (SELECT vec_id AS t, embedding::DOUBLE[] AS w FROM embeddings WHERE vec_id < {WORDS}), parts AS (SELECT j FROM range(0, {M}) r(j))"
_CODES = "k AS (SELECT vec_id, j, arg_min(t, struct_pack(d := round(d, 12), t := t)) AS code FROM (SELECT vec_id, j, t, pow(list_distance(v[j * 8 + 1 : j * 8 + 8], w[j * 8 + 1 : j * 8 + 8]), 2) AS d FROM e, cw, parts) GROUP BY vec_id, j)"


def _coded(rows: DataFrame) -> DataFrame:
    """(vec_id, j, code)"""
    codes = _books(rows).encode_table(rows)
    code = F.transform(F.sequence(F.lit(1), F.lit(M)), lambda i: F.conv(F.hex(F.substring("codes", i, F.lit(1))), 16, 10).cast("long"))
    return codes.select("vec_id", F.posexplode(code).alias("j", "code")).withColumn("j", F.col("j").cast("long"))


@_query(f"WITH {_E}, {_W}, {_CODES} SELECT vec_id, j, code FROM k")
def pq_encode(spark, sf_dir):
    return _coded(_rows(spark, sf_dir))


_ADC = "list_inner_product(qv[j * 8 + 1 : j * 8 + 8], w[j * 8 + 1 : j * 8 + 8])"


def _adc(spark, sf_dir, metric: Metric) -> IvfPqIndex:
    """Codes of whole vectors in one list whose centroid is zero."""
    rows = _tagged(_rows(spark, sf_dir))
    books = _books(rows)
    lists = books.encode_table(rows).join(rows.select("vec_id", "tags", "ts"), "vec_id").select(F.lit(0).alias("list_id"), "vec_id", "codes", "embedding", "tags", "ts")
    return IvfPqIndex(metric, IvfPqParams(nlist=1, nprobe=1, refine=REFINE), opq.Transform(books.dim), np.zeros((1, books.dim)), books, lists)


@_query(_ranked(f"WITH {_Q}, {_E}, {_W}, {_CODES}, s AS (SELECT qid, vec_id, sum({_ADC}) / any_value(sqrt(list_inner_product(qv, qv))) AS score FROM q, k JOIN cw ON cw.t = k.code GROUP BY qid, vec_id)"))
def pq_adc_ip(spark, sf_dir):
    index = _adc(spark, sf_dir, Metric.COSINE)
    return _out(index.candidates(_asks(_rows(spark, sf_dir)), K))


@_query(_ranked(f"WITH {_Q}, {_E}, {_W}, {_CODES}, s AS (SELECT qid, vec_id, -sum(pow(list_distance(qv[j * 8 + 1 : j * 8 + 8], w[j * 8 + 1 : j * 8 + 8]), 2)) AS score FROM q, k JOIN cw ON cw.t = k.code GROUP BY qid, vec_id)"))
def pq_adc_l2(spark, sf_dir):
    index = _adc(spark, sf_dir, Metric.L2)
    return _out(index.candidates(_asks(_rows(spark, sf_dir)), K))


@_query(_ranked(f"""WITH {_Q}, {_E}, {_W}, {_CODES}, a AS (SELECT qid, vec_id, sum({_ADC}) / any_value(sqrt(list_inner_product(qv, qv))) AS x FROM q, k JOIN cw ON cw.t = k.code GROUP BY qid, vec_id),
t AS (SELECT qid, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(x, 9) DESC, vec_id) AS n FROM a) WHERE n <= {REFINE}),
s AS (SELECT qid, vec_id, {_COS} AS score FROM t JOIN q USING (qid) JOIN e USING (vec_id))"""))
def ivfpq_refine(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    index = _adc(spark, sf_dir, Metric.COSINE)
    return _out(index.search(_asks(rows), K))


@_query(f"""WITH {_Q}, {_E}, t AS (SELECT qid, vec_id FROM (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY round({_COS}, 9) DESC, vec_id) AS n FROM q, e WHERE tags & 2 = 2) WHERE n <= {REFINE}),
b AS (SELECT qid, vec_id, {_COS} AS x, {_DECAY} AS f FROM t JOIN q USING (qid) JOIN e USING (vec_id)),
s AS (SELECT qid, vec_id, CASE WHEN x > 0 THEN x * f ELSE x / f END AS score FROM b),
r AS (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rk FROM s)
SELECT qid, vec_id, round(score, 6) AS score, rk FROM r WHERE rk <= {K}""")
def refine_with_decay(spark, sf_dir):
    rows = _tagged(_rows(spark, sf_dir))
    asks = _asks(rows)
    found = FlatIndex(rows).search(asks, REFINE, where=vectors.tags_match("tags", 2))
    return _out(rescored(found, asks, rows.select("vec_id", "embedding", "ts"), Metric.COSINE, K, NOW, RATE))


@_query("SELECT (i - 1)::INT AS i, round(var_pop(embedding[i]::DOUBLE), 6) AS variance FROM embeddings, range(1, 65) t(i) GROUP BY i")
def opq_variance(spark, sf_dir):
    return opq.variances(_rows(spark, sf_dir)).select("i", F.round("variance", 6).alias("variance"))


@_query("SELECT (i - 1)::INT AS i, (j - 1)::INT AS j, round(covar_pop(embedding[i]::DOUBLE, embedding[j]::DOUBLE), 6) AS cov FROM embeddings, range(1, 65) a(i), range(1, 65) b(j) WHERE i <= j GROUP BY i, j")
def covariance_matrix(spark, sf_dir):
    return opq.covariance(_rows(spark, sf_dir)).select("i", "j", F.round("cov", 6).alias("cov"))


# evaluation

_TRUTH = f"WITH {_Q}, {_E}, {_C}, {_ASSIGN}, {_PROBE}, t AS (SELECT qid, vec_id FROM (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY round({_COS}, 9) DESC, vec_id) AS n FROM q, e) WHERE n <= {K}), f AS (SELECT qid, vec_id FROM (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY round({_COS}, 9) DESC, vec_id) AS n FROM q JOIN p USING (qid) JOIN l USING (list_id) JOIN e USING (vec_id)) WHERE n <= {K}), h AS (SELECT t.qid, count(f.vec_id) AS hits FROM t LEFT JOIN f ON t.qid = f.qid AND t.vec_id = f.vec_id GROUP BY t.qid)"


def _recall(spark, sf_dir) -> DataFrame:
    rows = _rows(spark, sf_dir)
    asks = _asks(rows)
    return evaluate.recall(FlatIndex(rows).search(asks, K), _ivf(rows).search(asks, K), K)


@_query(f"{_TRUTH} SELECT qid, hits, hits / {K}.0::DOUBLE AS recall FROM h")
def recall_at_k(spark, sf_dir):
    return _recall(spark, sf_dir)


@_query(f"""{_TRUTH}, g AS (SELECT sum(hits)::DOUBLE AS s, (count(*) * {K})::DOUBLE AS n FROM h)
SELECT s, n, round((s / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(s / n * (1 - s / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS lb95 FROM g""")
def wilson_bound(spark, sf_dir):
    total = _recall(spark, sf_dir).agg(F.sum("hits").cast("double").alias("s"), (F.count(F.lit(1)) * K).cast("double").alias("n"))
    return total.select("s", "n", F.round(evaluate.wilson_lower(F.col("s"), F.col("n")), 6).alias("lb95"))


@_query("""SELECT event_type, list_sort(list(value))[floor(0.5 * (count(value) - 1) + 0.5)::INT + 1] AS p50, list_sort(list(value))[floor(0.95 * (count(value) - 1) + 0.5)::INT + 1] AS p95,
list_sort(list(value))[least(floor(0.95 * count(value)), count(value) - 1)::INT + 1] AS p95_floor FROM events GROUP BY event_type""")
def percentile_nearest_rank(spark, sf_dir):
    return evaluate.percentiles(_rows(spark, sf_dir, "events"), ["event_type"], "value", p50=("nearest", 0.5), p95=("nearest", 0.95), p95_floor=("floor", 0.95))


# context, time, text

_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, strlen({0}) + 1), lambda i: ('0x' || substr(hex(encode({0})), (2 * i - 1)::INT, 2))::INT::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"


@_query(f"SELECT DISTINCT source, ({_FNV.format('source')})::DECIMAL(20, 0)::VARCHAR AS fnv, (({_FNV.format('source')}) % 32)::INT AS slot FROM documents WHERE source IS NOT NULL")
def context_slot(spark, sf_dir):
    docs = _rows(spark, sf_dir, "documents").where("source is not null").select("source").distinct()
    return docs.select("source", hashing.fnv1a_column(F.col("source")).cast("string").alias("fnv"), context.slot(F.col("source")).alias("slot"))


_TIME = ", ".join(f"0.5 * {f}(d * {r!r}::DOUBLE)" for r in context.RATES for f in ("sin", "cos"))


@_query(f"SELECT event_id, (i - 1)::INT AS i, round(x[i], 6) AS x FROM (SELECT event_id, [{_TIME}] AS x FROM (SELECT event_id, floor(epoch(ts))::DOUBLE / 86400.0::DOUBLE AS d FROM events)), range(1, 9) t(i)")
def time_encoding(spark, sf_dir):
    events = _rows(spark, sf_dir, "events")
    return events.select("event_id", F.posexplode(context.encode_time(F.unix_timestamp(F.col("ts").cast("timestamp")))).alias("i", "x")).withColumn("x", F.round("x", 6))


def _memories(spark, sf_dir) -> DataFrame:
    rows = _rows(spark, sf_dir)
    docs = _rows(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    m = rows.join(docs, "vec_id", "left")
    enc = context.encode(vectors.normalized("embedding"), F.array_compact(F.array("lang")), F.col("source"), F.lit(None).cast("string"), F.lit(1_700_000_000) + F.col("vec_id") * 3600)
    return m.select("vec_id", enc.alias("embedding"))


_SLOT = f"(({_FNV}) % 32)::INT"
_MEM = f"""m AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS sem, lang, 'source:' || source AS src, (1700000000 + vec_id * 3600)::DOUBLE / 86400.0::DOUBLE AS d FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
sl AS (SELECT DISTINCT tag, {_SLOT.format('tag')} AS slot FROM (SELECT lang AS tag FROM m UNION SELECT src FROM m) WHERE tag IS NOT NULL),
n AS (SELECT vec_id, sem, d, list_transform(range(0, 32), lambda i: ((CASE WHEN a.slot = i THEN 1 ELSE 0 END) + (CASE WHEN b.slot = i THEN 1 ELSE 0 END))::DOUBLE) AS c FROM m LEFT JOIN sl a ON a.tag = m.lang LEFT JOIN sl b ON b.tag = m.src),
z AS (SELECT vec_id, sem, [{_TIME}] AS t, sqrt(list_inner_product(c, c)) AS cn, c FROM n),
e AS (SELECT vec_id, list_concat(list_concat(list_transform(sem, lambda x: x * 0.95::DOUBLE), list_transform(c, lambda x: CASE WHEN cn = 0 THEN 0 ELSE x / cn END * 0.55::DOUBLE)), list_transform(t, lambda x: x * 0.6::DOUBLE)) AS v FROM z),
q AS (SELECT vec_id AS qid, v AS qv FROM e WHERE vec_id % 20 = 0)"""


@_query(_ranked(f"WITH {_MEM}, s AS (SELECT qid, vec_id, {_COS} AS score FROM q, e)"))
def context_combined_search(spark, sf_dir):
    m = _memories(spark, sf_dir)
    return _out(FlatIndex(m).search(_asks(m), K))


@_query()
def text_embed(spark, sf_dir):
    docs = _rows(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return embed.embed_table(docs, embed.RandomEmbedder(16, seed=1))


# trained models


@_query()
def kmeans_fit(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("vec_id", "embedding")
    _, x = kmeans.sample_rows(rows)
    c = kmeans.refine(rows, kmeans.fit(x, min(NLIST, len(x)), seed=3), rounds=2)
    return kmeans.update(kmeans.assign(rows, c))


@_query()
def ivf_trained_search(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("vec_id", "embedding")
    return _out(IvfIndex.build(rows, params=IvfParams(nlist=32, nprobe=22)).search(_asks(rows), K))


@_query()
def ivfpq_opq_search(spark, sf_dir):
    rows = _tagged(_rows(spark, sf_dir)).select("vec_id", "embedding", "tags", "ts")
    index = IvfPqIndex.build(rows, params=IvfPqParams(nlist=16, nprobe=14, refine=200, m=8, nbits=6, opq_mode="pca-perm")).filed()
    return _out(index.search(_asks(rows), K, now=NOW, rate=0.0005))


@_query()
def sweep_nprobe_refine(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("vec_id", "embedding")
    asks = _asks(rows)
    index = IvfPqIndex.build(rows, params=IvfPqParams(nlist=16, m=8, nbits=6)).filed()
    search_at = lambda nprobe, refine: lambda q, k: index.search(q, k, nprobe=nprobe, refine=refine)
    out = evaluate.sweep(search_at, FlatIndex(rows).search(asks, K), asks, K, singles=2, nprobe=[4, 16], refine=[20, 80])
    return out.select("config", "k", "queries", "recall", "lb95", "deterministic")


# sources, sinks, generators, whole indexes and gates

_LANG, _URL = "lang", "url"

_CHAIN = """z1 AS (SELECT * EXCLUDE z, xor(z, z // 1073741824) AS z FROM z0),
z2 AS (SELECT * EXCLUDE z, {m1} AS z FROM z1), z3 AS (SELECT * EXCLUDE z, xor(z, z // 134217728) AS z FROM z2),
z4 AS (SELECT * EXCLUDE z, {m2} AS z FROM z3), z5 AS (SELECT * EXCLUDE z, xor(z, z // 2147483648) AS z FROM z4),
u AS (SELECT *, (z // 2048)::DOUBLE * pow(2.0::DOUBLE, -53) AS u FROM z5)"""
_TIMES = "(((z // 4294967296) * {0}::HUGEINT % 4294967296) * 4294967296 + (z % 4294967296) * {0}::HUGEINT) % 18446744073709551616::HUGEINT"
_CHAIN = _CHAIN.format(m1=_TIMES.format(0xBF58476D1CE4E5B9), m2=_TIMES.format(0x94D049BB133111EB))


def _mixed(seeds: str, n: int) -> str:
    """WITH clauses that end in u (..., i, z, u): n outputs for each row (..., seed) of ``seeds``."""
    return f"s0 AS ({seeds}), z0 AS (SELECT s0.*, (i - 1)::INT AS i, (seed::HUGEINT + i::HUGEINT * {0x9E3779B97F4A7C15}::HUGEINT) % 18446744073709551616::HUGEINT AS z FROM s0, range(1, {n + 1}) t(i)), {_CHAIN}"


@_query(f"WITH {_mixed('SELECT vec_id AS seed FROM embeddings', 4)} SELECT seed, i, z::VARCHAR AS z, round(u, 12) AS u FROM u")
def splitmix_sequence(spark, sf_dir):
    return hashing.splitmix_table(_rows(spark, sf_dir), "vec_id", 4).withColumn("u", F.round("u", 12))


def _places(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(id_col, F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


@_query(f"WITH {_mixed('SELECT id AS vec_id, 42 * 1000003 + id AS seed FROM range(0, 300) t(id)', 8)} SELECT vec_id, i, round((u - 0.5::DOUBLE)::FLOAT::DOUBLE, 6) AS x FROM u")
def uniform_generator(spark, sf_dir):
    return _places(datagen.uniform(spark, 300, 8, normalize=False), "vec_id")


@_query(f"WITH {_mixed('SELECT id AS qid, (5 * 1000003 + id) * 1000003 + 2 AS seed FROM range(0, 50) t(id)', 8)} SELECT qid, i, round(u::FLOAT::DOUBLE, 6) AS x FROM u")
def agent_query_generator(spark, sf_dir):
    return _places(datagen.agent_queries(spark, 50, 8, turn=2, seed=5), "qid")


@_query(f"WITH {_mixed(f'SELECT DISTINCT lang, {_FNV.format(_LANG)} AS seed FROM documents WHERE lang IS NOT NULL', 16)}, n AS (SELECT *, u * 2 - 1 AS x FROM u) SELECT lang, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY lang)), 6) AS x FROM n")
def semantic_base_vectors(spark, sf_dir):
    langs = _rows(spark, sf_dir, "documents").where("lang is not null").select("lang").distinct()
    dim = 16

    def run(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            v = [datagen.semantic_base(n, dim) for n in names]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, type=pa.list_(pa.float64()))], names=["lang", "embedding"])

    return _places(langs.mapInArrow(run, "lang string, embedding array<double>"), "lang")


@_query(f"WITH {_mixed(f'SELECT page_id AS vec_id, xor({_FNV.format(_URL)}, 1::HUGEINT) AS seed FROM pages WHERE length(url) > 0', 16)}, n AS (SELECT *, u - 0.5::DOUBLE AS x FROM u) SELECT vec_id, i, round((x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)))::FLOAT::DOUBLE, 6) AS x FROM n")
def url_embed(spark, sf_dir):
    pages = _rows(spark, sf_dir, "pages").where("length(url) > 0").select(F.col("page_id").alias("id"), F.col("url").alias("text"))
    return _places(embed.embed_table(pages, embed.RandomEmbedder(16, seed=1)), "vec_id")


@_query("""SELECT * FROM (VALUES ('decaying', 200, 12, true), ('gaussian_sphere', 200, 12, true), ('hierarchical', 200, 12, true), ('low_separation', 200, 12, true), ('noise_heavy', 200, 12, true), ('overlapping', 200, 12, true), ('perturbed_queries', 50, 64, true), ('power_law', 200, 12, true), ('uniform', 200, 12, true)) t(name, n, dim, of_length_one)""")
def generators_summary(spark, sf_dir):
    names = ["uniform", "gaussian_sphere", "hierarchical", "decaying", "overlapping", "power_law", "noise_heavy", "low_separation"]
    made = [getattr(datagen, n)(spark, 200, 12).withColumn("name", F.lit(n)) for n in names]
    made.append(datagen.perturbed_queries(_rows(spark, sf_dir), 50).withColumnRenamed("qid", "vec_id").withColumn("name", F.lit("perturbed_queries")))
    rows = reduce(DataFrame.unionByName, made)
    unit = F.bool_and(F.abs(vectors.norm("embedding") - 1) < 1e-6)
    return rows.groupBy("name").agg(F.count_distinct("vec_id").cast("int").alias("n"), F.max(F.size("embedding")).alias("dim"), unit.alias("of_length_one"))


@_query("""WITH n AS (SELECT id AS vec_id, ['rust', 'cooking', 'travel'][(id // 60)::INT + 1] AS domain, ['basics', 'tools', 'history'][(id // 20 % 3)::INT + 1] AS topic FROM range(0, 180) t(id))
SELECT vec_id, domain, topic, 'domain:' || domain || ',topic:' || topic AS tags, 's' || (vec_id % 100)::VARCHAR AS session, true AS in_range, 0::BIGINT AS off, 1.0::DOUBLE AS length FROM n""")
def memory_corpus(spark, sf_dir):
    m = datagen.memories(spark, 20)
    return m.select("vec_id", "domain", "topic", F.array_join("tags", ",").alias("tags"), "session", F.col("day_idx").between(0, 729).alias("in_range"), (F.col("ts_s") - 1_700_000_000 - F.col("day_idx") * 86_400).cast("long").alias("off"), F.round(vectors.norm("semantic"), 6).alias("length"))


@_query("SELECT doc_id AS id, md5(coalesce(text, '')) AS digest, length(coalesce(text, ''))::INT AS n FROM documents")
def jsonl_round_trip(spark, sf_dir):
    path = new_path(spark, "jsonl")
    files.write_jsonl(_rows(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), path)
    return files.read_jsonl(spark, path).select("id", F.md5(F.encode("text", "UTF-8")).alias("digest"), F.length("text").alias("n"))


@_query("SELECT vec_id, (i - 1)::INT AS i, round(embedding[i]::DOUBLE, 6) AS x FROM embeddings, range(1, 33) t(i)")
def vector_csv_round_trip(spark, sf_dir):
    path = new_path(spark, "csv")
    files.write_vector_csv(_rows(spark, sf_dir), path)
    return _places(files.read_vector_csv(spark, path, dim=32), "vec_id")


@_query("SELECT vec_id, (1 + vec_id % 5)::INT AS n, round(list_sum(embedding[1 : 1 + vec_id % 5]::DOUBLE[]), 5) AS total FROM embeddings WHERE vec_id % 7 <> 3 AND vec_id % 11 <> 5")
def vector_csv_upload(spark, sf_dir):
    path = new_path(spark, "upload")
    some = F.transform(F.slice("embedding", 1, (F.col("vec_id") % 5 + 1).cast("int")), lambda x: x.cast("string"))
    line = F.when(F.col("vec_id") % 7 == 3, "no,vector,here").when(F.col("vec_id") % 11 == 5, "  ").otherwise(F.concat_ws(" , ", F.col("vec_id").cast("string"), some))
    _rows(spark, sf_dir).select(line.alias("value")).write.text(path)
    got = files.read_vector_csv(spark, path, strict=False)
    return got.select("vec_id", F.size("embedding").alias("n"), F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@_query(_ranked(f"{_IVF})"))
def ivf_saved_search(spark, sf_dir):
    """An index that was written by list and read back: only probed lists are read."""
    rows = _rows(spark, sf_dir)
    path = new_path(spark, "index")
    store.save(_ivf(rows), path)
    return _out(store.load(spark, path).search(_asks(rows), K))


@_query("SELECT true AS same_in_any_order, true AS follows_vectors, true AS follows_lists, 3 AS version")
def index_fingerprint(spark, sf_dir):
    index = _ivf(_rows(spark, sf_dir))
    path = new_path(spark, "index")
    kept = store.save(index, path)
    about = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    text = json.dumps(about["about"], sort_keys=True)
    again = store.fingerprint(index.lists.orderBy(F.desc("vec_id")), index.centroids, text)
    moved = store.fingerprint(index.lists.withColumn("embedding", F.when(F.col("vec_id") == 3, F.reverse("embedding")).otherwise(F.col("embedding"))), index.centroids, text)
    dealt = store.fingerprint(index.lists.withColumn("list_id", F.when(F.col("vec_id") == 3, -1).otherwise(F.col("list_id"))), index.centroids, text)
    return spark.createDataFrame([(again == kept, moved != kept, dealt != kept, about["version"])], "same_in_any_order boolean, follows_vectors boolean, follows_lists boolean, version int")


@_query(_ranked(f"WITH {_Q}, {_E}, s AS (SELECT qid, vec_id, {_COS} AS score FROM q, e)"))
def flat_add_search(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    index = FlatIndex(rows.where("vec_id % 2 = 0")).add(rows.where("vec_id % 2 = 1"))
    return _out(index.search(_asks(rows), K))


@_query("SELECT count(*) AS n, max(len(embedding))::INT AS dim FROM embeddings")
def flat_size(spark, sf_dir):
    index = FlatIndex(_rows(spark, sf_dir))
    return spark.createDataFrame([(index.count(), index.dim)], "n long, dim int")


@_query(f"WITH {_E}, {_C}, {_ASSIGN} SELECT vec_id, list_id, round(pow(list_distance(v, cv), 2), 6) AS score, round(list_sum(list_transform(range(1, 65), lambda i: v[i] - cv[i])), 5) AS total FROM l JOIN e USING (vec_id) JOIN c USING (list_id)")
def residuals(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("vec_id", "embedding")
    c = rows.where(F.col("vec_id") < NLIST).select(F.col("vec_id").cast("int").alias("list_id"), F.col("embedding").alias("cv"))
    both = kmeans.assign(rows, _fixed(rows, NLIST)).join(F.broadcast(c), "list_id")  # NLIST rows
    r = both.withColumn("r", vectors.subtract("embedding", "cv"))
    return r.select("vec_id", "list_id", F.round(-vectors.score(Metric.L2, "embedding", "cv"), 6).alias("score"), F.round(F.aggregate("r", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@_query("SELECT * FROM (VALUES ('L2', 'l2', false), (' Cosine ', 'cosine', true), ('dot', 'unknown', false), ('8, 16,x,, 32', '8,16,32', false)) t(given, parsed, is_cosine)")
def parsed_arguments(spark, sf_dir):
    out = []
    for name in ("L2", " Cosine ", "dot"):
        try:
            m = Metric.parse(name)
            out.append((name, m.value, m.is_cosine))
        except ValueError:
            out.append((name, "unknown", False))
    given = "8, 16,x,, 32"
    out.append((given, ",".join(map(str, files.parse_list(given))), False))
    return spark.createDataFrame(out, "given string, parsed string, is_cosine boolean")


@_query(_ranked(f"WITH {_Q}, {_E}, s AS (SELECT qid, vec_id, {_COS} AS score FROM q, e)"))
def ivf_full_probe(spark, sf_dir):
    """A trained index of which every list is probed: the exact result."""
    rows = _rows(spark, sf_dir).select("vec_id", "embedding")
    return _out(IvfIndex.build(rows, params=IvfParams(nlist=16, nprobe=16)).filed().search(_asks(rows), K))


def _whole_pq(rows: DataFrame) -> IvfPqIndex:
    """A trained index that looks at every list and ranks every row again by its vector."""
    return IvfPqIndex.build(rows, params=IvfPqParams(nlist=16, nprobe=16, refine=1 << 30, m=8, nbits=5, opq_mode="pca-perm")).filed()


@_query(_ranked(f"WITH {_Q}, {_E}, b AS (SELECT qid, vec_id, {_COS} AS x, {_DECAY} AS f FROM q, e), s AS (SELECT qid, vec_id, CASE WHEN x > 0 THEN x * f ELSE x / f END AS score FROM b)"))
def ivfpq_full_refine_decay(spark, sf_dir):
    rows = _tagged(_rows(spark, sf_dir)).select("vec_id", "embedding", "tags", "ts")
    return _out(_whole_pq(rows).search(_asks(rows), K, now=NOW, rate=RATE))


@_query(_ranked(f"WITH {_Q}, {_E}, s AS (SELECT qid, vec_id, {_COS} AS score FROM q, e WHERE tags & 6 <> 0)"))
def ivfpq_filtered(spark, sf_dir):
    rows = _tagged(_rows(spark, sf_dir)).select("vec_id", "embedding", "tags", "ts")
    return _out(_whole_pq(rows).search(_asks(rows), K, tag_mask=6))


@_query(_sql["hybrid_search"])
def hybrid_ivfpq_search(spark, sf_dir):
    """Over a trained base: tombstoned rows leave its lists before anything is ranked."""
    rows = _rows(spark, sf_dir).select("vec_id", "embedding")
    delta = rows.where("vec_id % 3 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    dead = rows.unionByName(delta).where("vec_id % 10 = 3").select("vec_id")
    return _out(HybridIndex(_whole_pq(rows), delta, dead).search(_asks(rows), K))


@_query(_ranked(f"WITH {_Q}, {_E}, {_LIVE}, s AS (SELECT qid, vec_id, list_cosine_similarity(qv, v) AS score FROM q, w)"))
def ivf_upsert_search(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    new = _tagged(rows).select("vec_id", "embedding", "tags")
    flipped = new.where("vec_id % 7 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    added = new.where("vec_id % 7 = 1").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    return _out(_ivf(rows).upsert(flipped.unionByName(added)).search(_asks(rows), K, nprobe=NLIST))


@_query(f"WITH {_E}, {_C}, {_ASSIGN} SELECT list_id, count(*) AS n, 0::BIGINT AS out_of_order FROM l WHERE vec_id % 10 <> 3 GROUP BY list_id")
def compact_order(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    lists = _ivf(rows).delete(rows.where("vec_id % 10 = 3")).compact().filed().lists

    def run(batches):
        last: dict = {}
        for b in batches:
            of, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            wrong = []
            for c, i in zip(of, ids):
                wrong.append(int(last.get(c, -1) >= i))
                last[c] = i
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(wrong, pa.int64())], names=["list_id", "wrong"])

    return lists.select("list_id", "vec_id").mapInArrow(run, "list_id int, wrong long").groupBy("list_id").agg(F.count(F.lit(1)).alias("n"), F.sum("wrong").alias("out_of_order"))


@_query(f"""WITH {_E}, {_C}, {_ASSIGN}, c1 AS (SELECT list_id, list(x ORDER BY i) AS cv FROM (SELECT list_id, i, avg(v[i]) AS x FROM l JOIN e USING (vec_id), range(1, 65) t(i) GROUP BY list_id, i) GROUP BY list_id),
l1 AS (SELECT vec_id, arg_min(list_id, struct_pack(d := round(d, 12), i := list_id)) AS list_id FROM (SELECT e.vec_id, c1.list_id, pow(list_distance(v, cv), 2) AS d FROM e, c1) GROUP BY vec_id)
SELECT list_id, (i - 1)::INT AS i, round(avg(v[i]), 6) AS x FROM l1 JOIN e USING (vec_id), range(1, 65) t(i) GROUP BY list_id, i""")
def kmeans_two_rounds(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("vec_id", "embedding")
    c = kmeans.refine(rows, _fixed(rows, NLIST), rounds=1)
    return kmeans.update(kmeans.assign(rows, c)).select("list_id", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


@_query(f"SELECT {NLIST} AS lists, true AS means, true AS nearest")
def kmeans_converged(spark, sf_dir):
    """Training ends where every centroid is the mean of the rows that are nearest to it."""
    rows = _rows(spark, sf_dir).select("vec_id", "embedding")
    _, x = kmeans.sample_rows(rows)
    c = kmeans.fit(x, NLIST, seed=4, max_iters=500)
    means = {r["list_id"]: np.array(r["centroid"]) for r in kmeans.update(kmeans.assign(rows, c)).collect()}
    every = kmeans.distances(x, c)
    own = every.argmin(axis=1)
    near = np.isclose(every[np.arange(len(x)), own], every.min(axis=1)).all()
    return spark.createDataFrame([(len(means), all(np.allclose(means[i], c[i], atol=1e-6) for i in means), bool(near))], "lists int, means boolean, nearest boolean")


@_query("WITH n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS n FROM embeddings) SELECT vec_id FROM n WHERE place % ceil(n / 100.0)::BIGINT = 0")
def strided_sample(spark, sf_dir):
    return kmeans.strided(_rows(spark, sf_dir), 100).select("vec_id")


@_query("SELECT 100 AS n, 100 AS different, true AS of_the_table, true AS repeatable")
def sample_without_replacement(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    ids, _ = kmeans.sample_rows(rows, 100, seed=9)
    again, _ = kmeans.sample_rows(rows.repartition(7), 100, seed=9)
    known = rows.select("vec_id").join(spark.createDataFrame([(int(i),) for i in ids], "vec_id long"), "vec_id", "left_semi").count()
    return spark.createDataFrame([(len(ids), len(set(ids.tolist())), known == len(ids), bool((ids == again).all()))], "n int, different int, of_the_table boolean, repeatable boolean")


@_query("SELECT vec_id, (i - 1)::INT AS i, round(CASE WHEN i % 2 = 1 THEN -1 ELSE 1 END * embedding[65 - i]::DOUBLE, 6) AS x FROM embeddings, range(1, 65) t(i)")
def opq_apply(spark, sf_dir):
    flip = np.diag(np.where(np.arange(64) % 2 == 1, -1.0, 1.0))
    return _places(opq.Transform(64, flip, np.arange(64)[::-1]).apply_table(_rows(spark, sf_dir)), "vec_id")


_FLAT_RK = f"t AS (SELECT qid, vec_id, rk FROM (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY round({_COS}, 9) DESC, vec_id) AS rk FROM q, e) WHERE rk <= {K})"
_IVF_RK = f"f AS (SELECT qid, vec_id, rk FROM (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY round({_COS}, 9) DESC, vec_id) AS rk FROM q JOIN p USING (qid) JOIN l USING (list_id) JOIN e USING (vec_id)) WHERE rk <= {K})"


@_query(f"""WITH {_Q}, {_E}, {_C}, {_ASSIGN}, {_PROBE}, {_FLAT_RK}, {_IVF_RK}, m AS (SELECT vec_id, coalesce(label, -1) % 3 AS d, coalesce(label, -1) AS t FROM embeddings)
SELECT (SELECT avg((a.d <> b.d OR a.t <> b.t)::INT) FROM f JOIN m a USING (vec_id) JOIN m b ON b.vec_id = f.qid) AS wrong_context, (SELECT avg((t.vec_id IS DISTINCT FROM f.vec_id)::INT) FROM t LEFT JOIN f ON f.qid = t.qid AND f.rk = 1 WHERE t.rk = 1) AS wrong_first""")
def context_error_rates(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    memories = rows.select("vec_id", (F.coalesce("label", F.lit(-1)) % 3).alias("domain"), F.coalesce("label", F.lit(-1)).alias("topic"))
    asks = _asks(rows)
    about = memories.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "domain", "topic")
    return evaluate.context_errors(_ivf(rows).search(asks, K), FlatIndex(rows).search(asks, K), memories, about)


@_query(f"WITH {_Q}, {_E}, {_FLAT_RK} SELECT qid, avg(vec_id % 730) AS day FROM t GROUP BY qid")
def mean_day_of_hits(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return evaluate.mean_day(FlatIndex(rows).search(_asks(rows), K), rows.withColumn("day_idx", F.col("vec_id") % 730))


_BOUND = "round(greatest((s / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(s / n * (1 - s / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 0), 6)"


@_query(f"""WITH {_Q}, {_E}, {_C}, {_ASSIGN}, {_FLAT_RK}, p AS (SELECT qid, list_id, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(qv, cv), 9) DESC, list_id) AS n FROM q, c),
f AS (SELECT np, qid, vec_id FROM (SELECT np, qid, vec_id, row_number() OVER (PARTITION BY np, qid ORDER BY round({_COS}, 9) DESC, vec_id) AS rk FROM (SELECT unnest([1, 2, 4, 8, 16]) AS np) JOIN p ON p.n <= np JOIN q USING (qid) JOIN l USING (list_id) JOIN e USING (vec_id)) WHERE rk <= {K}),
h AS (SELECT np, (SELECT count(*) FROM t)::DOUBLE AS n, count(t.vec_id)::DOUBLE AS s FROM f LEFT JOIN t ON t.qid = f.qid AND t.vec_id = f.vec_id GROUP BY np)
SELECT 'nprobe=' || np AS config, round(s / n, 6) AS recall, {_BOUND} AS lb95 FROM h""")
def recall_curve(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    asks = _asks(rows)
    index = _ivf(rows).filed()
    runs = evaluate.curve(lambda n: lambda q, k: index.search(q, k, nprobe=n), FlatIndex(rows).search(asks, K), asks, K, NLIST, singles=0)
    return runs.select("config", F.round("recall", 6).alias("recall"), F.round("lb95", 6).alias("lb95"))


@_query(f"WITH {_Q}, {_E}, {_C}, {_ASSIGN}, {_PROBE}, {_FLAT_RK}, {_IVF_RK}, x AS (SELECT qid, vec_id FROM f WHERE rk <= 3), h AS (SELECT t.qid, count(x.vec_id) AS hits, count(*) AS n FROM t LEFT JOIN x ON x.qid = t.qid AND x.vec_id = t.vec_id GROUP BY t.qid), m AS (SELECT qid, count(*) AS m FROM x GROUP BY qid) SELECT h.qid, hits, round(hits / least(n, m)::DOUBLE, 6) AS recall FROM h JOIN m USING (qid)")
def recall_of_the_shorter(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    asks = _asks(rows)
    out = evaluate.recall_shared(FlatIndex(rows).search(asks, K), _ivf(rows).search(asks, 3))
    return out.withColumn("recall", F.round("recall", 6))


@_query(f"WITH g AS (SELECT count(*) * {K}::DOUBLE AS n, count(*) * {K}::DOUBLE AS s, count(*) AS queries FROM embeddings WHERE vec_id % 20 = 0) SELECT queries, 1.0::DOUBLE AS recall, {_BOUND} AS lb95, true AS passed, false AS passed_in_no_time, true AS timed FROM g")
def freeze_gates(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("vec_id", "embedding")
    params = IvfPqParams(nlist=8, nprobe=8, refine=1 << 30, m=8, nbits=4)
    run, ok = evaluate.freeze(rows, _asks(rows), K, params, lb95=0.9, singles=3)
    late = evaluate.passes(run, 0.9, p95_ms=1e-6)
    return spark.createDataFrame([(run.queries, run.recall, round(run.lb95, 6), ok, late, 0 < run.p50_ms <= run.p95_ms)], "queries long, recall double, lb95 double, passed boolean, passed_in_no_time boolean, timed boolean")


@_query(f"SELECT * FROM (VALUES ({', '.join(repr(x) for x in ('nprobe=4', 4, 20))}, 26), ({', '.join(repr(x) for x in ('nprobe=16', 16, 20))}, 26)) t(run, probes, reranked, columns)")
def sweep_csv(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("vec_id", "embedding")
    asks = _asks(rows)
    index = IvfPqIndex.build(rows, params=IvfPqParams(nlist=16, m=8, nbits=4)).filed()
    runs = evaluate.sweep(lambda nprobe, refine: lambda q, k: index.search(q, k, nprobe=nprobe, refine=refine), FlatIndex(rows).search(asks, K), asks, K, singles=1, nprobe=[4, 16], refine=[20])
    path = new_path(spark, "runs")
    evaluate.sweep_file(runs, index, rows.count(), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(F.concat(F.lit("nprobe="), "probes").alias("run"), F.col("probes").cast("int").alias("probes"), F.col("reranked").cast("int").alias("reranked"), F.lit(len(back.columns)).alias("columns"))


@_query("SELECT true AS each_agent_asked, true AS all_answered, true AS timed")
def load_test(spark, sf_dir):
    index = FlatIndex(datagen.uniform(spark, 500, 16))
    got = evaluate.load(index.search, lambda turn: datagen.agent_queries(spark, 5, 16, turn), K, 0.2, threads=3)
    return spark.createDataFrame([(got["batches"] >= 3, got["queries"] == got["batches"] * 5, 0 < got["p50_ms"] <= got["p99_ms"] and got["qps"] > 0)], "each_agent_asked boolean, all_answered boolean, timed boolean")


@_query("SELECT vec_id, 'dead' AS kind FROM embeddings WHERE vec_id % 10 = 0 UNION ALL SELECT 999000 + i AS vec_id, 'new' AS kind FROM range(0, 100) t(i)")
def stress_mutation(spark, sf_dir):
    delta, dead = mutate(_rows(spark, sf_dir))
    return dead.withColumn("kind", F.lit("dead")).unionByName(delta.select("vec_id", F.lit("new").alias("kind")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
