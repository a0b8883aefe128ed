"""Seeded vector tables. Every row depends on (seed, id) alone, however rows are dealt to tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanespark.functions.hashing import fnv1a, splitmix, unit_floats


def _rng(seed: int, at: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[seed & 0xFFFFFFFFFFFFFFFF, at]))


def _table(spark: SparkSession, n: int, make: Callable[[int], np.ndarray], first_id: int, normalize: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            x = [make(i - first_id) for i in ids]
            if normalize:
                x = [v / (np.linalg.norm(v) or 1.0) for v in x]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.astype(np.float32) for v in x], type=pa.list_(pa.float32()))], names=["vec_id", "embedding"])

    return spark.range(first_id, first_id + n).select(F.col("id").alias("vec_id")).mapInArrow(run, "vec_id long, embedding array<float>")


def uniform(spark: SparkSession, n: int, dim: int, seed: int = 42, normalize: bool = True, first_id: int = 0) -> DataFrame:
    """Coordinates in [-0.5, 0.5)."""
    return _table(spark, n, lambda i: unit_floats(splitmix(seed * 1_000_003 + i, dim)) - 0.5, first_id, normalize)


def gaussian_sphere(spark: SparkSession, n: int, dim: int, seed: int = 42, normalize: bool = True, first_id: int = 0) -> DataFrame:
    return _table(spark, n, lambda i: _rng(seed, i).standard_normal(dim), first_id, normalize)


#: Names under which independent normal coordinates are asked for as well.
overlapping = power_law = noise_heavy = low_separation = gaussian_sphere


def hierarchical(spark: SparkSession, n: int, dim: int, seed: int = 42, topics: int = 10, subtopics: int = 5, normalize: bool = True, first_id: int = 0) -> DataFrame:
    """Topics with subtopics, the noise growing with the subtopic."""

    def make(i: int) -> np.ndarray:
        rng = _rng(seed, i)
        t, s = int(rng.integers(topics)), int(rng.integers(subtopics))
        return _rng(seed + 1, t).standard_normal(dim) + rng.standard_normal(dim) * (0.15 * s + 0.02)

    return _table(spark, n, make, first_id, normalize)


def decaying(spark: SparkSession, n: int, dim: int, seed: int = 42, normalize: bool = True, first_id: int = 0) -> DataFrame:
    """Standard deviation exp(-place / 20), 0.001 at least."""
    sd = np.maximum(np.exp(-np.arange(dim) / 20.0), 0.001)
    return _table(spark, n, lambda i: _rng(seed, i).standard_normal(dim) * sd, first_id, normalize)


def perturbed_queries(rows: DataFrame, n: int, sd: float = 0.01, seed: int = 999) -> DataFrame:
    """(qid, embedding): n rows chosen by a hash of id and seed, with noise, of length one."""
    picked = rows.select("vec_id", "embedding").orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.array(v) + _rng(seed, i).standard_normal(len(v)) * sd
                out.append((x / (np.linalg.norm(x) or 1.0)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, type=pa.list_(pa.float32()))], names=["qid", "embedding"])

    return picked.mapInArrow(run, "qid long, embedding array<float>")


def agent_queries(spark: SparkSession, agents: int, dim: int, turn: int = 0, seed: int = 0) -> DataFrame:
    """(qid, embedding): one query in [0, 1) for each agent and turn."""
    rows = _table(spark, agents, lambda i: unit_floats(splitmix((seed * 1_000_003 + i) * 1_000_003 + turn, dim)), 0, False)
    return rows.withColumnRenamed("vec_id", "qid")


def semantic_base(name: str, dim: int = 128) -> np.ndarray:
    """A unit vector that a name stands for."""
    v = unit_floats(splitmix(fnv1a(name.encode()), dim)) * 2 - 1
    return v / np.linalg.norm(v)


def memories(spark: SparkSession, per_topic: int, domains=("rust", "cooking", "travel"), topics=("basics", "tools", "history"), base_ts: int = 1_700_000_000, days: int = 730, jitter: float = 0.05, dim: int = 128, seed: int = 7) -> DataFrame:
    """(vec_id, domain, topic, tags, source, session, day_idx, ts_s, semantic): a corpus for context-aware retrieval."""
    names = [(d, t) for d in domains for t in topics]
    base = [semantic_base(f"{d}::{t}", dim) for d, t in names]
    schema = pa.schema([("vec_id", pa.int64()), ("domain", pa.string()), ("topic", pa.string()), ("day_idx", pa.int32()), ("semantic", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in b.column(0).to_pylist():
                k, rng = i // per_topic, _rng(seed, i)
                v = base[k] + rng.uniform(-jitter, jitter, dim)
                rows.append((i, *names[k], int(rng.integers(days)), v / np.linalg.norm(v)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], type=f.type) for f in schema], schema=schema)

    out = spark.range(per_topic * len(names)).mapInArrow(run, "vec_id long, domain string, topic string, day_idx int, semantic array<double>")
    tags = F.array(F.concat(F.lit("domain:"), "domain"), F.concat(F.lit("topic:"), "topic"))
    return out.select("vec_id", "domain", "topic", tags.alias("tags"), F.lit("synthetic").alias("source"), F.concat(F.lit("s"), F.col("vec_id") % 100).alias("session"), "day_idx", (F.lit(base_ts).cast("long") + F.col("day_idx") * 86400).alias("ts_s"), "semantic")
