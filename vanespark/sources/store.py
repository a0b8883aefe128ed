"""Indexes as tables: Parquet partitioned by list, and a manifest."""

from __future__ import annotations

import json
import platform
from dataclasses import asdict

import numpy as np
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanespark.functions.vectors import Metric
from vanespark.operators import opq
from vanespark.operators.ivf import IvfIndex, IvfParams
from vanespark.operators.ivfpq import IvfPqIndex, IvfPqParams
from vanespark.operators.pq import ProductQuantizer

VERSION = 3


def fingerprint(lists: DataFrame, centroids: np.ndarray, about: str) -> str:
    """A digest of parameters, centroids and all rows, vectors included, that doesn't depend on the order of rows.

    Rows are hashed where they are; sums of two independent hashes and the count are what is gathered.
    """
    import hashlib

    cols = [c for c in ("list_id", "vec_id", "embedding", "codes", "tags", "ts", "deleted") if c in lists.columns]
    a, b = F.xxhash64(*cols), F.xxhash64(F.lit(1), *reversed(cols))
    n, x, y = lists.agg(F.count(F.lit(1)), F.sum(a.cast("decimal(38,0)")), F.sum(b.cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{about}|{n}|{x}|{y}|".encode() + np.ascontiguousarray(centroids, dtype="<f8").tobytes()).hexdigest()


def _vectors(spark: SparkSession, x: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, v array<double>")


def _matrix(df: DataFrame) -> np.ndarray:
    return np.array([r[1] for r in sorted(df.collect())])


def save(index: IvfIndex | IvfPqIndex, path: str) -> str:
    """Write tables and manifest under ``path`` (which must be new) and return the fingerprint of what was written."""
    spark = index.lists.sparkSession
    kind = "ivf" if isinstance(index, IvfIndex) else "ivfpq"
    index.lists.repartition("list_id").sortWithinPartitions("list_id", "vec_id").write.partitionBy("list_id").parquet(f"{path}/lists")
    _vectors(spark, index.centroids).coalesce(1).write.parquet(f"{path}/centroids")
    about = {"kind": kind, "metric": index.metric.value, "params": asdict(index.params)}
    if kind == "ivfpq":
        index.quantizer.to_table(spark).coalesce(1).write.parquet(f"{path}/codebooks")
        if index.transform.rotation is not None:
            _vectors(spark, index.transform.rotation).coalesce(1).write.parquet(f"{path}/rotation")
        about["permutation"] = None if index.transform.permutation is None else [int(i) for i in index.transform.permutation]
        about["rotated"] = index.transform.rotation is not None
    text = json.dumps(about, sort_keys=True)
    print_of = fingerprint(_lists(spark, path), index.centroids, text)
    manifest = {"version": VERSION, "dim": index.centroids.shape[1], "about": about, "fingerprint": print_of, "spark": pyspark.__version__, "python": platform.python_version()}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return print_of


def _lists(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/lists")
    return rows.select(F.col("list_id").cast("int").alias("list_id"), *(c for c in rows.columns if c != "list_id"))


def load(spark: SparkSession, path: str, verify: bool = True) -> IvfIndex | IvfPqIndex:
    """Read what :func:`save` wrote; an older version or, with ``verify``, a fingerprint that doesn't fit is an error."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest["version"] < VERSION:
        raise ValueError(f"version {manifest['version']} is too old")
    about, c, lists = manifest["about"], _matrix(spark.read.parquet(f"{path}/centroids")), _lists(spark, path)
    if verify and fingerprint(lists, c, json.dumps(about, sort_keys=True)) != manifest["fingerprint"]:
        raise ValueError("the tables don't fit the manifest")
    metric = Metric(about["metric"])
    if about["kind"] == "ivf":
        return IvfIndex(metric, IvfParams(**about["params"]), c, lists)
    rotation = _matrix(spark.read.parquet(f"{path}/rotation")) if about["rotated"] else None
    perm = None if about["permutation"] is None else np.array(about["permutation"])
    quantizer = ProductQuantizer.from_table(spark.read.parquet(f"{path}/codebooks"))
    return IvfPqIndex(metric, IvfPqParams(**about["params"]), opq.Transform(c.shape[1], rotation, perm), c, quantizer, lists)
