"""Connected components by alternating star contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanespark.llm._util import drop_table, table_of


def _step(e: DataFrame, small: bool) -> DataFrame:
    """One star step over edges (a, b) with a > b."""
    if small:
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reachable.

    Self loops, repeated and reversed edges and nulls do no harm. Each round is written to the shared folder and replaces the
    round before; the rounds grow with the logarithm of the longest path. A hub's edges are pre-aggregated by the minimum and
    joined back, which adaptive execution splits.
    """
    spark = edges.sparkSession
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, path = table_of(e, "edges")
    mark = None
    while True:
        nxt, new_path = table_of(_step(_step(e, small=False), small=True), "edges")
        drop_table(spark, path)
        e, path = nxt, new_path
        new = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == mark or not new[0]:
            break
        mark = tuple(new)
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
