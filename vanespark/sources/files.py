"""Text and vector files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) from lines of JSON. A broken line or an id that is missing or negative is an error; other text is ''."""
    rows = spark.read.schema("id long, text string").option("mode", "FAILFAST").json(path)
    bad = F.raise_error(F.lit("id must be a whole number of 0 or more"))
    return rows.select(F.when(F.col("id").isNull() | (F.col("id") < 0), bad).otherwise(F.col("id")).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))


def write_jsonl(texts: DataFrame, path: str) -> None:
    texts.select("id", "text").write.json(path)


def read_vector_csv(spark: SparkSession, path: str, dim: int | None = None, strict: bool = True) -> DataFrame:
    """(vec_id, embedding) from lines id,v1,...,vd without a header; blank lines are skipped.

    With ``dim``, values beyond it are dropped and too few are an error; without it each line has its own length. Unless
    ``strict``, bad lines are left out.
    """
    cells = F.split(F.trim("value"), "\\s*,\\s*")
    rows = spark.read.text(path).where(F.trim("value") != "").select("value", cells.alias("c"))
    values = F.slice("c", 2, dim) if dim else F.slice("c", 2, 1 << 30)
    v = F.transform(values, lambda x: x.try_cast("float"))
    out = rows.select("value", F.get("c", F.lit(0)).try_cast("long").alias("vec_id"), v.alias("embedding"))
    ok = F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()) & (F.size("embedding") == (F.lit(dim) if dim else F.size("embedding"))) & (F.size("embedding") > 0)
    if not strict:
        return out.where(ok).select("vec_id", "embedding")
    bad = F.raise_error(F.concat(F.lit("not a vector: "), F.substring("value", 1, 80)))
    return out.select(F.when(ok, F.col("vec_id")).otherwise(bad).cast("long").alias("vec_id"), "embedding")


def write_vector_csv(rows: DataFrame, path: str) -> None:
    line = F.concat_ws(",", F.col("vec_id").cast("string"), F.transform("embedding", lambda x: x.cast("string")))
    rows.select(line.alias("value")).write.text(path)


def parse_list(text: str) -> list[int]:
    """Whole numbers of a comma-separated list; other entries are dropped."""
    return [int(x) for x in (p.strip() for p in text.split(",")) if x.isdigit()]
