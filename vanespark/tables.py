"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_base: dict[str, str] = {}
_own_dirs: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir. Where that is unset, as in tests, a local session gets a temporary
    folder; on a cluster, whose machines would each write to a folder of their own, it is an error."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _own_base:
            _own_base[app] = "file://" + tempfile.mkdtemp(prefix="vanespark-")
        base = _own_base[app]
    root = f"{base.rstrip('/')}/vanespark-{app}"
    if not any(d == root for _, d in _own_dirs):
        _own_dirs.append((spark, root))
    return root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`table_of`."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_all(spark: SparkSession) -> None:
    """Delete all tables that this session has written: for a long session, once their results have been written elsewhere."""
    for own, root in _own_dirs:
        if own is spark:
            drop_table(spark, root)


@atexit.register
def _drop_at_exit() -> None:
    for spark, root in _own_dirs:
        try:
            drop_table(spark, root)
        except Exception:  # noqa: BLE001  the session may be gone already; the folder's owner cleans it then
            pass


def table_of(df: DataFrame, name: str = "t") -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here and lost executors cost no recomputation of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str = "t") -> DataFrame:
    return table_of(df, name)[0]
