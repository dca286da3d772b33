"""Intermediate tables in the folder that all executors share, and broadcasts of checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table is sent to all tasks; beyond, Spark chooses how to join.
SMALL_ROWS = 100_000
#: Folders and tables that were staged, by application; ``release`` drops them.
_staged: dict[str, list[tuple[str, str]]] = {}
#: Folders that were made where the session names none, by application.
_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names. Where it names none, a local one is made, but only if the executors run in
    this process, as in tests: others couldn't see it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        application = spark.sparkContext.applicationId
        where = _made.get(application) or "file://" + tempfile.mkdtemp(prefix="quarryline-")
        _made[application] = where
    return where


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, which ``release`` drops."""
    path = f"{shared_dir(spark)}/quarryline/{name}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(("path", path))
    return path


def new_table(spark: SparkSession, name: str) -> str:
    """A name for a table of the shared warehouse, which ``release`` drops."""
    table = f"quarryline_{name}_{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(("table", table))
    return table


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet to the shared folder and reads it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Drops all that this application has staged, and says how much that was; for when its results have been
    written or read, since they are computed from it."""
    staged = _staged.pop(spark.sparkContext.applicationId, [])
    for kind, name in staged:
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(staged)


def parts(spark: SparkSession, rows: int, share: int) -> int:
    """Into how many partitions so many rows go, at most ``share`` to each on average, so that a task's part doesn't grow
    with the table; all cores have some, unless rows are few."""
    return max(min(spark.sparkContext.defaultParallelism, 1 + rows // 1_000), -(-rows // share))


def small(table: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The table with a broadcast hint if it has at most ``rows`` rows, which are counted; else without."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table
