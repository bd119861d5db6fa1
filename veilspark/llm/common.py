"""What the operators of this subpackage share: work tables, paths, small plans."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words: space and U+0009 to U+000D.
SPACES = "[\\x20\\x09-\\x0D]"
NOT_SPACES = "[^\\x20\\x09-\\x0D]"

_own: dict[str, str] = {}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is unset and executors run on the driver's machine, as in tests, a
    temporary folder is used and removed when the interpreter ends; on a cluster it must be set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="veilspark-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/veilspark-{uuid.uuid4().hex}/{name}"


#: Rows of a small work table that one task writes.
ROWS_A_FILE = 100_000


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it: a lineage cut that survives lost executors.

    ``rows``, where known, is a bound on what the table's last stage handles: a small one is dealt with in
    as few tasks, and files, as it needs, however many partitions a shuffle has.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE)))).write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._veilspark_path = path  # for remove()
    return back


def partitioned(df: DataFrame, column: str) -> DataFrame:
    """Like materialize(), in a folder for each value of a column, so that a filter on it reads no other."""
    spark = df.sparkSession
    path = work_path(spark, f"by_{column}")
    df.write.partitionBy(column).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_veilspark_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have."""
    have = {c.lower() for c in df.columns}
    name, k = f"_{stem}", 0
    while name.lower() in have:
        name, k = f"_{stem}{k}", k + 1
    return name
