"""Intermediate tables written to the folder that driver and executors share, so that lineage ends there and lost executors cost little."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting of how many partitions a task writes at once.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Spark's setting of whether both sides of a join are dealt by all of its columns; without it a side that is dealt by some of them stays where it is.
ALL_COLUMNS = "spark.sql.requireAllClusterKeysForCoPartition"
#: Spark's setting of how many shares an exchange deals.
SHARES = "spark.sql.shuffle.partitions"

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir or by setCheckpointDir; a temporary one only for a local master, where driver and executors are one process."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not path and (named := context._jsc.sc().getCheckpointDir()).isDefined():
        path = named.get()
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, by: str | None = None, dealt: bool = False, shares: int | None = None) -> tuple[DataFrame, str]:
    """df as a Parquet table of the shared folder (with a folder for each value of `by`, a text), and the table's path.

    dealt: whether joins leave a side that is dealt by some of their columns where it is.  shares: how many shares exchanges deal, if more than Spark's setting.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{os.getpid()}-{uuid.uuid4().hex}"
    # with `by` a writer for each of the few values: rows are not sorted by it first
    wanted = ({WRITERS: "16"} if by else {}) | ({ALL_COLUMNS: "false"} if dealt else {})
    if (shares or 0) > int(spark.conf.get(SHARES)):
        wanted[SHARES] = str(shares)
    held = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    if not _written:
        atexit.register(lambda: [drop(p) for p in list(_written)])
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path), path


def drop(path: str) -> None:
    """Delete a written table."""
    spark = _written.pop(path, None)
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at exit
        return
