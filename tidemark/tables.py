"""Reading the input tables and the guards that keep plans safe at any size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when the optimiser's estimate of its bytes is below this.
BROADCAST_BYTES = 32 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data directory, a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate of a plan (column pruning included); no job runs."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its estimated size is within ``limit`` (BROADCAST_BYTES).

    Beyond the limit the frame is returned as it is, so that Spark picks a shuffled
    join; AQE then splits skewed partitions of it.
    """
    return F.broadcast(df) if estimated_bytes(df) <= (BROADCAST_BYTES if limit is None else limit) else df


def spread(table: DataFrame, limit: int = 128 << 20) -> DataFrame:
    """A scanned table over all cores before costly Python work, if it lies in fewer partitions and is small.

    Larger tables have partitions enough and are left where they are scanned.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(table) > limit or table.rdd.getNumPartitions() >= cores:
        return table
    return table.repartition(cores)


def training_rows(table: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About ``rows`` rows of a table to fit a model on, by the hash of their keys; all of a smaller table.

    Only models are fitted on this, so that fitting costs the same at any size of the data.
    """
    n = table.count()
    if n <= rows:
        return table
    step = -(-n // rows)
    return table.where(F.pmod(F.xxhash64(*keys), F.lit(step)) == 0)


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share (spark.checkpoint.dir).

    Where it is unset it is set to a temporary folder on a local master, as in tests, and is
    an error on a cluster, whose machines would not see each other's files.
    """
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not place:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        import tempfile

        place = "file://" + tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        drop_at_end(spark, place)
    if not context.getCheckpointDir():
        context.setCheckpointDir(place)
    return place


def drop_at_end(spark: SparkSession, place: str) -> None:
    """Have a file or folder deleted when the session's process ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, dropped when the session's process ends."""
    place = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    spark._jvm.org.apache.hadoop.fs.Path(place).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(place))
    drop_at_end(spark, place)
    return place
