"""Where a plan is cut, what may be broadcast, and how rows are spread."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="masterline-ckpt-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder.

    The result survives the loss of every executor that computed it, and what
    was decided while computing it (range boundaries, partition numbers) stays
    fixed for all later readers.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder, deleted when the application ends."""
    _ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/masterline-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast after counting that it is small; a larger one
    is returned unmarked, so the join shuffles (and AQE may split its skew)."""
    return F.broadcast(df) if is_small(df, rows) else df


def large(df: DataFrame) -> DataFrame:
    """Mark ``df`` for a shuffled join: it grows with the respondents, however small its file.

    A plan takes a table's size from its packed file, and would send one that packs well
    to the driver and from there to every executor."""
    return df.hint("merge")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all shuffle partitions before a step that multiplies
    them.  An explicit count keeps AQE from merging the still-small input."""
    return df.repartition(n_partitions(df.sparkSession), *keys)


def range_parts(df: DataFrame, cols: list, name: str = "__part") -> DataFrame:
    """Range-partition by ``cols`` and number the parts, fixed by a checkpoint.

    Parts are contiguous and ordered, and because ``cols`` should end in a
    unique column, a value holding a third of the rows still spreads over many.
    """
    ranged = df.repartitionByRange(n_partitions(df.sparkSession), *cols)
    return cut(ranged.withColumn(name, F.spark_partition_id()))
