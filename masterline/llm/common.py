"""What the operators share: stored intermediate tables, row grouping, sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from masterline.llm.packing import blocks

#: Bytes of text that a task turns into Python's objects at once.
PIECE = 1 << 20
#: Rows of long texts that Spark reads from Parquet and sends to Python at once.
BATCH_ROWS = 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors reach.

    Where it is unset a local session (as in tests) gets a temporary folder of
    its own; any other session is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="masterline-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def store(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Rows of megabytes go in files of ``rows_per_file`` (by default as they come): the reader
    and the writer hold all the rows of a page at once, whatever their size.

    Cuts the lineage: what was written survives the loss of any executor, and
    values such as row numbers stay fixed for all later readers. The files go
    when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/masterline-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """For what is run in it, batches of at most ``BATCH_ROWS`` rows: Spark's defaults count
    rows, not bytes, and batches of texts take tens of megabytes in the JVM, beside it and in Python."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    was = {k: spark.conf.get(k) for k in keys}
    try:
        for k, rows in was.items():
            spark.conf.set(k, str(min(int(rows), BATCH_ROWS) if int(rows) > 0 else BATCH_ROWS))
        yield
    finally:
        for k, rows in was.items():
            spark.conf.set(k, rows)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` (null: empty) of a table, whatever else it holds."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LAST_ID = (1 << 63) - 1


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    while name in df.columns:
        name = f"_{name}"
    return name


def with_number(df: DataFrame, id_col: str, name: str) -> DataFrame:
    """Adds ``name``, a long that orders rows as their id does; a null id has the largest.

    A whole number stands for itself. Ids of another type are sorted in parts, and numbered by
    part and place; the numbers are stored, so that they stay the same.
    """
    if isinstance(df.schema[id_col].dataType, T.IntegralType):
        return df.withColumn(name, F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)))
    ids = df.select(F.col(id_col).alias("__of")).where("__of IS NOT NULL").distinct()
    ranged = ids.repartitionByRange(n_partitions(df.sparkSession), "__of").sortWithinPartitions("__of")
    numbers = store(ranged.withColumn("__number", F.monotonically_increasing_id()))
    joined = df.join(numbers, F.col(id_col) == F.col("__of"), "left")
    return joined.withColumn(name, F.coalesce("__number", F.lit(LAST_ID))).drop("__of", "__number")


def grouped(batches, *keys: str):
    """Consecutive rows with equal keys, as one table each, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        marks = list(zip(*columns, strict=True))
        start = 0
        for i, mark in enumerate(marks):
            if mark != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, mark
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in order, in batches of at most ``most`` bytes (by default
    ``PIECE``) of ``column``, or of one row. An Arrow batch has 10,000 rows however long they are,
    and workers keep what their largest batch took."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for part in blocks(sizes, most or PIECE):
            yield batch.slice(part.start, part.stop - part.start)


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node that links reach, for the nodes of ``a``-``b`` links.

    Large-star and small-star steps in turn, each an aggregate and a join, until
    nothing changes; a node with very many links is a skewed join key only. Nodes
    without links are left out.
    """

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    links = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    was = mark(links)
    while was[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = store(large.where("a > b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = store(small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a > b").distinct())
        now = mark(links)
        if now == was:
            break
        was = now
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
