"""Readers and writers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from masterline.functions.text import drop_extension, file_name, plain_path
from masterline.operators.joins import left_join
from masterline.operators.ranking import rowid
from masterline.operators.verbs import to_long


def read_responses(spark: SparkSession, path: str, id_col: str, item_name: str = "item_id") -> DataFrame:
    """Wide 0/1 response table -> (id, item, score); a missing answer is no row.

    The unpivot is a narrow step: one scan, no shuffle.
    """
    return responses_to_long(spark.read.parquet(path), id_col, item_name)


def responses_to_long(wide: DataFrame, id_col: str, item_name: str = "item_id") -> DataFrame:
    long = to_long(wide, [id_col], name=item_name, value="score")
    return long.filter(F.col("score").isNotNull()).withColumn(item_name, F.col(item_name).cast("int"))


def read_qmatrix(spark: SparkSession, path: str, order: list[str], attrs: list[str] | None = None) -> DataFrame:
    """Q-matrix with numbered items: (item_id, attributes..., q_mask).

    Files have no row order in Spark, so the column that orders items is given.
    """
    return number_items(spark.read.parquet(path), order, attrs)


def number_items(q: DataFrame, order: list[str], attrs: list[str] | None = None) -> DataFrame:
    attrs = attrs or [c for c in q.columns if c not in order]
    mask = sum((F.col(a) * (1 << k) for k, a in enumerate(attrs)), F.lit(0))
    numbered = rowid(q, "__item", order)
    return numbered.select(F.col("__item").cast("int").alias("item_id"), *attrs, mask.cast("int").alias("q_mask"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result table with its plotting position: x = theta, y constant."""
    return with_position(spark.read.parquet(path))


def with_position(results: DataFrame) -> DataFrame:
    return results.withColumns({"x": F.col("theta"), "y": F.lit(0.02)})


def read_dim(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Write and hand back the stored table, so later steps may go on from it."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """Paths under a glob; only the path is asked for, so no file is read."""
    return spark.read.format("binaryFile").load(glob).select("path")


def catalogue_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, file, name, n_rows) of the Parquet files under a glob, tables of any schemas together.

    No column is read: with an empty schema the scan counts rows by the files' footers, and
    the path is its metadata column.  A file without rows is listed with 0.
    """
    paths = list_files(spark, glob)
    rows = spark.read.schema(StructType([])).parquet(glob).select(F.col("_metadata.file_path").alias("path"))
    counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n_rows"))
    listed = paths.select(plain_path(F.col("path")).alias("path"))
    found = left_join(listed, counts.select(plain_path(F.col("path")).alias("path"), "n_rows"), ["path"]).fillna({"n_rows": 0})
    name = file_name(F.col("path"))
    return found.select("path", name.alias("file"), drop_extension(name).alias("name"), "n_rows")


def enrich(df: DataFrame, dim: DataFrame, keys: list, columns: list[str] | None = None) -> DataFrame:
    """Left join on a dimension, keeping only the wanted columns of it."""
    right = [k if isinstance(k, str) else k[1] for k in keys]
    return left_join(df, dim if columns is None else dim.select(*right, *columns), keys)


PLAYLIST_SCHEMA = (
    "struct<tracks: struct<items: array<struct<track: struct<album: "
    "struct<name: string, album_type: string, artists: array<struct<name: string>>>>>>>>"
)


def flatten_playlists(df: DataFrame, payload: str = "payload", kind: str = "album") -> DataFrame:
    """Nested playlist payloads (JSON text) -> one (album, artist) row each."""
    album = F.explode(F.from_json(payload, PLAYLIST_SCHEMA)["tracks"]["items"]["track"]["album"]).alias("a")
    return (
        df.select(album)
        .filter(F.col("a.album_type") == kind)
        .select(F.col("a.name").alias("album"), F.explode("a.artists.name").alias("artist"))
    )
