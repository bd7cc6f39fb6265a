"""Fits kept on disk: every table and every fact of a fit, committed by one manifest.

A fit is written into a folder of its own under ``versions``.  Only when all of it is
there is the manifest, which names that folder, renamed into place; the rename is atomic
and refuses to replace (on HDFS and local disks; an object store without it is an error
there).  So a writer that stops half-way leaves nothing that counts, and of two
writers at once the first to commit is the one that both then read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from masterline.plans.em import DcmFit, Irt2plFit

MANIFEST = "manifest.json"
FORMAT = 1
KINDS = {"DcmFit": DcmFit, "Irt2plFit": Irt2plFit}

Fit = DcmFit | Irt2plFit | dict


class AlreadyStored(RuntimeError):
    """Another writer has committed a fit under this path."""


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    _, place, files = _files(spark, path)
    return files.exists(place)


def _fact(value):
    """Values as JSON has them; a mapping as pairs, since its keys may be numbers."""
    return {"pairs": [[k, v] for k, v in value.items()]} if isinstance(value, dict) else value


def _unfact(value):
    return {k: v for k, v in value["pairs"]} if isinstance(value, dict) else value


def save_fit(fit: Fit, path: str, replace: bool = False) -> None:
    """Store a fit, or a dict of tables and facts, under ``path``.

    ``replace`` puts it in place of a committed one, whose files stay for readers that
    have opened it; without it a committed fit raises :class:`AlreadyStored`.
    """
    values = fit if isinstance(fit, dict) else fit._asdict()
    tables = {k: v for k, v in values.items() if isinstance(v, DataFrame)}
    if not tables:
        raise ValueError("a fit needs at least one table")
    spark = next(iter(tables.values())).sparkSession
    if not replace and _exists(spark, f"{path}/{MANIFEST}"):
        raise AlreadyStored(path)
    version = f"versions/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    manifest = {
        "format": FORMAT,
        "kind": "dict" if isinstance(fit, dict) else type(fit).__name__,
        "version": version,
        "tables": {name: df.schema.jsonValue() for name, df in tables.items()},
        "facts": {k: _fact(v) for k, v in values.items() if k not in tables},
    }
    draft = f"{path}/{version}/{MANIFEST}"
    jvm, place, files = _files(spark, draft)
    out = files.create(place, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if replace else rename.NONE
    target = files.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}"))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(place), target, how)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            raise AlreadyStored(path) from error
        raise


def load_fit(spark: SparkSession, path: str) -> Fit | None:
    """The committed fit, or None where there is none.  A manifest that can't be read, or
    whose tables are gone, is an error."""
    if not _exists(spark, f"{path}/{MANIFEST}"):
        return None
    manifest = json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()[0])
    if manifest["format"] != FORMAT:
        raise ValueError(f"a fit stored in format {manifest['format']}; this reads {FORMAT}")
    values = {k: _unfact(v) for k, v in manifest["facts"].items()}
    for name, schema in manifest["tables"].items():
        values[name] = spark.read.schema(StructType.fromJson(schema)).parquet(f"{path}/{manifest['version']}/{name}")
    return values if manifest["kind"] == "dict" else KINDS[manifest["kind"]](**values)


def fit_or_load(spark: SparkSession, path: str, fit_fn: Callable[[], Fit]) -> Fit:
    """The fit stored under ``path``; where there is none, ``fit_fn`` is called and its fit stored.

    Whoever commits first is read by all, so that callers at the same time agree.
    """
    found = load_fit(spark, path)
    if found is None:
        try:
            save_fit(fit_fn(), path)
        except AlreadyStored:
            pass
        found = load_fit(spark, path)
    return found
