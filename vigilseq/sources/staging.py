"""Intermediate tables in the shared folder the cluster names.

A staged table cuts lineage, survives lost executors, keeps the partition
numbers stored in it stable, and tells Catalyst its exact size, so that joins
against it are broadcast only when the files are small enough.

Staged tables belong to the Spark application that wrote them: they lie in a folder
of its name and stay while results may still read them.  ``release`` removes them, all
or those of a ``scope``.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_scope: list[str] = []


def staging_root(spark: SparkSession) -> str:
    """Folder from ``spark.checkpoint.dir``; where it is unset, a temporary one of a single-process session."""
    global _local_root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="vigilseq-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def _own_folder(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/vigilseq/{spark.sparkContext.applicationId}"


def staging_path(spark: SparkSession, name: str = "table") -> str:
    return "/".join([_own_folder(spark), *_scope, f"{name}-{uuid.uuid4().hex}"])


@contextlib.contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables staged inside belong to the scope of this name."""
    _scope.append(f"scope-{name}")
    try:
        yield
    finally:
        _scope.pop()


def stage(df: DataFrame, name: str = "table", partition_by: str | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table; ``compression`` is by default the session's."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path, partitionBy=partition_by, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, name: str | None = None) -> None:
    """Remove the tables this application has staged, all or those of a scope; results that still read them are lost."""
    folder = "/".join([_own_folder(spark), *([f"scope-{name}"] if name else [])])
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
