"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the folder that setCheckpointDir has made.

    Where neither is set a local session (tests) gets a folder of our own; a cluster, which could not read back what its
    executors write to their own disks, gets an error.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def saved(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are saved within are deleted at its end, but for those that what it gives, (df, kind), has saved.

    What is used after it must depend on none of the others.
    """
    _scratch.append([])

    def keep(df: DataFrame, kind: str = "table") -> DataFrame:
        out = saved(df, kind)
        path = _scratch[-1].pop()
        if len(_scratch) > 1:
            _scratch[-2].append(path)  # the next one around may drop it
        return out

    try:
        yield keep
    finally:
        for path in _scratch.pop():
            dropped(spark, path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete what is written under path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Stands for a null id within pandas, where a column of longs with nulls would turn into floats.
NO_ID = -(2**63)


def whole_id(column: Column) -> Column:
    """An id as a long without nulls. Null comes before all ids."""
    return F.coalesce(column.cast("long"), F.lit(NO_ID))


def shown_id(column: Column) -> Column:
    """whole_id undone."""
    return F.when(column != NO_ID, column)


def own_prefix(df: DataFrame) -> str:
    """A beginning that no column of df has, whatever their case: for columns that are added for a while."""
    out = "__"
    while any(c.lower().startswith(out) for c in df.columns):
        out += "_"
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; lower() does that, and faster, where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, A_Z, a_z))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
