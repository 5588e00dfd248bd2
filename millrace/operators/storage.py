"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder that setCheckpointDir has made; a local session without either gets one of our own.

    On a cluster that is an error: executors can't read back what others write to their own disks.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def saved(df: DataFrame, kind: str = "table", by: str | None = None) -> DataFrame:
    """Write df and read it back: cuts the lineage, and outlives lost executors. With by, in a folder for each value."""
    path = f"{shared_dir(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a saved table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, at = _at(df.sparkSession, folder)
        fs.delete(at, True)


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of what stands in a folder; none where there is no such folder."""
    fs, at = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def marked(spark: SparkSession, path: str) -> None:
    """Make an empty file, at once: it is there or it isn't."""
    fs, at = _at(spark, path)
    fs.mkdirs(at.getParent())
    fs.createNewFile(at)


def replace(spark: SparkSession, path: str, by: str) -> None:
    """Rename path to by, in place of what stands there."""
    fs, at = _at(spark, path)
    _, to = _at(spark, by)
    fs.mkdirs(to.getParent())
    fs.delete(to, True)
    if not fs.rename(at, to):
        raise OSError(f"can't rename {path} to {by}")


def guard(spark: SparkSession, folder: str, config: dict) -> None:
    """A folder belongs to one configuration: another one is refused."""
    want = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()
    if exists(spark, f"{folder}/identity"):
        if spark.read.text(f"{folder}/identity").first()[0] != want:
            raise ValueError(f"{folder} was made with another configuration")
    else:
        spark.createDataFrame([(want,)], "value string").coalesce(1).write.text(f"{folder}/identity")
