"""Resumable processing of growing folders, on Structured Streaming: each file is processed once, whatever fails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import textexpr as X
from ..operators.storage import exists, guard, replace


def run(spark: SparkSession, source: str, schema: T.StructType, out: str, transform: Callable[[DataFrame, int], DataFrame], config: dict, fmt: str = "json") -> int:
    """Process the files of source that an earlier run hasn't, append the rows to out/data, and return how many batches ran.

    transform takes a batch and its number, and works on it as on a table; rows that it leaves out are dropped. A batch is
    written aside and renamed, so out/data has it whole or not at all; one that failed half-way is done again whole. What
    went in and came out is recorded in out/manifest, for verify().
    """
    guard(spark, out, config)
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    ran = []

    def each(batch: DataFrame, number: int) -> None:
        transform(batch, number).write.mode("overwrite").parquet(f"{out}/staged/{number}")
        before, after = row_hash(batch), row_hash(spark.read.parquet(f"{out}/staged/{number}"))
        record = spark.createDataFrame([(*before, *after)], _MANIFEST)
        record.coalesce(1).write.mode("overwrite").json(f"{out}/manifest/batch={number}")
        replace(spark, f"{out}/staged/{number}", f"{out}/data/batch={number}")
        ran.append(number)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return len(ran)


_MANIFEST = "rows_in long, hash_in string, rows_out long, hash_out string"


def row_hash(df: DataFrame) -> tuple[int, str]:
    """(rows, hash) of a table, whatever the order of its rows: the sum of the rows' hashes, each of all columns as JSON."""
    n, total = df.select(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.sum("h")).head()
    return n, str(total or 0)


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """(batch, rows_in, hash_in, rows_out, hash_out) of every batch of a run."""
    return spark.read.schema(_MANIFEST + ", batch long").json(f"{out}/manifest")


def verify(spark: SparkSession, out: str) -> list[int]:
    """Batches whose rows aren't those that were written, or aren't there; one pass over all of them."""
    known = {r["batch"]: (r["rows_out"], r["hash_out"]) for r in manifest(spark, out).collect()}  # a row for each batch
    data = spark.read.parquet(f"{out}/data") if exists(spark, f"{out}/data") else None
    found = {}
    if data is not None:
        cols = sorted(c for c in data.columns if c != "batch")
        h = F.xxhash64(F.to_json(F.struct(*cols))).cast("decimal(38,0)")
        found = {r["batch"]: (r["n"], str(r["h"] or 0)) for r in data.groupBy("batch").agg(F.count("*").alias("n"), F.sum(h).alias("h")).collect()}
    return sorted(b for b in known.keys() | found.keys() if known.get(b) != found.get(b, (0, "0")))


def dedup(spark: SparkSession, source: str, schema: T.StructType, out: str, fmt: str = "json") -> int:
    """As run(), keeping rows whose normalised text neither an earlier batch nor a lesser doc_id of the batch has.

    A batch that runs again looks at the batches before it only, not at what it wrote itself.
    """

    def fresh(batch: DataFrame, number: int) -> DataFrame:
        rows = batch.withColumn("hash", F.sha2(X.normalise(X.text()), 256))
        first = rows.groupBy("hash").agg(F.min_by(F.struct(*batch.columns), F.col("doc_id")).alias("r"))
        if exists(spark, f"{out}/data"):
            seen = spark.read.parquet(f"{out}/data").where(F.col("batch") < number).select("hash")
            first = first.join(seen, "hash", "left_anti")
        return first.select("r.*", "hash")

    return run(spark, source, schema, out, fresh, {"kind": "dedup"}, fmt)


def event_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and mean values by event type and window; works on a stream, where it drops what is later than late."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
