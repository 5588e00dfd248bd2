"""Methods over data sets: each data set is loaded, or replaced, and every method's selection is summed up; one that fails
is a row of the result like others, and doesn't stop the rest."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textexpr as X

# fixed values: what a mode runs of the data sets there are
MODES = {"quick": lambda own, optional: own[:2], "paper-prototype": lambda own, optional: own + optional, "full": lambda own, optional: own + optional}

#: Makes a table (doc_id, text) when it is called.
Load = Callable[[], DataFrame]
#: The documents of a table that a method keeps.
Method = Callable[[DataFrame], DataFrame]

SCHEMA = "dataset string, status string, used_fallback boolean, note string, method string, documents long, characters long, retention double"


class Dataset(NamedTuple):
    """load gives the data, fallback what stands in where that fails; optional ones are recorded, not run, by their fallback."""

    load: Load
    fallback: Load | None = None
    optional: bool = False


def keys_for_mode(datasets: dict[str, Dataset], mode: str) -> list[str]:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    own, optional = ([k for k, d in datasets.items() if d.optional is want] for want in (False, True))
    return MODES[mode](own, optional)


def run(spark: SparkSession, datasets: dict[str, Dataset], methods: dict[str, Method], mode: str = "quick", dry_run: bool = False) -> DataFrame:
    """(dataset, status, used_fallback, note, method, documents, characters, retention): a row for each data set and method.

    status is ok, or of data sets that no method ran on dry_run, fallback_recorded or error, with a row each and the reason in
    note. A dry run loads the data sets and reads none. retention is of characters. A data set is read once for each method.
    """
    out = []

    def row(key: str, status: str, fallback: bool, note: str | None = None) -> DataFrame:
        return spark.createDataFrame([(key, status, fallback, note, None, None, None, None)], SCHEMA)

    for key in keys_for_mode(datasets, mode):
        one, fallback, note = datasets[key], False, None
        try:
            try:
                df = one.load()
            except Exception as e:  # whatever keeps it from being there
                if one.fallback is None:
                    raise
                fallback, note, df = True, str(e).splitlines()[0], one.fallback()
            if dry_run:
                out.append(row(key, "dry_run", fallback, note))
            elif one.optional and fallback:
                out.append(row(key, "fallback_recorded", True, note))
            else:
                size = lambda d: d.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.char_length(X.text())), F.lit(0)).cast("long").alias("characters"))
                kept = [size(method(df)).withColumn("method", F.lit(name)) for name, method in methods.items()]
                both = reduce(DataFrame.unionByName, kept).join(size(df).select(F.col("characters").alias("all")))  # one row
                out.append(both.select(F.lit(key).alias("dataset"), F.lit("ok").alias("status"), F.lit(fallback).alias("used_fallback"), F.lit(note).cast("string").alias("note"), "method", "documents", "characters", (F.col("characters") / F.greatest(F.lit(1), "all")).alias("retention")))
        except Exception as e:
            out.append(row(key, "error", fallback, str(e).splitlines()[0]))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], SCHEMA)
