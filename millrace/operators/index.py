"""A MinHash index that is kept on disk: documents are added in batches, or by a stream, each compared with all before it.

A different set of shingles is one entry, named by the SHA-256 of its sorted values; documents are its members, so copies
cost a row each and are compared once. The index is tables in a folder that executors share, a part of each for a batch:
members (doc_id, split, text_hash, set), sets (set, size, shingles), bands (band, key, size, set), links (a, b, similarity),
confirmed pairs of sets, and roots (set, root), a union-find: a set's root when it came, and the roots that were united
since. A set links to each cluster that it touches once, so links are in proportion to the sets. A batch counts from the
moment that its marker stands in commits; what a crash leaves without one is never read, and is written anew when the batch
comes again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import textexpr as X
from . import dedup
from .storage import children, guard, marked, saved

_TABLES = {
    "members": "doc_id string, split string, text_hash string, set string",
    "sets": "set string, size int, shingles array<bigint>",
    "bands": "band int, key bigint, size int, set string",
    "links": "a string, b string, similarity double",
    "roots": "set string, root string",
}


class MinHashIndex:
    """Ids are strings; of rows with an id that the index has, or that comes twice in a batch, only the first counts."""

    def __init__(self, spark: SparkSession, folder: str, size: int = 3, permutations: int = dedup.PERMUTATIONS, bands: int = dedup.BANDS, seed: int = dedup.SEED, threshold: float = 0.86) -> None:
        if permutations % bands:
            raise ValueError("bands must divide permutations")
        guard(spark, folder, {"size": size, "permutations": permutations, "bands": bands, "seed": seed, "threshold": threshold})
        self.spark, self.folder, self.size, self.permutations, self.bands, self.seed, self.threshold = spark, folder, size, permutations, bands, seed, threshold

    def batches(self) -> list[str]:
        """Names of the batches that are whole."""
        return children(self.spark, f"{self.folder}/commits")

    def _table(self, name: str) -> DataFrame:
        paths = [f"{self.folder}/{name}/batch={b}" for b in self.batches()]
        return self.spark.read.schema(_TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], _TABLES[name])

    def _written(self, name: str, batch: str, part: DataFrame) -> DataFrame:
        """A batch's part of a table, which does not count before the batch does."""
        path = f"{self.folder}/{name}/batch={batch}"
        part.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(_TABLES[name]).parquet(path)

    def documents(self) -> DataFrame:
        """(doc_id, split, text_hash, set) of every document."""
        return self._table("members")

    def links(self) -> DataFrame:
        """(a, b, similarity): confirmed pairs of different sets, by which clusters grew."""
        return self._table("links")

    def _prepared(self, df: DataFrame, split: str | None) -> DataFrame:
        rows = df.select(F.col("doc_id").cast("string").alias("doc_id"), (F.col(split).cast("string") if split else F.lit("train")).alias("split"), X.text().alias("text"))
        rows = rows.groupBy("doc_id").agg(F.min(F.struct("split", "text")).alias("r")).select("doc_id", "r.split", "r.text")
        found = dedup.shingles(rows.withColumn("text_hash", F.sha2("text", 256)), self.size, dedup.folded_words(), keep=("split", "text_hash"))
        found = found.withColumn("shingles", F.array_sort("shingles"))
        return saved(found.withColumn("set", F.sha2(F.array_join("shingles", ","), 256)), "prepared")

    def _sets(self, rows: DataFrame) -> DataFrame:
        """A row for each different set of the rows."""
        return rows.groupBy("set").agg(F.first("shingles").alias("shingles")).select("set", F.size("shingles").alias("size"), "shingles")

    def _banded(self, sets: DataFrame) -> DataFrame:
        sig = sets.select("set", "size", dedup.signature(F.col("shingles"), self.permutations, self.seed).alias("sig"))
        return sig.select(F.explode(dedup.bands_of("sig", self.permutations, self.bands)).alias("x"), "size", "set").select("x.band", "x.key", "size", "set")

    def _near(self, mine: DataFrame, others: DataFrame, sets: DataFrame, other_sets: DataFrame) -> DataFrame:
        """(a, b, similarity): sets of mine and of others that share a band and are similar enough.

        Pairs whose sizes rule that out are not made.
        """
        o = others.select("band", "key", F.col("size").alias("m"), F.unhex("set").alias("b"))  # names take half as much as bytes
        fit = (F.col("a") != F.col("b")) & (F.least("size", "m") >= F.lit(self.threshold) * F.greatest("size", "m") - 1e-9)
        pairs = mine.select("band", "key", "size", F.unhex("set").alias("a")).join(o, ["band", "key"]).where(fit).select("a", "b").distinct()
        pairs = saved(pairs.select(F.lower(F.hex("a")).alias("a"), F.lower(F.hex("b")).alias("b")), "pairs")

        def met(table: DataFrame, c: str, as_: str) -> DataFrame:
            """The sets that are in a pair, cut by a hash of their names; the join that follows compares these."""
            ids = saved(pairs.select(F.xxhash64(c).alias("h")).distinct(), "met")
            return dedup.only(table.select(F.xxhash64("set").alias("h"), F.col("set").alias(c), F.col("shingles").alias(as_)), ids).drop("h")

        both = pairs.join(met(sets, "a", "s"), "a").join(met(other_sets, "b", "t"), "b")
        common = F.size(F.array_intersect("s", "t"))
        return both.select("a", "b", (common / (F.size("s") + F.size("t") - common)).alias("similarity")).where(F.col("similarity") >= self.threshold)

    def candidates(self, df: DataFrame) -> DataFrame:
        """(doc_id, candidate): for rows of df the first documents of the sets of the index that share a band with theirs."""
        rows = self._prepared(df, None)
        mine = self._banded(self._sets(rows)).join(rows.select("doc_id", "set"), "set").select("band", "key", "doc_id")
        return mine.join(self._table("bands"), ["band", "key"]).select("doc_id", "set").distinct().join(self._first(), "set").select("doc_id", F.col("first").alias("candidate"))

    def confirmed(self, df: DataFrame) -> DataFrame:
        """(doc_id, duplicate, similarity): for rows of df the first documents of the similar or equal sets of the index."""
        rows = self._prepared(df, None)
        sets, known = self._sets(rows), self._table("sets")
        near = self._near(self._banded(sets), self._table("bands"), sets, known)
        equal = sets.join(known.select("set"), "set").select(F.col("set").alias("a"), F.col("set").alias("b"), F.lit(1.0).alias("similarity"))
        found = near.unionByName(equal).join(self._first().withColumnRenamed("set", "b"), "b").withColumnRenamed("a", "set")
        return rows.select("doc_id", "set").join(found, "set").select("doc_id", F.col("first").alias("duplicate"), "similarity")

    def _first(self) -> DataFrame:
        return self.documents().groupBy("set").agg(F.min("doc_id").alias("first"))

    def _roots(self) -> DataFrame:
        """(set, root) as of now: roots that were united since a set came lead on to one."""
        rows = self._table("roots")
        first = rows.where("set = root").select("set").distinct()
        united = rows.where("set <> root").select(F.col("set").alias("a"), F.col("root").alias("b"))
        found = dedup.components(united)
        return first.join(found, F.col("set") == F.col("node"), "left").select("set", F.coalesce("root", "set").alias("root"))

    def add(self, df: DataFrame, split: str | None = None, batch: str | None = None) -> int:
        """Add df's documents (doc_id, text); returns how many the index didn't have.

        batch names them: a batch that the index has is not added again, so one that failed can just be repeated.
        """
        batch = batch or uuid.uuid4().hex
        if batch in self.batches():
            return 0
        rows = self._prepared(df, split)
        rows = dedup.only(rows, saved(rows.select("doc_id").join(self.documents().select("doc_id"), "doc_id"), "known"), "left_anti")
        n = rows.count()
        if not n:
            return 0
        # copies and sets that the index has are told by names; the other sets go straight to where they stay
        lead = rows.groupBy("set").agg(F.min("doc_id").alias("doc_id")).join(self._table("sets").select("set"), "set", "left_anti").select("doc_id")
        copies = saved(rows.select("doc_id").join(lead, "doc_id", "left_anti"), "copies")
        sets = self._written("sets", batch, dedup.only(rows, copies, "left_anti").select("set", F.size("shingles").alias("size"), "shingles"))
        banded = self._written("bands", batch, self._banded(sets))
        old = self._near(banded, self._table("bands"), sets, self._table("sets"))
        # of each cluster that a new set touches the most similar set, of equal ones the least
        old = old.join(self._roots().withColumnRenamed("set", "b"), "b").groupBy("a", "root").agg(F.max_by(F.struct("b", "similarity"), F.struct("similarity", "b")).alias("x")).select("a", "root", "x.b", "x.similarity")
        old = saved(old, "old")
        within = saved(self._near(banded, banded, sets, sets).where("b < a"), "within")
        # within a batch a set's link is to the most similar set before it; its cluster is that of all its pairs
        inner = within.groupBy("a").agg(F.max_by(F.struct("b", "similarity"), F.struct("similarity", "b")).alias("x")).select("a", "x.b", "x.similarity")
        edges = old.select("a", F.col("root").alias("b")).unionByName(within.select("a", "b"))
        united = dedup.components(edges).where("node <> root").select(F.col("node").alias("set"), "root")
        new = sets.select("set", F.col("set").alias("root"))
        parts = {"members": rows.select("doc_id", "split", "text_hash", "set"), "links": old.drop("root").unionByName(inner), "roots": new.unionByName(united)}
        for name, part in parts.items():
            self._written(name, batch, part)
        marked(self.spark, f"{self.folder}/commits/{batch}")
        return n

    def add_stream(self, stream: DataFrame, checkpoint: str, name: str = "stream", split: str | None = None) -> int:
        """Add what has arrived of a stream of documents, and return how many batches that took.

        A batch is named by its number, which a restart repeats: if it was whole it is skipped, if it wasn't it is done anew.
        """
        ran = []

        def each(rows: DataFrame, number: int) -> None:
            self.add(rows, split, f"{name}-{number}")
            ran.append(number)

        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return len(ran)

    def add_files(self, source: str, schema: T.StructType | str, checkpoint: str, fmt: str = "json", per_batch: int = 1) -> int:
        """add_stream for the files of a folder, so many in a batch."""
        files = self.spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_batch).load(source)
        return self.add_stream(files, checkpoint)

    def clusters(self) -> DataFrame:
        """(doc_id, representative) of every document: the least id of those that links lead to, in whatever order they were added."""
        rows = saved(self.documents().select("doc_id", "set").join(self._roots(), "set"), "clusters")
        least = rows.groupBy("root").agg(F.min("doc_id").alias("representative"))
        return rows.join(least, "root").select("doc_id", "representative")
