"""A two-pass sampler: an index of all documents is kept, a budget is filled from it, and only what was chosen is read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textexpr as X
from ..operators import select
from ..operators.storage import exists, guard, marked, saved


class TwoPassSampler:
    """Documents in the order of SHA-256 ranks of seed and id, taken as long as a token budget has room for them.

    The first pass writes (doc_id, rank, tokens, path) of a Parquet corpus, under a guard: the folder belongs to one corpus
    (paths, rows, and the sum of hashes of ids and texts), seed and token counter, and refuses others. The second reads only
    the files that have chosen documents, and only these rows. Documents without id or tokens don't count; of repeated ids
    one stays.
    """

    def __init__(self, spark: SparkSession, folder: str, corpus: str, seed: int = 42, tokenizer: str = "words", tokens: Column | None = None) -> None:
        self.spark, self.folder, self.corpus, self.seed, self.tokenizer = spark, folder, corpus, seed, tokenizer
        self.tokens = F.size(X.words(X.text())) if tokens is None else tokens

    def _read(self, *paths: str) -> DataFrame:
        # read by file: a corpus in folders for the values of a column has it in all of them
        return self.spark.read.parquet(*(paths or (self.corpus,)))

    def identity(self) -> dict:
        """What the index belongs to, in one pass over the corpus."""
        rows = self._read().select(F.col("doc_id").cast("string").alias("i"), F.sha2(X.text(), 256).alias("t"))
        n, total = rows.agg(F.count("*"), F.sum(F.xxhash64("i", "t").cast("decimal(38,0)"))).head()
        return {"corpus": self.corpus, "rows": n, "hash": str(total), "seed": self.seed, "tokenizer": self.tokenizer}

    def build(self) -> dict[str, int]:
        """Make the index, or check that the one there is of this corpus; its documents and tokens, and whether it was there."""
        guard(self.spark, self.folder, self.identity())
        reused = exists(self.spark, f"{self.folder}/done")
        if not reused:
            key = F.col("doc_id").cast("string")
            rows = self._read().select(key.alias("doc_id"), F.sha2(F.concat(F.lit(f"{self.seed}:"), key), 256).alias("rank"), self.tokens.cast("long").alias("tokens"), F.col("_metadata.file_path").alias("path"))
            rows = rows.where("doc_id <> '' AND tokens > 0").groupBy("doc_id", "rank").agg(F.min(F.struct("path", "tokens")).alias("x")).select("doc_id", "rank", "x.tokens", "x.path")
            rows.write.mode("overwrite").parquet(f"{self.folder}/index")
            marked(self.spark, f"{self.folder}/done")
        n, total = self.index().agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).head()
        return {"documents": n, "tokens": total, "reused_index": int(reused)}

    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/index")

    def chosen(self, budget: int) -> DataFrame:
        """(doc_id, rank, tokens, path) of what the budget has room for."""
        if budget <= 0:
            raise ValueError("the budget must be positive")
        ids = select.first_fit(self.index(), "tokens", budget, "rank", "doc_id")
        return saved(self.index().join(ids, "doc_id", "left_semi"), "chosen")

    def records(self, chosen: DataFrame) -> DataFrame:
        """The corpus's rows of the chosen documents, from the files that have them; of repeated ids those in that file."""
        paths = [r["path"] for r in chosen.select("path").distinct().collect()]  # names of files, as any read has them
        if not paths:
            return self._read().limit(0)
        wanted = chosen.select(F.col("doc_id").alias("__id"), F.col("path").alias("__path"))
        rows = self._read(*paths).withColumn("__file", F.col("_metadata.file_path"))
        return rows.join(wanted, (F.col("doc_id").cast("string") == F.col("__id")) & (F.col("__file") == F.col("__path")), "left_semi").drop("__file")


def buffered_shuffle(df: DataFrame, buffer: int, *order: str, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """df in an order in which no row moves by buffer places or more: what a shuffle buffer on a stream gives, for any size.

    A row's key is its place plus a hashed share of the buffer; sorting by that needs no buffer at all.
    """
    if buffer < 1:
        raise ValueError("the buffer has one row at least")
    share = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(2**32)) / F.lit(float(2**32))).alias("share")
    ranked = select.global_rank(df.select("*", share), *[F.col(c) for c in order], name="place")
    return ranked.withColumn("place", F.col("place") + F.col("share") * F.lit(float(buffer))).drop("share").orderBy("place", id_col)
