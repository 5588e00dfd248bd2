"""Exact dedup by deterministic block naming, in DataFrame operations only.

Each normalised text is cut into blocks of a fixed number of code points. Distinct blocks are sorted, and their places
in that order are their integer names. Then adjacent names are paired, distinct pairs sorted and named in turn, until
each document has one name: with the number of its blocks that is an identity which two documents share if and only if
their texts are equal.

Block text is shuffled once, after a partial aggregation that already merges the copies a task holds. What follows moves
numbers only: the sort key of a block is (its 64-bit hash, its text), of which the text matters only where different
blocks have equal hashes; those few are looked up and sorted by text, so that no two blocks ever share a name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, own_prefix, saved

BLOCK = 2048
NO_ID = -(2**63)


def _blocks(df: DataFrame, id_col: str, text_col: str, block: int, hashed: Callable[[Column], Column], normalise: Callable[[Column], Column]) -> DataFrame:
    """(kid, row, n, sha, pos, block, h): a row for each block; an empty text has one empty block."""
    norm = df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("kid"),
        normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"),
    )
    cut = norm.select("kid", "norm", F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)).alias("cut"))
    return cut.select(
        "kid", F.xxhash64("norm").alias("row"), F.greatest(F.size("cut"), F.lit(1)).alias("n"), "norm", F.posexplode_outer("cut").alias("pos", "block")
    ).select("kid", "row", "n", "norm", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("block", F.lit("")).alias("block")).withColumn("h", hashed(F.col("block")))


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Integer names of the distinct keys, in their sorted order: written, so that a lost executor can't change them."""
    return saved(distinct.orderBy(*keys).withColumn("name", F.monotonically_increasing_id()), "names")


def identities(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = BLOCK,
    hashed: Callable[[Column], Column] = F.xxhash64,
    normalise: Callable[[Column], Column] = lower_ascii,
) -> DataFrame:
    """A row for each different (id, text): kid, copies (rows like it), sha (of the normalised text), n and name.

    (n, name) is the identity. Nulls: a null text is empty, a null id comes before all ids. Repeated rows are counted in
    copies. Other columns don't matter.
    """
    blocks = _blocks(df, id_col, text_col, block, hashed, normalise)
    spread = saved(blocks.groupBy("block").agg(F.first("h").alias("h")).select("h"), "blocks")
    clash = spread.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    sha = F.when(F.col("pos") == 0, F.sha2("norm", 256)).alias("sha")
    if clash.isEmpty():
        occurs = blocks.select("kid", "row", "n", "pos", "h", F.lit(0).alias("tie"), sha)
    else:
        clash = saved(clash, "clash")
        ties = blocks.join(clash, "h", "left_semi").select("h", "block").distinct()
        ties = saved(ties.withColumn("tie", F.row_number().over(Window.partitionBy("h").orderBy("block"))), "ties")
        occurs = blocks.join(ties, ["h", "block"], "left").select("kid", "row", "n", "pos", "h", F.coalesce("tie", F.lit(0)).alias("tie"), sha)
    occurs = saved(occurs, "occurs")
    copies = occurs.where("pos = 0").groupBy("kid", "row", "sha").agg(F.count("*").alias("copies"))
    names = _named(occurs.select("h", "tie").distinct(), ["h", "tie"])
    level = occurs.drop("sha").join(names, ["h", "tie"]).select("kid", "row", "n", "pos", "name")
    longest = occurs.agg(F.max("n")).head()[0] or 1
    done = level.where("n = 1").select("kid", "row", "n", "name")
    left = 1
    while left < longest:
        left *= 2
        half = F.expr("pos div 2").cast("int")
        pairs = saved(
            level.where(F.col("n") > left // 2)
            .groupBy("kid", "row", "n", half.alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")),
            "pairs",
        )
        level = pairs.join(_named(pairs.select("a", "b").distinct(), ["a", "b"]), ["a", "b"]).select("kid", "row", "n", "pos", "name")
        done = done.unionByName(level.where((F.col("n") > left // 2) & (F.col("n") <= left)).select("kid", "row", "n", "name"))
    return copies.join(done.distinct(), ["kid", "row"])


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """A row for each row of df: id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts that with the largest id stays; of repeated rows (equal ids too) one stays. A null id is
    less than any other, and is the keep_id of a group only if that has no other. An empty table gives no rows.
    """
    docs = saved(identities(df, id_col, text_col, **how), "identity")
    # written, so that both sides of the join are exchanged for it and a large group can be split
    groups = saved(docs.groupBy("n", "name").agg(F.max("kid").alias("top"), F.sum("copies").alias("group_size")), "groups")
    rows = docs.join(groups, ["n", "name"]).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.select(
        shown("kid").alias(id_col), shown("top").alias("keep_id"), F.col("group_size"), ((F.col("kid") == F.col("top")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256")
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """df without the rows that exact_dedup drops, its own columns only; one of repeated rows stays, with its values.

    The join is on (id, text hash). An id may come with several texts; each is judged on its own. Other columns may have
    any names.
    """
    docs = identities(df, id_col, text_col, **how)
    docs = saved(docs, "identity")
    groups = saved(docs.groupBy("n", "name").agg(F.max("kid").alias("top")), "groups")
    own = own_prefix(df)
    kid, row, copies, n = (own + c for c in ("kid", "row", "copies", "n"))
    stay = docs.join(groups, ["n", "name"]).where("kid = top").select(F.col("kid").alias(kid), F.col("row").alias(row), F.col("copies").alias(copies))
    normalise = how.get("normalise", lower_ascii)
    keyed = df.withColumns({kid: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), row: F.xxhash64(normalise(F.coalesce(F.col(text_col), F.lit(""))))})
    found = keyed.join(stay, [kid, row])
    once = found.where(F.col(copies) > 1).withColumn(n, F.row_number().over(Window.partitionBy(kid, row).orderBy(text_col))).where(F.col(n) == 1).drop(n)
    return found.where(F.col(copies) == 1).unionByName(once).select(*df.columns)


def query(spark, sf_dir):
    """op8: every document with the row of its group that stays."""
    from .common import table

    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size,
  coalesce(d.doc_id = g.keep_id, true) AND row_number() OVER (PARTITION BY d.norm, d.doc_id) = 1 AS kept,
  sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
