"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output over its share of the input. Each document's count is
the inverse of the Poisson distribution with that mean at a uniform number hashed from (seed, id): the same for any
partitioning and any rerun. The document is exploded by its count, and the copies are shuffled globally: sorted by a
second hash, by which they are range-partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_prefix, saved

SEED = "mix-1"
#: Of the default targets: shares are raised to this power, then normalised.
TEMPERATURE = 0.5
#: Poisson terms summed from 0 at most, for rates up to a quarter of that, where the rest is under 1e-80; for higher rates
#: as many terms around the mode as leave a rest of 1e-30.
TERMS = 256


def uniform(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) of 52 bits from SHA-256."""
    hashed = F.sha2(F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols]), 256)
    return F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def poisson_cdf(rate: Column) -> Column:
    """The cumulative probabilities of 0, 1, ... as an array, up to where they round to 1."""
    terms = F.sequence(F.lit(1), F.least(F.lit(TERMS), F.ceil(rate * 4 + 40).cast("int")))
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    return F.aggregate(terms, start, add, lambda acc: acc["all"])


def poisson_window(rate: Column) -> Column:
    """(first, cdf): the cumulative probabilities of first, first + 1, ... of a high rate, twelve deviations either way.

    Terms are relative to that of first, which would be 0 as such, and divided by their sum.
    """
    reach = F.sqrt(rate) * 12 + 40
    first = F.greatest(F.lit(0), F.floor(rate - reach)).cast("long")
    start = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("c"), F.array(F.lit(1.0)).alias("all"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    terms = F.sequence(first + 1, F.ceil(rate + reach).cast("long"))
    return F.struct(first.alias("first"), F.aggregate(terms, start, add, lambda acc: F.transform(acc["all"], lambda c: c / acc["c"])).alias("cdf"))


def rates(df: DataFrame, source_col: str = "source", text_col: str = "text", targets: dict[str, float] | None = None, total: float = 1.0, most: float | None = None) -> DataFrame:
    """(source, rate, first, cdf), a row for each source. total: characters of the output, as a multiple of the input's.

    Without targets a source's weight is its share of the characters to the power of TEMPERATURE. A source that targets
    lacks gets rate 0. A rate over most is an error; without it any rate is served.
    """
    chars = df.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.char_length(F.coalesce(F.col(text_col), F.lit("")))).cast("long").alias("chars"))
    if targets is None:
        weighed = chars.withColumn("weight", F.pow(F.col("chars").cast("double"), F.lit(TEMPERATURE)))
    else:
        given = df.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "name string, weight double")
        weighed = chars.join(F.broadcast(given), chars["source"].eqNullSafe(given["name"]), "left").select("source", "chars", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    whole = weighed.agg(F.sum("chars").alias("chars"), F.sum(F.when(F.col("chars") > 0, F.col("weight"))).alias("weight")).head()
    if not whole["chars"] or not whole["weight"]:
        rate = F.lit(0.0)
    else:
        rate = F.when(F.col("chars") > 0, F.col("weight") / F.lit(whole["weight"]) * F.lit(float(whole["chars"])) * F.lit(float(total)) / F.col("chars")).otherwise(F.lit(0.0))
    out = weighed.select("source", "chars", rate.alias("rate"))
    if most is not None:
        too_much = F.raise_error(F.concat(F.lit("repetition rate too high for source "), F.coalesce("source", F.lit("null"))))
        out = out.withColumn("rate", F.when(F.col("rate") > most, too_much.cast("double")).otherwise(F.col("rate")))
    low = F.struct(F.lit(0).cast("long").alias("first"), poisson_cdf(F.col("rate")).alias("cdf"))
    return out.withColumn("counts", F.when(F.col("rate") > TERMS / 4, poisson_window(F.col("rate"))).otherwise(low)).select("source", "chars", "rate", "counts.first", "counts.cdf")


def _replicated(df: DataFrame, id_col: str, source_col: str, text_col: str, targets: dict[str, float] | None, total: float, seed: str, most: float | None) -> tuple[DataFrame, str]:
    """df with copies, copy and key, a row for each copy; these names have the prefix that comes with it."""
    own = own_prefix(df)
    per = rates(df, source_col, text_col, targets, total, most)
    # written: Spark then knows how small it is, and where it isn't can split a large source's rows in the join
    per = saved(per.select(*[F.col(c).alias(own + c) for c in ("source", "rate", "first", "cdf")]), "rates")
    c = {name: F.col(own + name) for name in ("source", "first", "u", "copies", "copy")}
    counted = df.join(per, F.col(source_col).eqNullSafe(c["source"]), "left").withColumn(own + "u", uniform(seed, F.col(id_col)))
    counted = counted.withColumn(own + "copies", c["first"] + F.size(F.filter(own + "cdf", lambda x: x <= c["u"])))
    each = counted.where(c["copies"] > 0).withColumn(own + "copy", F.explode(F.sequence(F.lit(0).cast("long"), c["copies"] - 1)))
    key = F.substring(F.sha2(F.concat_ws(":", F.lit(seed + "/order"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), c["copy"]), 256), 1, 16)
    return each.select(*df.columns, own + "copies", own + "copy", key.alias(own + "key")), own


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    targets: dict[str, float] | None = None,
    total: float = 1.0,
    seed: str = SEED,
    most: float | None = None,
) -> DataFrame:
    """df's rows, each as often as its Poisson count says, with copy (from 0), copies and shuffle_key, in global order.

    A null source is a source; a null id hashes as "null". Repeated rows get the same count each. Empty texts are
    replicated like others; a table without any characters gives no rows. Columns of df with one of the three names give
    way to them; mixed() keeps them.
    """
    each, own = _replicated(df, id_col, source_col, text_col, targets, total, seed, most)
    new = {"copies": own + "copies", "copy": own + "copy", "shuffle_key": own + "key"}
    each = each.select(*[c for c in df.columns if c.lower() not in new], *[F.col(c).alias(name) for name, c in new.items()])
    return each.orderBy("shuffle_key")


def mixed(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    targets: dict[str, float] | None = None,
    total: float = 1.0,
    seed: str = SEED,
    most: float | None = None,
) -> DataFrame:
    """The rows of mix() with df's own columns and values only, whatever their names."""
    each, own = _replicated(df, id_col, source_col, text_col, targets, total, seed, most)
    return each.orderBy(own + "key").select(*df.columns)


def query(spark, sf_dir):
    """op7: all documents, mixed to tempered source weights at the input's size."""
    from .common import table

    return mix(table(spark, sf_dir, "documents"))


SQL = f"""
WITH s AS (
  SELECT source, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY source
), w AS (SELECT source, chars, pow(chars::DOUBLE, {TEMPERATURE}) AS weight FROM s),
a AS (SELECT sum(chars)::DOUBLE AS all_chars, sum(weight) FILTER (chars > 0) AS all_weight FROM w),
r AS (SELECT source, CASE WHEN chars > 0 THEN weight / all_weight * all_chars / chars ELSE 0.0 END AS rate FROM w, a),
p AS (
  SELECT source, k, sum(CASE WHEN rate = 0 THEN (k = 0)::INT ELSE exp(-rate + k * ln(rate) - lgamma(k + 1)) END) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM r, (SELECT unnest(range(0, 120)) AS k)
), u AS (
  SELECT *, ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / {2**52}::DOUBLE AS u FROM documents
), c AS (
  SELECT u.*, (SELECT count(*) FROM p WHERE p.source IS NOT DISTINCT FROM u.source AND p.cdf <= u.u) AS copies FROM u
)
SELECT doc_id, text, lang, source, n_chars, copies, copy,
  substr(sha256('{SEED}/order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy), 1, 16) AS shuffle_key
FROM (SELECT *, unnest(range(0, copies))::BIGINT AS copy FROM c WHERE copies > 0)
"""
