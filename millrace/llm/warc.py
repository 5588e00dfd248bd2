"""Content-addressed web archive.

An archive is two tables in a folder that executors share: payloads (digest, payload), each different payload once, and
headers (digest, header), the exact header block of each record. A record is put together again by a join of the two on
the digest. The digest is SHA-256; a payload is only taken as equal to another if their SHA-1, 64-bit hash and length
agree too, and both digests are computed anew from what was read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# fixed values: line breaks of Unicode
BREAKS = "\n\v\f\r\x1c\x1d\x1e\x85\u2028\u2029"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: five of them are four symbols."""
    parts = []
    for k in range(8):
        n = F.conv(F.substring(hex_, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _field(name: str, value: Column) -> Column:
    """A header line; none for a null value. Line breaks of any kind in a value are percent-encoded."""
    safe = value
    for c in BREAKS:
        safe = F.replace(safe, F.lit(c), F.lit("".join(f"%{b:02X}" for b in c.encode())))
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n"))).otherwise(F.lit(""))


def _urn(page: Column, copy: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.when(copy > 1, F.concat(F.lit("."), copy.cast("string"))).otherwise(F.lit("")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 0) -> None:
    """Write the archive of pages to path/payloads and path/headers.

    Of records with equal payloads of least bytes or more that with the largest id is the response (of repeated ids the
    last by URL) and the others are revisits; shorter ones are all responses. A null body is an empty payload, a null
    URL leaves its line out, a null id comes before all others. An empty table makes an empty archive.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(body_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    one = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.min(F.xxhash64("payload", F.octet_length("payload"))).alias("a"), F.max(F.xxhash64("payload", F.octet_length("payload"))).alias("b"))
    clash = F.raise_error(F.concat(F.lit("different payloads have digest "), F.col("digest")))
    one.select("digest", F.when(F.col("a") == F.col("b"), F.encode("payload", "UTF-8")).otherwise(clash.cast("binary")).alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")

    index = rows.select("page", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"), base32(F.sha1("payload")).alias("sha1"))
    index = index.withColumn("copy", F.row_number().over(Window.partitionBy("page", "digest").orderBy("url")))
    top = index.groupBy("digest").agg(F.max(F.struct("page", "copy")).alias("top"))
    said = index.join(top, "digest")
    revisit = (F.col("bytes") >= least) & ~(F.col("page").eqNullSafe(F.col("top.page")) & (F.col("copy") == F.col("top.copy")))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", _urn(F.col("page"), F.col("copy"))),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _field("WARC-Refers-To", F.when(revisit, _urn(F.col("top.page"), F.col("top.copy")))),
        _field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _field("Content-Type", F.when(~revisit, F.lit("text/html; charset=utf-8"))),
        _field("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
    )
    said.select("digest", F.encode(header, "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(digest, record): the bytes of each record as they stand in a WARC file, joined from headers and payloads.

    Revisits have no block of their own. A payload that doesn't match its digest is an error.
    """
    headers = spark.read.schema("digest string, header binary").parquet(f"{path}/headers")
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    bad = F.raise_error(F.concat(F.lit("payload does not match digest "), F.col("digest")))
    stored = stored.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(bad.cast("binary")))
    whole = F.lit(b"\r\n\r\n")
    is_revisit = F.decode("header", "UTF-8").rlike("(?md)^WARC-Type: revisit\\r\\n")
    full = headers.where(~is_revisit).join(stored, "digest").select("digest", F.concat("header", "payload", whole).alias("record"))
    return full.unionByName(headers.where(is_revisit).select("digest", F.concat("header", whole).alias("record")))


def parse_records(records: DataFrame) -> DataFrame:
    """(digest, record_id, url, record_type, payload_digest, refers_to_id, payload): fields and block of each record.

    The block is cut out by Content-Length and must end the record but for two line breaks.
    """
    split = records.withColumn("at", F.instr(F.decode(F.col("record"), "ISO-8859-1"), "\r\n\r\n"))
    head = F.decode(F.substring("record", F.lit(1), F.col("at") + 1), "UTF-8")
    field = lambda name: F.regexp_extract("head", f"(?md)^{name}: ([^\\r]*)\\r\\n", 1)
    cut = split.withColumn("head", head).withColumn("length", field("Content-Length").cast("int"))
    wrong = F.raise_error(F.lit("record length does not match its header"))
    return cut.select(
        "digest",
        field("WARC-Record-ID").alias("record_id"),
        F.nullif(field("WARC-Target-URI"), F.lit("")).alias("url"),
        field("WARC-Type").alias("record_type"),
        F.substring(field("WARC-Payload-Digest"), 6, 32).alias("payload_digest"),
        F.nullif(field("WARC-Refers-To"), F.lit("")).alias("refers_to_id"),
        F.when(F.octet_length("record") == F.col("at") + 3 + F.col("length") + 4, F.substring("record", F.col("at") + 4, F.col("length"))).otherwise(wrong.cast("binary")).alias("payload"),
    )


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Write the archive of pages to the shared folder, read it back, and describe each record by what was read.

    payload_bytes and payload_digest come from the stored payload, for a revisit from that of its response. Nulls, ids that
    come again and empty tables are as in write_archive(): a row for each row of pages, none for none.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path, **how)
    read = parse_records(read_records(spark, path))
    seen = base32(F.sha1("payload"))
    wrong = F.raise_error(F.concat(F.lit("payload digest differs in record "), F.col("record_id")))
    read = read.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn(
        "payload_digest", F.when((F.col("record_type") == "revisit") | (seen == F.col("payload_digest")), F.col("payload_digest")).otherwise(wrong)
    ).drop("payload")
    page = lambda c: F.regexp_extract(c, "<urn:page:(-?\\d+)", 1).try_cast("long")
    full = read.where("record_type = 'response'").select("record_id", "digest", "payload_digest", "bytes")
    revisits = read.where("record_type = 'revisit'").select("record_id", "refers_to_id", "payload_digest", "digest")
    resolved = revisits.join(full.select(F.col("record_id").alias("refers_to_id"), "bytes", F.col("digest")), ["refers_to_id", "digest"])
    cols = lambda kind, to: [page("record_id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("payload_digest"), F.lit(kind).alias("record_type"), to.alias("refers_to")]
    return full.select(*cols("response", F.lit(None).cast("long"))).unionByName(resolved.select(*cols("revisit", page("refers_to_id"))))


def query(spark, sf_dir):
    """op4: archive all pages, and what reading the archive gives for each."""
    from .common import table

    return round_trip(table(spark, sf_dir, "pages"))


SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS body FROM pages
), t AS (SELECT body, max(page_id) AS top FROM p GROUP BY body)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{BASE32}', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM p JOIN t USING (body)
"""
