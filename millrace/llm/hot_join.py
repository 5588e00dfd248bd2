"""Hot-key equi-join by cost-based bin packing.

The pair work of every key is estimated from its rows on both sides. A key whose work is more than a bin's share is cut
into blocks; all other keys are dealt into buckets. Blocks and buckets, the cells, go to bins by longest processing time
first, and a partitioner that knows only that plan sends rows there. In a bin the rows of both sides meet cell by cell,
in the order of Spark's external sort, and are joined by block-nested loops.

`hot_join` gives the joined rows. Its cells are grids: block i of the left side and block j of the right side meet in one
cell, so a row is copied once for each block of the other side, and nested loops put what exceeds a buffer aside on disk.
`partner_folds` gives each row the number and sum over its partners instead of the pairs. There a row goes to one cell,
where it meets the blocks of the other side as sums (strips), which are made before the shuffle; so what is shuffled is in
proportion to the rows, however hot a key is.

The plan has at most a few cells for each bin: its size depends on the number of shuffle partitions, not on the rows.
"""

from __future__ import annotations

import heapq
import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, saved, table

#: Cells of an average bin. A key is hot if its work is more than a cell's share of all work.
SPREAD = 4
#: Sums that a hot key's rows of one side are folded to before they meet the other side.
STRIPS = 8
#: Bytes of one side of a cell that a nested loop holds; what is over goes to disk. Pairs that a batch of the result has.
BUFFER, PAIRS = 64 << 20, 1 << 16


def assign(work: dict[int, float], bins: int) -> dict[int, int]:
    """A bin for each item: longest processing time first, each to the bin with the least work so far."""
    loads = [(0.0, b) for b in range(bins)]
    out = {}
    for item, w in sorted(work.items(), key=lambda kv: (-kv[1], kv[0])):
        load, b = loads[0]
        heapq.heapreplace(loads, (load + w, b))
        out[item] = b
    return out


class Plan:
    """Hot keys with their cells, buckets of all other keys, and the bin of every cell.

    hot: rows (key, blocks of the left side, of the right side, first cell). Cells from `buckets` on belong to hot keys.
    """

    def __init__(self, spark: SparkSession, keys: DataFrame, work: Column, cut, bins: int) -> None:
        """keys: (key, l, r), the rows of each key; cut(l, r, share): its blocks and the work of each of its cells."""
        keys = saved(keys.withColumn("work", work), "key-work")
        self.buckets = bins * SPREAD
        total = keys.agg(F.sum("work")).head()[0] or 0.0
        share = max(1.0, total / self.buckets)
        # at most self.buckets keys have more than a share each
        hot = keys.where(F.col("work") > share).orderBy("key").collect()
        loads = keys.where(F.col("work") <= share).groupBy(bucket(F.col("key"), self.buckets).alias("cell")).agg(F.sum("work").alias("work"))
        items = {r["cell"]: r["work"] for r in loads.collect()}
        self.hot, cell = [], self.buckets
        for r in hot:
            a, b, cells = cut(r["l"], r["r"], share)
            self.hot.append((r["key"], a, b, cell, r["l"] > 0 and r["r"] > 0))
            items |= {cell + k: w for k, w in enumerate(cells)}
            cell += len(cells)
        self.work, self.bins = items, assign(items, bins)
        self.hot_table = F.broadcast(spark.createDataFrame(self.hot, f"hot {dict(keys.dtypes)['key']}, a int, b int, first int, met boolean"))
        self.bin_table = F.broadcast(spark.createDataFrame(sorted(self.bins.items()), "cell int, bin int"))
        self.n = bins

    def dealt(self, rows: DataFrame, *order: str) -> DataFrame:
        """rows in the partition of their cell's bin, sorted by cell, key and order."""
        return rows.join(self.bin_table, "cell").repartitionById(self.n, F.col("bin")).drop("bin").sortWithinPartitions("cell", "key", *order)


def bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def spread(column: Column, n: Column) -> Column:
    """A block, from 0, that a hash of the column picks."""
    return F.pmod(F.xxhash64(column, F.lit("block")), n.cast("long")).cast("int")


def partner_folds(rows: DataFrame) -> DataFrame:
    """rows with partners and partner_sum: how many rows of the other side have its key, and the sum of their values.

    rows: side (0 or 1), id, key and value (longs), copies (long; how often the row stands for itself). A null key has no
    partners. A null id is an id like others. Sums are of 64 bits. An empty table gives no rows.
    """
    spark = rows.sparkSession
    bins = partitions(spark)
    here = rows.where("key IS NOT NULL")
    # a row meets the strips of the other side, a strip being as little work as a row
    keys = here.groupBy("key").agg(F.count_if(F.col("side") == 0).alias("l"), F.count_if(F.col("side") == 1).alias("r"))
    work = F.col("l") * (1 + F.least("r", F.lit(STRIPS))).cast("double") + F.col("r") * (1 + F.least("l", F.lit(STRIPS))).cast("double")

    def cut(left: int, right: int, share: float) -> tuple[int, int, list[float]]:
        each = [left * (1.0 + min(right, STRIPS)), right * (1.0 + min(left, STRIPS))]
        a, b = (math.ceil(w / share) for w in each)
        return a, b, [w / n for w, n in zip(each, (a, b)) for _ in range(n)]  # a side without rows has no blocks

    plan = Plan(spark, keys, work, cut, bins)
    found = here.join(plan.hot_table, F.col("key") == F.col("hot"), "left")
    count = F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b"))
    begin = F.when(F.col("side") == 0, F.col("first")).otherwise(F.col("first") + F.col("a"))
    cell = F.when(F.col("hot").isNull(), bucket(F.col("key"), plan.buckets)).otherwise(begin + spread(F.col("id"), count))
    own = found.select(cell.alias("cell"), "key", F.lit(1).alias("own"), F.col("hot").isNull().alias("adds"), "side", "id", "copies", (F.col("copies") * F.col("value")).alias("total"))
    # strips of a hot key go to all cells of the other side; there are STRIPS of a side at most
    other = F.when(F.col("side") == 1, F.sequence(F.col("first"), F.col("first") + F.col("a") - 1)).otherwise(F.sequence(F.col("first") + F.col("a"), F.col("first") + F.col("a") + F.col("b") - 1))
    sums = found.where("hot IS NOT NULL AND met").groupBy("key", "side", spread(F.col("id"), F.lit(STRIPS)).alias("strip"), "a", "b", "first")
    strips = sums.agg(F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("value")).alias("total"))
    strips = strips.select(F.explode(other).alias("cell"), "key", F.lit(0).alias("own"), F.lit(True).alias("adds"), "side", F.lit(None).cast("long").alias("id"), "copies", "total")
    met = plan.dealt(own.unionByName(strips), "own").mapInArrow(_fold, "side int, id long, key long, copies long, partners long, partner_sum long")
    alone = rows.where("key IS NULL").select(F.col("side").cast("int").alias("side"), "id", "key", "copies", F.lit(0).cast("long").alias("partners"), F.lit(0).cast("long").alias("partner_sum"))
    return met.unionByName(alone)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sorted cells with what the other side has of their keys.

    A cell is a bucket, or one block of a hot key with the other side's strips before it; either is a bin's share at most.
    """
    for cell in _cells(batches):
        at, key, side = (cell[c].to_numpy() for c in ("cell", "key", "side"))
        copies, total, adds = cell["copies"].to_numpy(), cell["total"].to_numpy(), cell["adds"].to_numpy(zero_copy_only=False)
        at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (at[1:] != at[:-1])]))
        group = np.repeat(np.arange(len(at)), np.diff(np.concatenate([at, [len(key)]])))
        count, value = np.empty((2, len(at)), dtype=np.int64), np.empty((2, len(at)), dtype=np.int64)
        for s in (0, 1):
            counted = adds & (side == s)
            count[s] = np.add.reduceat(np.where(counted, copies, 0), at)
            value[s] = np.add.reduceat(np.where(counted, total, 0), at)
        partners, partner_sum = count[1 - side, group], value[1 - side, group]
        own = pa.array(cell["own"].to_numpy() == 1)
        out = [cell["side"].cast(pa.int32()), cell["id"], cell["key"], cell["copies"], pa.array(partners), pa.array(partner_sum)]
        yield pa.RecordBatch.from_arrays([c.filter(own) for c in out], ["side", "id", "key", "copies", "partners", "partner_sum"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that begin and end with a cell, from sorted ones: several small cells may come together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column("cell").to_numpy()
        last = int(np.searchsorted(cells, cells[-1]))  # where the batch's last cell begins
        begins = not held or held[-1].column("cell")[-1].as_py() != cells[0]
        if last or begins and held:
            whole = [*held, batch.slice(0, last)]
            yield pa.Table.from_batches(whole).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def hot_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", bins: int | None = None, buffer: int = BUFFER) -> DataFrame:
    """The rows of an inner, left, right or full join on equal values of the column `on`, as structs l and r.

    on: whole numbers, texts or dates. A null key matches nothing. A struct is null where an outer row has no partner; so
    names that both sides have don't clash. Repeated rows all take part. An empty side is allowed.
    """
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"no such join: {how}")
    spark = left.sparkSession
    bins = bins or partitions(spark)
    packed = lambda df, side: df.select(F.lit(side).alias("side"), F.col(on).alias("key"), F.struct("*").alias("row"))
    rows = [packed(left, 0), packed(right, 1)]
    sizes = [x.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("lr"[k])) for k, x in enumerate(rows)]
    keys = sizes[0].join(sizes[1], "key", "full").select("key", *[F.coalesce(c, F.lit(0)).alias(c) for c in "lr"])
    work = (F.col("l") + F.col("r") + F.col("l") * F.col("r").cast("double")).cast("double")

    def cut(n: int, m: int, share: float) -> tuple[int, int, list[float]]:
        block = max(1, math.isqrt(int(share)))  # square cells copy the fewest rows
        a, b = (math.ceil(n / block), math.ceil(m / block)) if n and m else (math.ceil(n / share), math.ceil(m / share))
        a, b = max(a, 1), max(b, 1)
        return a, b, [(n / a + m / b + n * m / a / b)] * (a * b)

    plan = Plan(spark, keys, work, cut, bins)
    hot = F.col("hot").isNotNull()
    parts = []
    for k, x in enumerate(rows):
        found = x.where("key IS NOT NULL").join(plan.hot_table, F.col("key") == F.col("hot"), "left")
        # blocks of a hot key are drawn, as its rows may all be equal; and written, so that a task that runs again draws none anew
        drawn = saved(found.where(hot).withColumn("salt", (F.rand(13) * 2**30).cast("int")), "salted")
        found = drawn.unionByName(found.where(~hot).withColumn("salt", F.lit(0)))
        mine, others = (F.col("a"), F.col("b")) if k == 0 else (F.col("b"), F.col("a"))
        block, each = F.pmod("salt", mine), F.sequence(F.lit(0), F.when(F.col("met"), others - 1).otherwise(0))
        grid = F.transform(each, lambda j: F.col("first") + (block * F.col("b") + j if k == 0 else j * F.col("b") + block))  # noqa: B023
        cell = F.explode(F.when(hot, grid).otherwise(F.array(bucket(F.col("key"), plan.buckets))))
        blank = F.lit(None).cast((rows[1 - k]).schema["row"].dataType)
        both = [F.col("row").alias("l"), blank.alias("r")] if k == 0 else [blank.alias("l"), F.col("row").alias("r")]
        parts.append(found.select(cell.alias("cell"), "key", (1 - F.col("side")).alias("role"), F.coalesce("met", F.lit(False)).alias("met"), *both))
    dealt = plan.dealt(parts[0].unionByName(parts[1]), "role")
    out = [f.dataType for f in (parts[0].schema["l"], parts[1].schema["r"])]
    schema = f"l {out[0].simpleString()}, r {out[1].simpleString()}"
    joined = dealt.mapInArrow(lambda batches: _nested(batches, how, buffer), schema)
    for k, x in enumerate(rows):
        if how in (("left", "full"), ("right", "full"))[k]:
            alone = x.where("key IS NULL")
            blank = F.lit(None).cast(out[1 - k])
            joined = joined.unionByName(alone.select(F.col("row").alias("l"), blank.alias("r")) if k == 0 else alone.select(blank.alias("l"), F.col("row").alias("r")))
    return joined


class _Block:
    """Rows of one side of a key in a cell: held up to a number of bytes, then put aside on disk."""

    def __init__(self, most: int) -> None:
        self.most, self.held, self.bytes, self.file, self.rows = most, [], 0, None, 0

    def add(self, rows: pa.Array) -> None:
        self.held.append(rows)
        self.bytes += rows.nbytes
        self.rows += len(rows)
        if self.bytes > self.most:
            self.file = self.file or tempfile.TemporaryFile()  # has no name; gone with the task
            with pa.ipc.new_stream(self.file, pa.schema([("x", rows.type)])) as to:
                for x in self.held:
                    to.write_batch(pa.RecordBatch.from_arrays([x], ["x"]))
            self.ends = [*getattr(self, "ends", []), self.file.tell()]
            self.held, self.bytes = [], 0

    def __iter__(self) -> Iterator[pa.Array]:
        if self.file:
            for begin in [0, *self.ends[:-1]]:
                self.file.seek(begin)
                for batch in pa.ipc.open_stream(self.file):
                    yield batch.column(0)
            self.file.seek(self.ends[-1])
        yield from self.held


def _nested(batches: Iterator[pa.RecordBatch], how: str, most: int) -> Iterator[pa.RecordBatch]:
    """Block-nested loops over sorted rows: of each (cell, key) the right side comes first and is kept, the left passes by."""
    now, block = None, None
    seen = False  # whether the left side has come by

    def ended() -> Iterator[pa.RecordBatch]:
        if block is not None and block.rows and not seen and not met and how in ("right", "full"):
            for x in block:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(x), left), x], ["l", "r"])

    met, left = False, None
    for batch in batches:
        if not batch.num_rows:
            continue
        left = batch.schema.field("l").type
        cell, key, role = (batch.column(c) for c in ("cell", "key", "role"))
        new = pc.or_(pc.not_equal(cell[1:], cell[:-1]), pc.or_(pc.not_equal(key[1:], key[:-1]), pc.not_equal(role[1:], role[:-1])))
        cuts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if (at := (cell[s].as_py(), key[s].as_py())) != now:
                yield from ended()
                now, block, seen, met = at, _Block(most), False, batch.column("met")[s].as_py()
            if role[s].as_py() == 0:
                block.add(batch.column("r").slice(s, e - s))
                continue
            seen, rows = True, batch.column("l").slice(s, e - s)
            if not block.rows:
                if not met and how in ("left", "full"):
                    yield pa.RecordBatch.from_arrays([rows, pa.nulls(len(rows), batch.schema.field("r").type)], ["l", "r"])
                continue
            for x in block:
                step = max(1, PAIRS // len(x))
                for k in range(0, len(rows), step):
                    some = rows.slice(k, step)
                    for j in range(0, len(x), PAIRS):
                        part = x.slice(j, PAIRS)
                        i = np.repeat(np.arange(len(some)), len(part))
                        yield pa.RecordBatch.from_arrays([some.take(pa.array(i)), part.take(pa.array(np.tile(np.arange(len(part)), len(some))))], ["l", "r"])
    yield from ended()


def shop_rows(clicks: DataFrame, sales: DataFrame) -> DataFrame:
    """(side, id, key, value) of both tables: key is the client, after the moves that make three of them hot."""

    def one(df: DataFrame, side: int, id_col: str, amount: str) -> DataFrame:
        h = F.crc32(F.col(id_col).cast("string").cast("binary"))
        key = F.when(h % 10 < 2, F.floor(h / 10).cast("long") % 3).otherwise(F.col("client_id").cast("long"))
        cents = F.floor(F.lit(100.0) * F.col(amount) + 0.5).cast("string")
        text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(cents, F.lit("")))
        return df.select(F.lit(side).alias("side"), F.col(id_col).cast("long").alias("id"), key.alias("key"), F.crc32(text.cast("binary")).alias("value"))

    return one(clicks, 0, "click_id", "value").unionByName(one(sales, 1, "sale_id", "total"))


def join_digests(clicks: DataFrame, sales: DataFrame) -> DataFrame:
    """A row for each table and id: side, id, client_id, copies, inner_rows, left_rows, full_rows, partner_crc.

    Repeated rows count in copies. A null id is an id of its own, keeps its client and is an empty string in partner_crc.
    Should rows of one id differ in client or amount, each takes part as it is, and client_id shows the least of the clients.
    Other columns don't matter. Empty tables give no rows.
    """
    rows = shop_rows(clicks, sales)
    each = ["key", "value"]
    # one aggregation merges repeated rows and tells ids whose rows differ
    one = rows.groupBy("side", "id").agg(F.count("*").alias("copies"), F.count("key").alias("keys"), *[f(c).alias(f"{c}_{f.__name__}") for c in each for f in (F.min, F.max)])
    one = saved(one, "ids")
    same = (F.col("keys").isin(0) | (F.col("keys") == F.col("copies")) & (F.col("key_min") == F.col("key_max"))) & (F.col("value_min") == F.col("value_max"))
    plain = one.where(same).select("side", "id", F.col("key_min").alias("key"), F.col("value_min").alias("value"), "copies")
    odd = one.where(~same).select("side", "id")
    mixed = not odd.isEmpty()
    if mixed:
        theirs = rows.alias("x").join(odd.alias("y"), F.col("x.side").eqNullSafe(F.col("y.side")) & F.col("x.id").eqNullSafe(F.col("y.id")), "left_semi")
        plain = saved(plain.unionByName(theirs.groupBy("side", "id", *each).agg(F.count("*").alias("copies"))), "ids")
    folds = partner_folds(plain)
    inner, full = F.col("copies") * F.col("partners"), F.col("copies") * F.greatest("partners", F.lit(1))
    out = folds.select("side", "id", F.col("key").alias("client_id"), "copies", inner.alias("inner_rows"), F.when(F.col("side") == 0, full).otherwise(inner).alias("left_rows"), full.alias("full_rows"), (F.col("copies") * F.col("partner_sum")).alias("partner_crc"))
    if mixed:
        out = out.groupBy("side", "id").agg(F.min("client_id").alias("client_id"), *[F.sum(c).alias(c) for c in out.columns[3:]])
    return out.withColumn("side", F.when(F.col("side") == 0, "click").otherwise("sale"))


def query(spark, sf_dir):
    """op13: what clicks and sales find in each other by client."""
    return join_digests(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales"))


def _crc32_table() -> list[int]:
    out = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        out.append(k)
    return out


#: DuckDB has no CRC-32: one byte after the other, by the table of the polynomial.
SQL = f"""
WITH crc AS (SELECT {_crc32_table()}::BIGINT[] AS t
), tables AS (
  SELECT 'click' AS side, click_id AS id, client_id, value AS amount FROM clicks
  UNION ALL SELECT 'sale', sale_id, client_id, total FROM sales
), texts AS (
  SELECT *, CAST(id AS VARCHAR) AS a, id || ':' || coalesce(CAST(CAST(floor(100 * amount + 0.5) AS BIGINT) AS VARCHAR), '') AS b FROM tables
), hashed AS (
  SELECT side, id, client_id,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(a, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS h,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(b, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS v
  FROM texts, crc
), r AS (
  SELECT side, id, CASE WHEN h % 10 < 2 THEN (h // 10) % 3 ELSE client_id END AS k, v FROM hashed
), s AS (
  SELECT side, k, count(*) AS n, sum(v) AS v FROM r WHERE k IS NOT NULL GROUP BY ALL
)
SELECT r.side, r.id, r.k AS client_id, count(*)::BIGINT AS copies, sum(coalesce(s.n, 0))::BIGINT AS inner_rows,
  sum(CASE WHEN r.side = 'click' THEN greatest(coalesce(s.n, 0), 1) ELSE coalesce(s.n, 0) END)::BIGINT AS left_rows,
  sum(greatest(coalesce(s.n, 0), 1))::BIGINT AS full_rows, sum(coalesce(s.v, 0))::BIGINT AS partner_crc
FROM r LEFT JOIN s ON r.k = s.k AND r.side <> s.side GROUP BY ALL
"""
