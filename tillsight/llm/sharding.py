"""Sharding by extendible hashing (DataFrame functions only).

A directory is indexed by the leading bits of a document's hash. Buckets over the
byte limit, and only those, are split on one more bit until every shard fits. A
few bits are resolved per round from sums over hash prefixes; rows below buckets
that still overflow go on to the next round.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import id_bits, small, text_of, two_level_rank, written

#: Bits of a hash (15 hex digits of an md5).
BITS = 60
#: Bytes of text in a shard at most; a single larger document is a shard of its own.
SHARD_BYTES = 1 << 20
#: Bits that a round after the first resolves.
STEP = 8
#: Directory rows that are broadcast; a longer directory is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _prefix(depth):
    return F.shiftright(F.col("bits"), BITS - depth) if depth else F.lit(0).cast("long")


def _directory(hist: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """hist (p, n_bytes, n_rows) over ``high`` bits -> per p its leaf's depth, bytes and rows.

    The leaf of a prefix is its shortest ancestor from ``low`` bits on that fits;
    prefixes without one are left out.
    """
    depth = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
    spread = hist.select("p", "n_bytes", "n_rows", depth)
    spread = spread.withColumn("q", F.expr(f"shiftright(p, {high} - depth)"))
    sums = spread.groupBy("depth", "q").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_rows").alias("shard_rows"))
    fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
    leaf = F.min(F.struct("depth", "q", "shard_bytes", "shard_rows")).alias("leaf")
    return spread.join(fits, ["depth", "q"]).groupBy("p").agg(leaf).select("p", "leaf.*")


def extendible_shards(rows: DataFrame, limit: int = SHARD_BYTES, step: int = STEP) -> DataFrame:
    """(row, bits, n_bytes) -> (row, n_bytes, shard, depth, page, shard_bytes, shard_rows).

    ``shard`` is the bucket's hash prefix as a string of 0 and 1 (empty if all
    rows fit one bucket). ``page`` is 0 but for rows whose whole hash is equal
    and which together exceed the limit (repeated ids): no bit can part them, so
    they are dealt to overflow pages of as many rows as surely fit.
    """
    rows = written(rows.withColumn("seq", F.monotonically_increasing_id()), "shard")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    high = max(1, min(BITS, math.ceil(math.log2(max(1, total / limit))) + 1))
    low, left, done = 0, rows, []
    while True:
        left = left.withColumn("p", _prefix(high))
        hist = left.groupBy("p").agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows"))
        leaves = written(_directory(hist, low, high, limit), "directory")
        found = small(leaves, BROADCAST_ROWS)
        done.append(left.join(found, "p").withColumn("page", F.lit(0).cast("long"))
                        .select("row", "n_bytes", "q", "depth", "page", "shard_bytes", "shard_rows"))
        left = left.join(found, "p", "left_anti").drop("p")
        if hist.join(found, "p", "left_anti").isEmpty():
            break
        left = written(left, "shard-left")
        if high == BITS:
            done.append(_overflow(left, limit))
            break
        low, high = high + 1, min(BITS, high + step)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    shard = F.expr("lpad(bin(q), depth, '0')")
    return out.withColumn("shard", F.when(F.col("depth") == 0, F.lit("")).otherwise(shard)).drop("q")


def _overflow(left: DataFrame, limit: int) -> DataFrame:
    widest = written(left.groupBy("bits").agg(F.max("n_bytes").alias("widest"), F.count(F.lit(1)).alias("n")), "wide")
    per_page = F.greatest(F.floor(F.lit(limit) / F.greatest("widest", F.lit(1))), F.lit(1))
    rows = left.join(widest, "bits").withColumn("slot", F.pmod("seq", F.ceil(F.col("n") / 65_536)))
    rows = two_level_rank(rows, ["bits"], ["slot"], ["seq"])
    rows = written(rows.withColumn("page", F.floor((F.col("rank") - 1) / per_page) + 1), "pages")
    pages = rows.groupBy("bits", "page").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
    return rows.join(pages, ["bits", "page"]).select(
        "row", "n_bytes", F.col("bits").alias("q"), F.lit(BITS).alias("depth"), "page", "shard_bytes", "shard_rows")


def sharded_documents(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes and shard of every document.

    Defined results: a null text has 0 bytes, a null doc_id has a hash of its
    own, repeated rows are rows of their own, an empty table gives no rows.
    """
    rows = docs.select(F.struct("doc_id").alias("row"), id_bits().alias("bits"),
                       F.octet_length(text_of()).cast("long").alias("n_bytes"))
    return extendible_shards(rows, limit).select(
        "row.doc_id", "n_bytes", "shard", F.col("depth").cast("int").alias("depth"), "page", "shard_bytes", "shard_rows")


SQL = f"""
with d as (
  select doc_id, octet_length(encode(coalesce(text, '')))::bigint as n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as bits from documents),
e as (select d.*, depth, bits >> ({BITS} - depth) as q from d, range(0, {BITS} + 1) t(depth)),
b as (select depth, q, sum(n_bytes)::bigint as shard_bytes, count(*) as shard_rows from e group by all),
f as (select e.doc_id, e.n_bytes, e.bits, min(e.depth) as depth from e join b using (depth, q)
      where b.shard_bytes <= {SHARD_BYTES} or b.shard_rows = 1 group by all)
select f.doc_id, f.n_bytes, case when f.depth = 0 then '' else substr(bin(f.bits | (1::bigint << {BITS})), 2, f.depth) end as shard,
       f.depth::int as depth, 0::bigint as page, b.shard_bytes, b.shard_rows
from f join b on b.depth = f.depth and b.q = f.bits >> ({BITS} - f.depth)
"""
