"""Exact deduplication by progressive refinement.

Rows are grouped by length, then by the hash of a prefix, then by a hash of the
whole text; each step looks only at rows whose group still has company. Shuffles
carry lengths and hashes, never texts. Groups are counted with map-side partial
sums, so a group of copies of any size costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import small, text_of, written

#: Code points of the prefix that the second step hashes.
PREFIX = 256
#: The third step's candidates are looked up by slot: a set of at most this many
#: numbers (8 MB), whatever the corpus. A slot shared by chance only costs a hash.
SLOTS = 1 << 20
#: Groups of equal texts (about 150 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 500_000


def exact_groups(docs: DataFrame, carry: dict[str, Column] | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and the ``carry`` columns, for every row.

    Of equal texts the row with the largest id stays; of several rows with that
    id one. ``carry`` holds narrow columns derived from a row.

    Defined results: a null text equals the empty one; a null id is smaller than
    any other (keep_id is null only if all ids of the group are); an empty table
    gives no rows.
    """
    text = text_of(text_col)
    length, head = F.length(text), F.xxhash64(F.substring(text, 1, PREFIX))

    # Length, then prefix: only rows of shared lengths have their prefix hashed and grouped.
    shared_lengths = docs.groupBy(length.alias("len")).count().where("count > 1").select("len")
    heads = (docs.select(length.alias("len"), F.substring(text, 1, PREFIX).alias("t"))
                 .join(small(written(shared_lengths, "lengths"), 1_000_000), "len")
                 .select("len", F.xxhash64("t").alias("head")))
    shared_heads = heads.groupBy("len", "head").count().where("count > 1")
    slots = shared_heads.select(F.pmod(F.xxhash64("len", "head"), F.lit(SLOTS)).alias("slot")).distinct()

    # Whole texts are hashed only where length and prefix have company.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("seq"),
                       length.alias("len"), head.alias("head"), text.alias("t"),
                       *[c.alias(n) for n, c in (carry or {}).items()])
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("len", "head"), F.lit(SLOTS)))
    marked = written(slots, "slots").withColumn("shared", F.lit(True))
    rows = rows.join(F.broadcast(marked), "slot", "left")
    rows = rows.withColumn("full", F.when(F.col("shared"), F.sha2(F.col("t").cast("binary"), 256)))
    rows = written(rows.drop("t", "slot", "shared"), "exact")

    key = ["len", "head", "full"]
    candidates = rows.where(F.col("full").isNotNull())
    best = F.max(F.struct("doc_id", "seq"))
    groups = candidates.groupBy(*key).agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    carried = list(carry or {})
    # Written before it is joined: the join has shuffles of its own, if any, whose skew Spark can split.
    groups = written(groups, "groups")
    grouped = candidates.join(small(groups, BROADCAST_GROUPS), key).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("seq") == F.col("best.seq")).alias("kept"), *carried)
    alone = rows.where(F.col("full").isNull()).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), *carried)
    return grouped.unionByName(alone)


def exact_report(docs: DataFrame) -> DataFrame:
    """The groups with the sha256 of each whole text."""
    digest = F.sha2(text_of().cast("binary"), 256)
    return exact_groups(docs.select("doc_id", "text"), {"text_sha256": digest})


SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, sha256(t) as text_sha256
from d window g as (partition by t)
"""
