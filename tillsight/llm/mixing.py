"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source has the same expected number of copies, the source's
target divided by its size. The running sum of expected copies within the source
plus one offset per source crosses integers; a document is emitted once for each
integer that its step crosses. The running sum follows ascending sizes, so what
a source gives stays within about one document of its target; of ``OFFSETS``
evenly spaced offsets from a random one on, the source takes that which comes
nearest, which matters for sources of a few documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import SPACED_WORD, id_bits, md5_bits, small, two_level_rank, written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: A target is at most this many times its source's size.
MOST_COPIES = 3
#: Rows that one ranking task takes of a (source, size band), about.
ROWS_PER_SLOT = 65_536
SEED = "mix-1"
#: Offsets that a source chooses from.
OFFSETS = 32


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACED_WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(no_source, src, source_size) -> with ``target``: one row per source.

    Water filling: the level is the largest of (total - caps before) / (weights
    from here on) over the sources by cap per weight; a target is the smaller of
    its cap and level * weight. The windows see one row per source.
    """
    by_name = Window.orderBy("no_source", "src")
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int"))
    t = sizes.select("*", weight.alias("w"), (F.col("source_size") * most).alias("cap"))
    t = t.withColumn("fill", F.col("cap") / F.col("w"))
    order = Window.orderBy("fill", "no_source", "src")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    t = t.withColumn("level_here", (total - before) / rest)
    t = t.withColumn("level", F.max("level_here").over(everything))
    return t.select("no_source", "src", "source_size",
                    F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def planned_copies(docs: DataFrame, keep: list[str], weights=WEIGHTS, most: int = MOST_COPIES,
                   seed: str = SEED, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """(row, size, source_size, target, copies) for every row of ``docs``.

    ``row`` is a struct of the ``keep`` columns, so no column of the input can
    clash with the added ones. ``docs`` needs doc_id, source and text.

    Defined results: a null text has size 0; a null source is a source of its
    own, the last; a source of size 0 has target 0 and copies 0; repeated rows
    count as rows of their own; an empty table gives no rows. Reruns agree: the
    order within a source is (size band, slot of doc_id's md5, size, doc_id).
    """
    base = docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("row"),
        F.col("source").isNull().cast("int").alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"),
        F.col("doc_id").alias("id"), id_bits().alias("bits"),
        n_words(F.col("text")).alias("size"))
    base = base.withColumn("band", F.floor(F.sqrt("size")))
    narrow = base.drop("row") if set(keep) != {"doc_id"} else base
    narrow = written(narrow, "mix")
    rows = base if set(keep) != {"doc_id"} else narrow

    source = ["no_source", "src"]
    bands = narrow.groupBy(*source, "band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    bands = written(bands, "mix-bands")
    sizes = bands.groupBy(*source).agg(F.sum("words").alias("source_size"))
    share = source_targets(sizes, weights, most)
    # One row per source and size band: 20 sources of documents up to 10^6 words have 20,000.
    plan = bands.select(*source, "band", F.ceil(F.col("n") / rows_per_slot).alias("slots")).join(share, source)
    plan = written(plan, "mix-plan")

    def placed(df):
        return (df.join(plan, source + ["band"])
                  .withColumn("slot", F.pmod(F.col("bits"), F.col("slots"))))

    def ranked(df):
        return two_level_rank(placed(df), source, ["band", "slot"], ["size", "id"])

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = md5_bits(F.concat(F.lit(seed), F.col("no_source").cast("string"), F.col("src")), 8) / F.lit(2.0 ** 32)

    def copies(offset):
        crossed = (F.floor(rate * F.col("rank") + offset) - F.floor(rate * (F.col("rank") - 1) + offset)).cast("long")
        return F.least(crossed, F.lit(most).cast("long"))

    def offset_no(j):
        return drawn + F.lit(j / OFFSETS) - F.floor(drawn + F.lit(j / OFFSETS))

    sums = ranked(narrow).groupBy(*source, "target").agg(
        *[F.sum(copies(offset_no(j)) * F.col("size")).alias(f"t{j}") for j in range(OFFSETS)])
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{j}") - F.col("target")).alias("far"), F.lit(j).alias("j"),
                                             offset_no(j).alias("offset")) for j in range(OFFSETS)]))
    # One row per source.
    chosen = written(sums.select(*source, nearest["offset"].alias("offset")), "mix-offsets")
    return ranked(rows).join(small(chosen, 1_000_000), source).select(
        "row", "size", "source_size", "target", copies(F.col("offset")).alias("copies"))


def mixed(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (not at all included)."""
    plan = planned_copies(docs, docs.columns, **params)
    return (plan.where(F.col("copies") > 0)
                .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
                .select("row.*"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    plan = planned_copies(docs.select("doc_id", "source", "text"), ["doc_id"])
    return plan.select("row.doc_id", "size", "source_size", "target",
                       (F.col("copies") * F.col("size")).alias("taken"), "copies")


SQL = f"""
with d as (
  select doc_id, source, case when source is null then 1 else 0 end as no_source, coalesce(source, '') as src,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as bits
  from documents),
s as (select no_source, src, sum(size)::bigint as source_size from d group by all),
w as (select *, [{', '.join(map(str, WEIGHTS))}][1 + (row_number() over (order by no_source, src) - 1) % {len(WEIGHTS)}] as w,
             source_size * {MOST_COPIES} as cap, sum(source_size) over ()::bigint as total from s),
l as (select *, (total - coalesce(sum(cap) over (order by cap / w, no_source, src
                                  rows between unbounded preceding and 1 preceding), 0)::bigint)
               / (sum(w) over (order by cap / w, no_source, src
                               rows between current row and unbounded following))::bigint as level_here from w),
t as (select no_source, src, source_size, least(cap::double, (max(level_here) over ()) * w) as target,
             ('0x' || substr(md5('{SEED}' || no_source || src), 1, 8))::bigint / 4294967296.0 as u0 from l),
b as (select *, floor(sqrt(size))::bigint as band from d),
p as (select *, bits % ceil(count(*) over (partition by no_source, src, band) / {ROWS_PER_SLOT}.0)::bigint as slot from b),
r as (select *, row_number() over (partition by no_source, src order by band, slot, size, doc_id) as rk from p),
k as (select t.*, case when source_size > 0 then target / source_size else 0 end as rate, j,
             u0 + j / {OFFSETS}.0 - floor(u0 + j / {OFFSETS}.0) as u from t, range({OFFSETS}) o(j)),
a as (select r.doc_id, r.size, k.*, least(floor(rate * rk + u)::bigint - floor(rate * (rk - 1) + u)::bigint, {MOST_COPIES}) as copies
      from r join k using (no_source, src)),
e as (select no_source, src, j, abs(sum(copies * size) - any_value(target)) as far from a group by all),
f as (select no_source, src, j from e qualify row_number() over (partition by no_source, src order by far, j) = 1),
c as (select a.doc_id, a.size, a.source_size, a.target, a.copies from a join f using (no_source, src, j))
select doc_id, size, source_size, target, copies * size as taken, copies from c
"""
