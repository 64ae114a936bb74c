"""Benchmark decontamination by winnowing (DataFrame functions only).

Of every window of ``WINDOW`` words the smallest hash of its k-grams is kept, in
documents and benchmark items alike. Equal windows have equal minima, so every
shared span of a whole window is among the joined fingerprints; runs of windows
with one minimum are one fingerprint. Each hit is then extended over its run and
compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import small, text_of, written

#: Words of a window, and of the k-grams whose smallest hash represents it.
WINDOW, GRAM = 10, 5
#: Fixed value of the contract: what stands between words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Benchmark fingerprints, and windows, that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of words and item ids of the windows that are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 256 << 20


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other letters as they are (``lower`` serves texts of ASCII alone)."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), BETWEEN), "")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once however often a lambda below refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(words: Column, length: int, window: int, gram: int) -> Column:
    """Array of (len, m, first, last): the runs of ``length``-word windows with one minimum ``m``."""
    k = gram if length == window else length
    wide = length - k + 1

    def upto(n):
        return F.sequence(F.lit(1), n)

    def runs(m):
        n = F.size(m)
        starts = F.filter(upto(n), lambda i: (i == 1) | (F.get(m, i - 1) != F.get(m, i - 2)))
        return _let(starts, lambda at: F.transform(at, lambda i, j: F.struct(
            F.lit(length).alias("len"), F.get(m, i - 1).alias("m"), i.alias("first"),
            F.coalesce(F.get(at, j + 1) - 1, n).alias("last"))))

    def minima(g):
        return F.transform(upto(F.size(g) - wide + 1), lambda i: F.array_min(F.slice(g, i, wide))) if wide > 1 else g

    def found(w):
        grams = F.transform(upto(F.size(w) - k + 1), lambda i: F.xxhash64(F.slice(w, i, k)))
        return _let(grams, lambda g: _let(minima(g), runs))

    none = F.array().cast("array<struct<len:int,m:bigint,first:int,last:int>>")
    return F.when(F.size(words) >= length, _let(words, found)).otherwise(none)


def _windows(spans: DataFrame) -> DataFrame:
    """Spans (len, first, last, span words) -> a row per window: its first word's place and its words."""
    each = spans.withColumn("at", F.explode(F.sequence("first", "last")))
    key = F.array_join(F.slice("span", F.col("at") - F.col("first") + 1, F.col("len")), " ")
    return each.withColumn("key", key).drop("span", "first", "last")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, unnamed: bool = False) -> DataFrame:
    """(len, m, key, items): every different window and the sorted ids of the items that hold it.

    An item shorter than a window is one window; one without words has none. Items
    without id are left out, or with ``unnamed`` have windows that name no item.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(text_of()).alias("words"))
    items = items.where((F.size("words") > 0) & (F.col("item").isNotNull() | F.lit(unnamed)))
    own = F.least(F.size("words"), F.lit(window))
    runs = F.coalesce(*[F.when(own == n, _runs(F.col("words"), n, window, gram)) for n in range(1, window + 1)])
    spans = items.select("item", "words", F.explode(runs).alias("r")).select(
        "item", "r.len", "r.m", "r.first", "r.last",
        F.slice("words", F.col("r.first"), F.col("r.last") - F.col("r.first") + F.col("r.len")).alias("span"))
    return (_windows(spans).groupBy("len", "m", "key")
            .agg(F.array_sort(F.collect_set("item")).alias("items")))


def contamination(docs: DataFrame, benchmark: DataFrame, keep: dict[str, Column], window: int = WINDOW,
                  gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS,
                  broadcast_bytes: int = BROADCAST_BYTES, unnamed: bool = False) -> DataFrame:
    """The ``keep`` columns, n_words, n_hit, items (sorted ids) and contaminated, for every document.

    Defined results: a null text has no words; repeated rows are rows of their
    own; without benchmark windows nothing is hit, and items without id have none
    (as in ``SQL``) unless ``unnamed``: then they hit, but are not among ``items``;
    no documents give no rows.
    """
    known = written(benchmark_windows(benchmark, window, gram, unnamed), "bench")
    lengths = sorted(r["len"] for r in known.select("len").distinct().collect()) or [window]  # ``window`` values at most
    prints = known.select("len", "m").distinct()
    n_prints = prints.count()

    base = docs.select(F.monotonically_increasing_id().alias("seq"), F.struct(*[c.alias(n) for n, c in keep.items()]).alias("row"),
                       words_of(text_of()).alias("words"))
    cut = F.slice("words", F.col("r.first"), F.col("r.last") - F.col("r.first") + F.col("r.len"))
    # Each document also gets a run of length 0, which always joins and carries its row on.
    zero = [F.lit(0).alias("len"), F.lit(0).cast("long").alias("m"), F.lit(1).alias("first"), F.lit(0).alias("last")]
    spread = F.explode(F.concat(*[_runs(F.col("words"), n, window, gram) for n in lengths],
                                F.array(F.struct(*zero)))).alias("r")
    always = docs.sparkSession.range(1).select(F.lit(0).alias("len"), F.lit(0).cast("long").alias("m"))
    prints = prints.unionByName(always)
    hit = [F.col("r.len") == F.col("len"), F.col("r.m") == F.col("m")]
    if n_prints <= broadcast_rows:
        runs = base.select("seq", "row", "words", spread)
        found = runs.join(F.broadcast(prints), hit)
    else:  # only fingerprints are shuffled; the words of documents with hits follow by row number
        base = written(base, "words")
        runs = base.select("seq", spread)
        hits = runs.join(prints, hit).groupBy("seq").agg(F.collect_list("r").alias("rs"))
        found = base.join(hits, "seq").select("seq", "row", "words", F.explode("rs").alias("r"))
    found = written(found.select(
        "seq", F.col("r.len").alias("len"), F.col("r.first").alias("first"), F.col("r.last").alias("last"),
        F.when(F.col("r.len") == 0, F.col("row")).alias("row"),
        F.when(F.col("r.len") == 0, F.size("words").cast("long")).alias("n_words"),
        F.when(F.col("r.len") > 0, cut).alias("span")), "hits")

    # A fingerprint has any number of windows, and a window any number of items.
    item_bytes = F.aggregate("items", F.lit(0).cast("long"), lambda n, i: n + F.octet_length(i) + 8)
    extent = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("key") + item_bytes).alias("size")).first()
    exact = known.select("len", "key", "items")
    if (extent["size"] or 0) <= broadcast_bytes:
        exact = small(exact, broadcast_rows, extent["n"])
    spans = found.where("len > 0").select("seq", "len", "first", "last", "span")
    windows = _windows(spans).join(exact, ["len", "key"])
    per_doc = windows.groupBy("seq").agg(
        F.array_sort(F.collect_list(F.struct("at", (F.col("at") + F.col("len") - 1).alias("end")))).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
    covered = F.aggregate("places", start, lambda a, p: F.struct(
        (a["n"] + F.greatest(F.lit(0), p["end"] - F.greatest(p["at"] - 1, a["reach"]))).alias("n"),
        F.greatest(a["reach"], p["end"]).alias("reach")))["n"]
    docs_found = found.where("len = 0").select("seq", "row", "n_words")
    out = docs_found.join(per_doc.select("seq", covered.alias("n_hit"), "items"), "seq", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("row.*", "n_words", n_hit.alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      (n_hit > 0).alias("contaminated"))


def decontamination_report(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = contamination(docs.select("doc_id", "text"), benchmark, {"doc_id": F.col("doc_id")}, **params)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        digest.alias("items_sha256"), "contaminated")


def decontaminated(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` without a hit, by an item without id either. Whether a row has one depends on its text alone."""
    def key(df):
        return F.md5(F.coalesce(df["text"], F.lit("")))

    found = contamination(docs.select("text"), benchmark, {"text_md5": key(docs)}, broadcast_rows=broadcast_rows,
                          unnamed=True)
    bad = written(found.where("contaminated").select("text_md5").distinct(), "contaminated")
    return docs.join(small(bad, broadcast_rows), key(docs) == bad["text_md5"], "left_anti")


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')"""

SQL = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id::varchar as item, {_WORDS} as w from benchmark),
bw as (select item, len(w) as n, least(len(w), {WINDOW}) as l, w from b where len(w) > 0 and item is not null),
bk as (select distinct item, l, array_to_string(w[p:p + l - 1], ' ') as key
       from (select *, unnest(range(1, n - l + 2)) as p from bw)),
ls as (select distinct l from bk),
dw as (select doc_id, l, p, array_to_string(w[p:p + l - 1], ' ') as key
       from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) as p from d cross join ls)),
h as (select dw.doc_id, dw.p, dw.l, bk.item from dw join bk on dw.l = bk.l and dw.key = bk.key),
c as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + l)) as q from h) group by 1),
i as (select doc_id, list_sort(list(distinct item)) as items from h group by 1)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(len(i.items), 0)::bigint as n_items,
       sha256(coalesce(array_to_string(i.items, ','), '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from d left join c on c.doc_id = d.doc_id left join i on i.doc_id = d.doc_id
"""
