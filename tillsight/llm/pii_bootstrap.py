"""Personal data: four kinds of known form, and identifiers that their contexts lead to.

Base spans (email, ip, card, phone) are found by one pattern each. Their positions
come from what lies between the matches: the text is split at the same pattern, and a
running sum over the lengths of gaps and matches gives every start. Rows of equal
texts are searched once.

Bootstrapping, by DataFrame operations alone:

1. seeds: every base span induces two lexical patterns, the word and the two words
   before it. Patterns with SEEDS different entities of a kind are kept;
2. how often a pattern occurs at all, followed by whatever, is counted over the whole
   corpus; patterns that introduce a base span in less than SHARE per cent of their
   occurrences say nothing and go (nearly all of ordinary prose);
3. the others make a graph with the instances, i.e. the different words that follow
   them. In each of ROUNDS rounds a pattern's confidence is the mean of its instances'
   scores, where a seed scores 1000 for its kind and a word that is no seed scores what
   the best *other* trusted pattern gives it, so that no pattern vouches for itself;
4. words of an identifier's shape (five characters or more, with a digit or an @) after
   a trusted pattern, which overlap no base span, are spans of the kinds `like_email`,
   `like_ip`, `like_card` and `like_phone`.

All patterns avoid backtracking over long runs (possessive repeats, starts only where a
run starts), so a text takes time in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import small, table, text_of, written

#: Different entities that a pattern needs; occurrences before a base span, per cent; trust, of 1000; rounds.
SEEDS, SHARE, TRUST, ROUNDS = 3, 50, 700, 3
#: Code points before a span that are read for its context.
CONTEXT = 80
#: Patterns that are broadcast, at most; more are joined by a shuffle.
PATTERNS = 1_000_000

#: Kinds in the order of the report, and their patterns. A match starts where the previous one
#: ended (\G) or where its run of characters starts; runs are taken whole.
KINDS = ("email", "ip", "card", "phone")
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a kind can't occur.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
IP_PARTS = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"

WHITE = "\t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OPENERS, CLOSERS = r"[\"'(<\[{]", r"[\"')>\]},.;:!?]"


def plain(text: Column) -> Column:
    """A-Z in lower case and white space as spaces: as many code points as before."""
    return F.translate(text, UPPER + WHITE, LOWER + " " * len(WHITE))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), worth)
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _matches(kind: str) -> Column:
    """Array of (gap, before, m, after): the matches of a kind in ``text`` with the length of the text before each."""
    def found() -> Column:
        m = F.regexp_extract_all("text", F.lit(PATTERN[kind]), F.lit(0))
        return m if NEEDS[kind] is None else F.when(F.contains("text", F.lit(NEEDS[kind])), m)
    gaps = F.split("text", PATTERN[kind], -1)
    zipped = F.arrays_zip(gaps.alias("g"), found().alias("m"), F.slice(gaps, F.lit(2), F.greatest(F.size(found()), F.lit(0))).alias("a"))
    items = F.transform(zipped, lambda x: F.struct(
        F.length(x["g"]).alias("gap"), F.right(x["g"], F.lit(CONTEXT)).alias("before"), x["m"].alias("m"), F.left(x["a"], F.lit(CONTEXT)).alias("after")))
    return F.when(F.size(found()) > 0, F.filter(items, lambda x: x["m"].isNotNull()))


def base_spans(texts: DataFrame) -> DataFrame:
    """(key, text) -> key, no (the kind's), start, end, m, copies, words (before), token, per different text.

    ``words`` are the up to two words before the span, in lower case; ``token`` is the word
    that holds its start. Both are null where the span does not start its word.
    """
    kinds = F.array(*[F.struct(F.lit(i).alias("no"), _matches(k).alias("items")) for i, k in enumerate(KINDS)])
    rows = texts.select("key", F.explode(F.filter(kinds, lambda x: F.size(x["items"]) > 0)).alias("x")).select("key", "x.no", "x.items")
    once = written(rows.groupBy("key", "no").agg(F.first("items").alias("items"), F.count(F.lit(1)).alias("copies")), "matches")
    each = once.select("key", "no", "copies", F.posexplode("items").alias("pos", "x")).select("key", "no", "copies", "pos", "x.*")
    so_far = Window.partitionBy("key", "no").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("m")
    each = each.withColumn("end", F.sum(F.col("gap") + size).over(so_far).cast("long")).withColumn("start", F.col("end") - size)
    digits = F.regexp_replace("m", "[^0-9]", "")
    valid = (F.when(F.col("no") == 0, True).when(F.col("no") == 1, F.col("m").rlike(IP_PARTS)).when(F.col("no") == 2, luhn(digits))
             .otherwise(F.length(digits).between(10, 15)))
    # The first gap starts the text; another one may start within a word, which is no context.
    left = F.concat(F.when((F.col("pos") == 0) & (F.col("gap") <= CONTEXT), " ").otherwise(""), plain(F.col("before")))
    opened = F.regexp_extract(left, rf"\x20({OPENERS}*)$", 1)
    starts_word = left.rlike(rf"\x20{OPENERS}*$")
    two = F.regexp_extract(left, rf"\x20([^\x20]+\x20+[^\x20]+)\x20+{OPENERS}*$", 1)
    one = F.regexp_extract(left, rf"\x20([^\x20]+)\x20+{OPENERS}*$", 1)
    low = plain(F.col("m"))
    rest = F.when(~F.contains(low, F.lit(" ")), F.regexp_extract(plain(F.coalesce("after", F.lit(""))), r"^[^\x20]*", 0)).otherwise("")
    return each.where(valid).select(
        "key", "no", "start", "end", low.alias("m"), "copies",
        F.when(starts_word, F.array(F.when(one != "", one), F.when(two != "", F.regexp_replace(two, r"\x20+", " ")))).alias("words"),
        F.when(starts_word, F.concat(opened, F.regexp_extract(low, r"^[^\x20]*", 0), rest)).alias("token"))


def trimmed(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(token, rf"^{OPENERS}+", ""), rf"{CLOSERS}+$", "")


def contexts(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, token) of every word that follows one of ``patterns``, over whole texts."""
    words = F.concat(F.array(F.lit("")), F.array_remove(F.split(plain(F.col("text")), " "), ""))
    lists = texts.select("key", words.alias("w"))
    shifted = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"), F.slice("w", F.lit(3), F.size("w")).alias("token"))
    triples = lists.select("key", F.explode(shifted).alias("x")).select("key", "x.*").where(F.col("token").isNotNull())
    # Whoever knows a pattern of two words knows its second one.
    heads = written(patterns.select(F.substring_index("pattern", " ", -1).alias("b")).distinct(), "heads")
    near = triples.join(small(heads, PATTERNS), "b", "left_semi")
    both = F.explode(F.array(F.col("b"), F.when(F.col("a") != "", F.concat_ws(" ", "a", "b"))))
    near = near.select("key", "token", both.alias("pattern")).where(F.col("pattern").isNotNull())
    return near.join(small(patterns.select("pattern"), PATTERNS), "pattern", "left_semi")


def pattern_graph(texts: DataFrame, base: DataFrame, seeds: int = SEEDS, share: int = SHARE) -> DataFrame:
    """Edges (pattern, instance, no): the different words after every pattern that is worth scoring; no is a seed's kind."""
    known = base.where(F.col("words").isNotNull()).select(
        "no", "m", "token", "copies", F.explode("words").alias("pattern")).where(F.col("pattern").isNotNull())
    known = written(known.groupBy("pattern", "no", "m", "token").agg(F.sum("copies").alias("copies")), "seeds")
    entities = known.groupBy("pattern", "no", "m").agg(F.sum("copies").alias("copies")).groupBy("pattern", "no").agg(
        F.count(F.lit(1)).alias("entities"), F.sum("copies").alias("copies"))
    induced = entities.groupBy("pattern").agg(F.max("entities").alias("entities"), F.sum("copies").alias("copies"))
    induced = written(induced.where(F.col("entities") >= seeds).select("pattern", "copies"), "induced")
    totals = contexts(texts, induced).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    worth = totals.join(induced, "pattern").where(F.col("copies") * 100 >= F.col("n") * share)
    worth = written(worth.select("pattern"), "worth")
    others = contexts(texts, worth).select("pattern", "token").distinct()
    others = others.join(known.select("pattern", "token").distinct(), ["pattern", "token"], "left_anti")
    others = others.select("pattern", trimmed(F.col("token")).alias("instance"), F.lit(None).cast("int").alias("no")).distinct()
    own = known.join(worth, "pattern", "left_semi").select("pattern", F.col("m").alias("instance"), "no").distinct()
    return written(own.unionByName(others.where("instance <> ''")), "edges")


def scored_patterns(edges: DataFrame, trust: int = TRUST, rounds: int = ROUNDS, seeds: int = SEEDS) -> DataFrame:
    """(pattern, no, confidence) of the trusted patterns after the last round."""
    sizes = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("n"))
    firm = edges.where("no is not null").select("pattern", "instance", "no", F.lit(1000).cast("long").alias("score"))
    open_edges = edges.where("no is null").select("pattern", "instance")
    known = firm
    for i in range(rounds):
        sums = known.groupBy("pattern", "no").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("votes"))
        trusted = sums.join(sizes, "pattern").select("pattern", "no", F.floor(F.col("score") / F.col("n")).cast("long").alias("confidence"), "votes", "n")
        trusted = written(trusted.where((F.col("confidence") >= trust) & (F.col("votes") >= seeds)).select("pattern", "no", "confidence"), "trusted")
        if i + 1 == rounds:
            break
        # The two best patterns per word and kind: a pattern takes the best that is not itself.
        votes = open_edges.join(trusted, "pattern").groupBy("instance", "no").agg(
            F.max(F.struct("confidence", "pattern")).alias("best"), F.count(F.lit(1)).alias("many"))
        second = open_edges.join(trusted, "pattern").join(votes, ["instance", "no"]).where("pattern <> best.pattern").groupBy(
            "instance", "no").agg(F.max("confidence").alias("second"))
        votes = votes.join(second, ["instance", "no"], "left")
        given = open_edges.join(votes, "instance").select(
            "pattern", "instance", "no", F.when(F.col("pattern") != F.col("best.pattern"), F.col("best.confidence")).otherwise(F.col("second")).alias("score"))
        known = firm.unionByName(given.where("score is not null"))
    return trusted


def learned_spans(texts: DataFrame, base: DataFrame, edges: DataFrame, trusted: DataFrame) -> DataFrame:
    """key, no (a base kind's plus 4), start, end of words that trusted patterns lead to and no base span overlaps."""
    shape = (F.length("instance") >= 5) & F.col("instance").rlike("[0-9@]")
    best = edges.where("no is null").where(shape).select("pattern", "instance").join(trusted, "pattern").groupBy("instance").agg(
        F.min(F.struct((-F.col("confidence")).alias("c"), "no")).alias("x")).select("instance", "x.no")
    pairs = edges.where("no is null").select("pattern", "instance").join(trusted.select("pattern").distinct(), "pattern", "left_semi")
    pairs = written(pairs.join(best, "instance").select("pattern", "instance", "no"), "learned")
    # Only the texts that hold such a word are taken apart with positions.
    held = contexts(texts, pairs.select("pattern").distinct()).withColumn("instance", trimmed(F.col("token")))
    held = held.join(pairs, ["pattern", "instance"], "left_semi").select("key").distinct()
    own = texts.join(held, "key", "left_semi").dropDuplicates(["key"])
    words = own.select("key", F.posexplode(F.split(plain(F.col("text")), " ")).alias("pos", "token"))
    in_order = Window.partitionBy("key").orderBy("pos")
    words = words.withColumn("start", F.sum(F.length("token") + 1).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("token") - 1)
    words = words.where("token <> ''").select("key", "token", "start", F.lag("token", 1).over(in_order).alias("b"), F.lag("token", 2).over(in_order).alias("a"))
    patterns = F.explode(F.array(F.col("b"), F.when(F.col("a").isNotNull(), F.concat_ws(" ", "a", "b"))))
    words = words.where("b is not null").select("key", "token", "start", patterns.alias("pattern")).where("pattern is not null")
    words = words.withColumn("instance", trimmed(F.col("token"))).join(pairs, ["pattern", "instance"])
    lead = F.length("token") - F.length(F.regexp_replace("token", rf"^{OPENERS}+", ""))
    spans = words.select("key", (F.col("no") + len(KINDS)).alias("no"), (F.col("start") + lead).cast("long").alias("start"),
                         (F.col("start") + lead + F.length("instance")).cast("long").alias("end")).distinct()
    taken = base.select("key", F.col("start").alias("s"), F.col("end").alias("e"))
    apart = (spans["key"] == taken["key"]) & (F.col("s") < F.col("end")) & (F.col("start") < F.col("e"))
    return spans.join(taken, apart, "left_anti")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): equal texts share the key (128 bits)."""
    text = text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("key"), text.alias("text"))


def pii_spans(docs: DataFrame, seeds: int = SEEDS, share: int = SHARE, trust: int = TRUST, rounds: int = ROUNDS) -> DataFrame:
    """key, no, start, end of all spans of every different text; no is a place in KINDS, or that plus 4."""
    texts = keyed(docs).select("key", "text")
    base = written(base_spans(texts), "base")
    edges = pattern_graph(texts, base, seeds, share)
    trusted = scored_patterns(edges, trust, rounds, seeds)
    found = base.select("key", "no", "start", "end").unionByName(learned_spans(texts, base, edges, trusted))
    return written(found, "spans")


def pii_report(docs: DataFrame, **params) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, base_sha256, spans, and n_learned.

    Defined results: a null or empty text has no spans (counts 0, the digest of '', spans
    ''); repeated rows each give their own row, and their texts count once as evidence; a
    null doc_id stays null; only doc_id and text are read; an empty table gives no rows.
    """
    found = pii_spans(docs, **params)
    names = F.array(*[F.lit(k) for k in KINDS], *[F.lit(f"like_{k}") for k in KINDS])
    spans = F.array_sort(F.collect_list(F.struct("start", "no", "end")))
    by_text = found.groupBy("key").agg(spans.alias("all"))

    def joined(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda x: F.concat_ws(":", F.element_at(names, x["no"] + 1), x["start"], x["end"])), ",")

    def count(i: int) -> Column:
        return F.size(F.filter("all", lambda x: x["no"] == i)).cast("long")

    base = F.filter("all", lambda x: x["no"] < len(KINDS))
    by_text = by_text.select("key", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                             F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"),
                             F.size(F.filter("all", lambda x: x["no"] >= len(KINDS))).cast("long").alias("n_learned"))
    out = keyed(docs).select("doc_id", "key").join(by_text, "key", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in [f"n_{k}" for k in KINDS]]
    return out.select("doc_id", *zero, F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
                      F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_learned", F.lit(0).cast("long")).alias("n_learned"))


def op11_context_bootstrap(spark, sf_dir):
    return pii_report(table(spark, sf_dir, "documents"))
