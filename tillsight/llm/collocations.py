"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: each word with the three that follow it in its
piece, as lead columns w1..w4 padded with null at the piece's end. These counts are then
summed over ever shorter prefixes, each sum from the one before it: the sum over a
prefix of k words is how often that phrase occurs, and the sum over the language is
its number of words. So no text is exploded into n-grams of several lengths, and the
sum over a prefix carries the frequent phrases found below it along, so that one
reading of the windows gives the phrases of every length.

Equal windows of a few megabytes of text are counted before they leave their task, so
a word, pair or language that holds a third of all windows is a few rows per task.
The windows are counted in SLICES passes over the table, each taking the first words
of one hash slice: the shuffles of a pass are let go before the next one, which bounds
scratch space to a slice's.

From then on only phrases with LEAST occurrences are kept: every part of a candidate
occurs as often as the candidate itself.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import shuffles_released, table, text_of, written

#: Occurrences of a phrase, at least; rows reported per language.
LEAST, TOP = 30, 2000
#: A phrase goes if a longer one holds it in this per cent of its occurrences.
ABSORBED = 80
#: Passes over the table, each for a share of the first words.
SLICES = 3
#: Bytes of text whose windows are counted together before they are shuffled.
SEGMENT = 12 << 20
#: Rows of a batch that goes back to Spark.
ROWS = 1 << 16

ORDER = 4
COLUMNS = [f"w{i}" for i in range(1, ORDER + 1)]
SCHEMA = pa.schema([("lang", pa.string()), *[(c, pa.string()) for c in COLUMNS], ("n", pa.int64())])

#: Stands between pieces: no byte of UTF-8.
_END = b"\xff"
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _END * 10)


def segments(octets: bytes, size: int):
    """(words, bytes) of a text, _END between its pieces and at its end, by about ``size`` bytes each."""
    octets, at = octets.translate(_BYTES), 0
    while at < len(octets):
        end = min(len(octets), at + size)
        while end < len(octets) and octets[end] not in b" \xff":
            end += 1
        yield octets[at:end].replace(_END, b" \xff ").split(), end - at
        at = end
    yield [_END], 1


def slices_of(words: pa.Array, parts: int) -> np.ndarray:
    """The slice of each word (none is empty), by a sum over its bytes."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    octets = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    starts = offsets[:-1] - offsets[0]
    place = (np.arange(len(octets)) - np.repeat(starts, np.diff(offsets))) & 0xFFFF  # bounds the powers, however long a word
    power = np.cumprod(np.full(int(place.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    sums = np.add.reduceat((octets + np.uint64(1)) * power[place], starts)
    return (((sums ^ (sums >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)) % np.uint64(parts)


def counted_windows(words: list[bytes], langs: np.ndarray, names: list[str], last: int, part: int, parts: int):
    """Batches (lang, w1..w4, n) of the windows that start at one of the first ``last`` words, in the slice ``part``.

    ``langs`` numbers the language of every word by ``names``.
    """
    coded = pa.array([_END, *words], pa.binary()).dictionary_encode()
    codes, numbers = coded.indices.to_numpy()[1:], coded.dictionary
    own = slices_of(numbers, parts) == part
    own[0] = False
    starts = np.flatnonzero(own[codes[:last]])
    if not len(starts):
        return
    codes = np.append(codes, np.zeros(ORDER, codes.dtype))
    lead = [codes[starts]]
    for i in range(1, ORDER):
        lead.append(np.where(lead[-1] > 0, codes[starts + i], 0))
    base = np.int64(len(numbers))
    head = (langs[starts] * base + lead[0]) * base + lead[1]
    tail = lead[2].astype(np.int64) * base + lead[3]
    order = np.lexsort((tail, head))
    head, tail = head[order], tail[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(head) != 0) | (np.diff(tail) != 0)]))
    counts = np.diff(np.append(first, len(head)))
    rows = order[first]
    vocabulary = numbers.slice(1).cast(pa.string())
    langs_of = pa.array(names, pa.string())
    for at in range(0, len(rows), ROWS):
        pick = rows[at:at + ROWS]
        columns = [langs_of.take(pa.array(langs[starts[pick]]))] + [
            vocabulary.take(pa.array(c[pick] - 1, mask=c[pick] == 0)) for c in lead]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts[at:at + ROWS], pa.int64())], schema=SCHEMA)


def windows(docs: DataFrame, part: int = 0, parts: int = 1, size: int = SEGMENT) -> DataFrame:
    """(lang, w1..w4, n): counted windows of the words whose hash slice is ``part``."""
    def run(batches):
        words, runs, names, held = [], [], {}, 0

        def flush(last: int):
            nonlocal words, runs, names, held
            langs = np.repeat([k for k, _ in runs], [n for _, n in runs]) if runs else np.zeros(0, np.int64)
            yield from counted_windows(words, langs.astype(np.int64), list(names), last, part, parts)
            # The last words wait for those that follow them.
            words, kept = words[last:], [list(names)[k] for k in langs[last:].tolist()]
            names = {}
            runs, held = [(names.setdefault(k, len(names)), 1) for k in kept], 0

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                name = lang.as_py()
                for more, n_bytes in segments(text.as_py(), size):
                    words += more
                    runs.append((names.setdefault(name, len(names)), len(more)))
                    held += n_bytes
                    if held >= size and len(words) >= ORDER:
                        yield from flush(len(words) - ORDER + 1)
        yield from flush(len(words))

    columns = ", ".join(f"{c} string" for c in ("lang", *COLUMNS))
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_of().alias("text")).mapInArrow(run, f"{columns}, n long")


def _marginalised(rows: DataFrame, k: int, least: int) -> DataFrame:
    """Counts of k words -> their share in the counts of k - 1 words; a phrase of k words that is frequent also stays.

    Shorter windows, of a piece's end, and phrases that are longer and were kept go on as they are. Only
    the k-th word is exploded, so that the rows stay dealt by the words before it.
    """
    sums = rows.groupBy("lang", *COLUMNS).agg(F.sum("n").alias("n"))
    word = f"w{k}"
    shorter = F.lit(None).cast("string")
    ends = F.when(F.col("n") >= least, F.array(word, shorter)).otherwise(F.array(shorter))
    ends = F.when(F.col(word).isNull(), F.array(shorter)).otherwise(ends)
    if k < ORDER:
        ends = F.when(F.col(f"w{k + 1}").isNotNull(), F.array(word)).otherwise(ends)
    kept = [c for c in COLUMNS if c != word]
    return sums.select("lang", *kept, "n", F.explode(ends).alias(word))


def _slice_counts(docs: DataFrame, least: int, part: int, parts: int) -> DataFrame:
    """phrase_counts of the phrases whose first word is in one slice; the language's share of words among them."""
    # Dealt by three words: the sums over four and over three need no other shuffle.
    rows = windows(docs, part, parts).repartition("lang", "w1", "w2", "w3")
    for k in range(ORDER, 0, -1):
        rows = _marginalised(rows, k, least)
    rows = rows.groupBy("lang", *COLUMNS).agg(F.sum("n").alias("f"))
    words = reduce(lambda x, y: x + y, [F.col(c).isNotNull().cast("int") for c in COLUMNS])
    return written(rows.select("lang", words.alias("words"), F.concat_ws(" ", *COLUMNS).alias("phrase"), "f"), "phrase-counts")


def phrase_counts(docs: DataFrame, least: int = LEAST, slices: int = SLICES) -> DataFrame:
    """(lang, words, phrase, f): phrases of 1 to 4 words with f >= least; words = 0 holds the language's own count."""
    with shuffles_released(docs.sparkSession):
        parts = [_slice_counts(docs, least, i, slices) for i in range(slices)]
    whole = reduce(DataFrame.unionByName, parts)
    totals = whole.where("words = 0").groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return written(whole.where("words > 0").unionByName(totals), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, slices: int = SLICES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to 4 words.

    Defined results: a null lang is `und`; a null text counts as empty; repeated rows
    count each time; languages without a phrase give no row; an empty table gives none.
    Sums are longs, scores are taken in decimals of 38 digits.
    """
    counts = phrase_counts(docs, least, slices)
    phrases = counts.where("words > 0")
    found = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    # Absorbed: a phrase inside a longer candidate that makes up most of its occurrences.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))
    around = found.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a")
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = found.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * ABSORBED))

    # Every cut of what is left, with the counts of both parts.
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    part = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("cast((2000000 * cast(a as decimal(30,0))) div (cast(l as decimal(30,0)) + cast(r as decimal(30,0))) as long)")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    # A literal bound lets every task keep its best rows before the shuffle by language.
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The contract by plain n-grams of each length.
SQL = r"""
with docs as (
  select row_number() over () as id, coalesce(lang, 'und') as lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
pieces as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from docs),
lists as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from lists),
grams as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f
          from starts, (select unnest([1, 2, 3, 4]) as k) where i + k - 1 <= len(w) group by all),
totals as (select lang, sum(f) as n from grams where k = 1 group by lang),
phrases as (select * from grams where f >= 30),
found as (select lang, phrase, k, f as a, string_split(phrase, ' ') as w from phrases where k > 1),
around as (select lang, array_to_string(w[i:i + s - 1], ' ') as phrase, max(a) as longer
           from found, (select unnest([2, 3]) as s), (select unnest([1, 2, 3]) as i)
           where s < k and i + s - 1 <= k group by 1, 2),
kept as (select found.* from found left join around using (lang, phrase)
         where longer is null or 100 * longer::hugeint < 80 * a::hugeint),
cuts as (select lang, phrase, a, c, array_to_string(w[:c], ' ') as first, array_to_string(w[c + 1:], ' ') as rest
         from kept, (select unnest([1, 2, 3]) as c) where c < k),
scored as (select cuts.lang, cuts.phrase, a, c, x.f as l, y.f as r,
                  (2000000 * a::hugeint) // (x.f::hugeint + y.f::hugeint) as score
           from cuts join phrases x on x.lang = cuts.lang and x.phrase = first
                     join phrases y on y.lang = cuts.lang and y.phrase = rest),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked join totals using (lang) where rank <= 2000
"""


def op13_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
