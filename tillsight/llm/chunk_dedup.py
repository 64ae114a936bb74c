"""Substring deduplication by content-defined chunks.

A gear rolling hash over the bytes of a text decides by the last 16 bytes alone
where a chunk ends, so after an insertion the same chunks follow again. Chunks
are grouped by digest; of equal chunks the first (by doc_id, then place) stays.
Neighbouring repeated chunks make up a repeated span, reported if it is long.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import text_of, written

#: Bytes of a chunk: mean distance of cut points, least and most.
MEAN, LEAST, MOST = 32, 16, 64
#: Words of a repeated passage that is reported. A passage shares its chunks but for some
#: at its ends; short runs of chunks are compared with their first copies beyond their ends.
MIN_WORDS = 10
#: Bytes that serve as well as MIN_WORDS words: ten words of the corpus take about as many,
#: and text without white space has hardly any words.
MIN_BYTES = 64


def gear_table() -> np.ndarray:
    """256 16-bit numbers by rule: the high half of a 32-bit multiplicative hash of the byte."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
    x = ((x ^ (x >> np.uint64(15))) * np.uint64(0x85EBCA77)) & np.uint64(0xFFFFFFFF)
    x = ((x ^ (x >> np.uint64(13))) * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    return (x >> np.uint64(16)).astype(np.uint16)


GEAR = gear_table()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """For each byte the sum of GEAR of it and the 15 before it, each shifted by its distance (16 bits).

    The same numbers as the rolling form ``h = (h << 1) + GEAR[byte]``: a bit is
    shifted out after 16 bytes. Spans of 1, 2, 4 and 8 bytes are combined.
    """
    h = GEAR[data]
    for shift in (1, 2, 4, 8):
        longer = h.copy()
        longer[shift:] += h[:-shift] << np.uint16(shift)
        h = longer
    return h


def cut_points(data: np.ndarray, mean: int = MEAN, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of ``data``; the last is its length.

    A chunk ends behind a byte whose hash is below a bar. Where none comes within
    ``most`` bytes it ends at the smallest hash (the last of equal ones), which
    also follows the content: text that repeats itself is cut in one phase.
    """
    h = gear_hash(data)
    cuts, last = [], 0

    def forced(until):
        nonlocal last
        while until - last > most:
            part = h[last + least - 1:last + most][::-1]
            last += most - int(part.argmin())
            cuts.append(last)

    for at in (np.flatnonzero(h < 65_536 // mean) + 1).tolist():
        forced(at)
        if at - last >= least:
            cuts.append(at)
            last = at
    forced(len(data))
    if last < len(data):
        cuts.append(len(data))
    return cuts


def text_chunks(text: str, mean: int = MEAN, least: int = LEAST, most: int = MOST):
    """(digests, starts in code points, words that begin in each) of the chunks of a whole text.

    A digest has 64 bits; a span takes two equal neighbouring digests or more.
    """
    octets = text.encode("utf-8", "replace")
    data = np.frombuffer(octets, np.uint8)
    cuts = cut_points(data, mean, least, most)
    begins = [0, *cuts[:-1]]
    digests = b"".join([blake2b(octets[a:z], digest_size=8).digest() for a, z in zip(begins, cuts)])
    places = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    spaced = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    words = np.append(0, np.cumsum(~spaced & np.append(True, spaced[:-1])))
    return np.frombuffer(digests, "<i8"), places[begins + [len(data)]], np.diff(words[begins + [len(data)]])


def _chunked(docs: DataFrame) -> DataFrame:
    """A row per document with text: its digests, starts (and the end), words and text."""
    def run(batches):
        for batch in batches:
            for i, text in enumerate(batch.column(2)):
                digests, starts, words = text_chunks(text.as_py())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([digests], pa.list_(pa.int64())),
                     pa.array([starts], pa.list_(pa.int32())), pa.array([words], pa.list_(pa.int32())),
                     batch.column(2).slice(i, 1)],
                    names=["seq", "doc_id", "digests", "starts", "words", "text"])

    def gathered(batches):
        """Many documents to a batch."""
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.nbytes
            if n > 1 << 22:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    rows = docs.select(F.monotonically_increasing_id().alias("seq"), F.col("doc_id").cast("long").alias("doc_id"),
                       text_of().alias("text")).where("text <> ''")
    return rows.mapInArrow(gathered, "seq long, doc_id long, digests array<long>, starts array<int>, words array<int>, text string")


def _around(chunks: DataFrame, asked: DataFrame, reach: int) -> DataFrame:
    """(seq, a, z) -> before, after and n_bytes: the text around cuts ``a`` and ``z``, and the bytes between.

    ``before`` ends at the cut, with a code point more than ``reach`` for what parts
    words; ``after`` begins with the code point that the cut ends or stands in.
    """
    def run(batches):
        for batch in batches:
            rows = []
            for seq, starts, text, cuts in zip(*batch.columns):
                seq, starts, text = seq.as_py(), starts.values, text.as_py()
                for at in cuts.as_py():
                    a, z = starts[at["a"]].as_py(), starts[at["z"]].as_py()
                    rows.append((seq, at["a"], at["z"], text[max(0, a - reach - 1):a], text[max(0, z - 1):z + reach],
                                 len(text[a:z].encode("utf-8", "replace"))))
            yield pa.RecordBatch.from_pylist([dict(zip(("seq", "a", "z", "before", "after", "n_bytes"), r)) for r in rows], made)

    made = pa.schema([("seq", pa.int64()), ("a", pa.int32()), ("z", pa.int32()), ("before", pa.string()),
                      ("after", pa.string()), ("n_bytes", pa.int64())])
    per_text = asked.groupBy("seq").agg(F.collect_set(F.struct("a", "z")).alias("asked"))
    return (chunks.select("seq", "starts", "text").join(per_text, "seq").select("seq", "starts", "text", "asked")
                  .mapInArrow(run, "seq long, a int, z int, before string, after string, n_bytes long"))


def shared_size(before: str, first_before: str, after: str, first_after: str) -> tuple[int, int]:
    """(words that begin, bytes) in what two copies share beyond the ends of a run of equal chunks."""
    n = 0
    while n < min(len(before), len(first_before)) and before[-1 - n] == first_before[-1 - n]:
        n += 1
    m = 0
    while m < min(len(after), len(first_after)) and after[m] == first_after[m]:
        m += 1
    left, right = before[len(before) - n:], after[1:m]
    space = " \t\n\v\f\r"
    words = sum(c not in space and (i == 0 or before[i - 1] in space) for i, c in enumerate(before) if i >= len(before) - n)
    words += sum(after[i] not in space and after[i - 1] in space for i in range(1, m))
    return words, len((left + right).encode("utf-8", "replace"))


def _long_with_ends(chunks: DataFrame, short: DataFrame, min_words: int, min_bytes: int) -> DataFrame:
    """(seq, run) of the short runs that are long enough with what their first copies share beyond their ends."""
    ends = short.select("seq", "run", "n_words", F.col("head.no").alias("a"), (F.col("tail.no") + 1).alias("z"),
                        F.col("head.seq").alias("seq_l"), F.col("head.first").alias("l"),
                        F.col("tail.seq").alias("seq_r"), (F.col("tail.first") + 1).alias("r"))
    # A first copy is asked for once, however many runs begin or end with it.
    firsts = ends.select(F.explode(F.array(F.struct(F.col("seq_l").alias("seq"), F.col("l").alias("a")),
                                           F.struct(F.col("seq_r").alias("seq"), F.col("r").alias("a")))).alias("f"))
    firsts = firsts.select("f.seq", "f.a", F.col("f.a").alias("z")).distinct()
    around = written(_around(chunks, ends.select("seq", "a", "z").unionByName(firsts), max(min_bytes, 1)), "around")
    left = around.where("a = z").select(F.col("seq").alias("seq_l"), F.col("a").alias("l"), F.col("before").alias("first_before"))
    right = around.where("a = z").select(F.col("seq").alias("seq_r"), F.col("z").alias("r"), F.col("after").alias("first_after"))

    def run(before: pd.Series, first_before: pd.Series, after: pd.Series, first_after: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared_size(*x) for x in zip(before, first_before, after, first_after)], columns=["words", "bytes"])

    run.__annotations__ = dict.fromkeys(("before", "first_before", "after", "first_after"), pd.Series) | {"return": pd.DataFrame}
    beyond = F.pandas_udf(run, "words int, bytes int")("before", "first_before", "after", "first_after")
    own = ends.join(around.where("a < z"), ["seq", "a", "z"]).join(left, ["seq_l", "l"]).join(right, ["seq_r", "r"])
    sized = own.select("seq", "run", "n_words", "n_bytes", beyond.alias("beyond"))
    return sized.where((F.col("n_words") + F.col("beyond.words") >= min_words)
                       | (F.col("n_bytes") + F.col("beyond.bytes") >= min_bytes)).select("seq", "run")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, within: bool = False,
                   min_bytes: int = MIN_BYTES) -> DataFrame:
    """(doc_id, start, end, n_words, n_chunks, first_doc_ids) of every repeated span.

    A span is a run of neighbouring chunks that are not the first of their digest
    (by doc_id, then row, then place) and whose first stands in another row; with
    ``within`` also those whose first stands earlier in the same row. ``start``
    and ``end`` are code points, end exclusive; ``first_doc_ids`` are the sorted
    ids of the rows with the first copies. A span is reported if it covers its row,
    or if the passage around it that its first and last chunk share with their first
    copies has ``min_words`` words or ``min_bytes`` bytes; ``start``, ``end`` and
    ``n_words`` are those of the repeated chunks alone.

    Defined results: null and empty texts have no spans; a whole copy is one
    span, however short; of repeated rows all but one are; a null doc_id comes
    first; an empty table gives no rows.
    """
    chunks = written(_chunked(docs), "chunks")
    every = chunks.select("seq", F.posexplode("digests").alias("no", "digest"))
    # Counts are summed before they are shuffled: a chunk in a third of all texts is a row per task.
    common = every.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    repeated = written(every.join(common, "digest"), "repeats")

    owner = chunks.select("seq", "doc_id", "starts", "words")
    places = repeated.groupBy("seq").agg(F.collect_list(F.struct("no", "digest")).alias("at"))  # as many as the text has
    placed = owner.join(places, "seq").select("seq", "doc_id", "starts", "words", F.explode("at").alias("c")).select(
        "seq", "doc_id", F.col("c.no").alias("no"), F.col("c.digest").alias("digest"),
        F.get("starts", F.col("c.no")).alias("start"), F.get("starts", F.col("c.no") + 1).alias("end"),
        F.get("words", F.col("c.no")).alias("n_words"), (F.col("c.no") + 2 == F.size("starts")).alias("ends"))
    placed = written(placed, "placed")
    first = placed.groupBy("digest").agg(F.min(F.struct("doc_id", "seq", "no")).alias("first"))
    other = F.col("first.seq") != F.col("seq")
    if within:
        other = other | (F.col("first.no") != F.col("no"))
    later = placed.join(first, "digest").where(other)
    in_text = Window.partitionBy("seq").orderBy("no")
    runs = later.withColumn("run", F.col("no") - F.row_number().over(in_text))
    end = F.struct("no", F.col("first.seq").alias("seq"), F.col("first.no").alias("first"))
    spans = runs.groupBy("seq", "doc_id", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"),
        F.count(F.lit(1)).alias("n_chunks"), F.array_sort(F.collect_set("first.doc_id")).alias("first_doc_ids"),
        F.min(end).alias("head"), F.max(end).alias("tail"), F.max("ends").alias("ends"))
    spans = written(spans, "spans")
    enough = (F.col("n_words") >= min_words) | ((F.col("head.no") == 0) & F.col("ends"))
    longer = _long_with_ends(chunks, spans.where(~enough), min_words, min_bytes)
    kept = spans.where(enough).unionByName(spans.where(~enough).join(longer, ["seq", "run"], "left_semi").select(*spans.columns))
    return kept.select("doc_id", "start", "end", "n_words", "n_chunks", "first_doc_ids")
