"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run is a maximal stretch of consecutive words with smallest period q (words q
apart are identical) that holds at least EXPONENT periods and LEAST words. Every
word of a run therefore occurs EXPONENT times in any segment around it, so:

1. words that occur less often than that within their segment split it; the parts
   are segments of their own, in which other words have become rare, and so on until
   no segment splits any more. This goes level by level over all texts of a batch at
   once: one sort of (segment, word) numbers per level, of ever fewer words;
2. a surviving segment of m words is scanned at every lag q up to m / EXPONENT. A run
   of that period spans the multiples of q, so it is enough to compare, at these
   m / q places, numbers that stand for blocks of 2^j <= q words (equal numbers mean
   equal words: ranks, not hashes). Places that agree are extended word by word, so a
   segment costs about m log m, also where a text is one long repetition.

Nothing is cut or capped: every row's whole text is read in the task that holds it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import SPACED_WORD, table, text_of

#: Periods and words of a run, at least.
EXPONENT, LEAST = 4, 6
#: Bytes of text that are split at a time (a longer text is a batch of its own).
BATCH_BYTES = 4 << 20

RUNS = "array<struct<start: long, length: long, period: long>>"


def splits(words: np.ndarray, segment: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[np.ndarray]:
    """Places of the words of every segment that no rare word splits any more.

    ``words`` are numbers, ``segment`` numbers the texts they come from, ascending.
    """
    place = np.arange(len(words))
    spread = int(words.max()) + 1 if len(words) else 1
    while len(place):
        _, which, counts = np.unique(segment * spread + words[place], return_inverse=True, return_counts=True)
        frequent = counts[which] >= exponent
        changed = not frequent.all()
        place, segment = place[frequent], segment[frequent]
        if not len(place):
            break
        # A new segment starts where the text changes or a word has gone.
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (np.diff(segment) != 0)]))
        sizes = np.diff(np.append(starts, len(place)))
        long_enough = np.repeat(sizes >= least, sizes)
        changed |= not long_enough.all()
        segment = np.repeat(np.arange(len(starts)), sizes)[long_enough]
        place = place[long_enough]
        if not changed:
            break
    if not len(place):
        return []
    return np.split(place, np.flatnonzero(np.diff(segment)) + 1)


def _agreement(words: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """[from, to): the places around ``i`` at which words[x] == words[x + q], by doubling steps."""
    lo, step = i, 8
    while lo > 0:
        at = max(0, lo - step)
        differ = np.flatnonzero(words[at:lo] != words[at + q:lo + q])
        if len(differ):
            lo = at + int(differ[-1]) + 1
            break
        lo, step = at, 2 * step
    hi, end, step = i, len(words) - q, 8
    while hi < end:
        to = min(end, hi + step)
        differ = np.flatnonzero(words[hi:to] != words[hi + q:to + q])
        if len(differ):
            hi += int(differ[0])
            break
        hi, step = to, 2 * step
    return lo, hi


def lag_scan(words: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a segment."""
    m, found, spans = len(words), [], set()
    block, size = words, 1
    for q in range(1, m // exponent + 1):
        while 2 * size <= q:
            # Blocks of twice the size get numbers of their own.
            pairs = block[:-size].astype(np.int64) * (int(block.max()) + 1) + block[size:]
            block, size = np.unique(pairs, return_inverse=True)[1], 2 * size
        marks = block[::q]
        past = 0
        for k in np.flatnonzero(marks[1:] == marks[:-1]):
            if k * q < past:
                continue
            lo, hi = _agreement(words, int(k) * q, q)
            past = hi
            length = hi - lo + q
            # A stretch with a smaller period has it as a divisor and was found at that lag.
            if length >= max(least, exponent * q) and (lo, length) not in spans:
                spans.add((lo, length))
                found.append((lo, length, q))
    return found


def runs_of(texts: list[list[bytes]], exponent: int = EXPONENT, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of each text (a list of words), by start and period."""
    numbers: dict[bytes, int] = {}
    words = np.array([numbers.setdefault(w, len(numbers)) for t in texts for w in t], np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for place in splits(words, np.repeat(np.arange(len(texts)), sizes), exponent, least):
        at = int(place[0])
        text = int(np.searchsorted(firsts, at, side="right")) - 1
        out[text] += [(at - int(firsts[text]) + s, n, q) for s, n, q in lag_scan(words[place], exponent, least)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without the repeats: of each run the first period stays."""
    if not runs:
        return b" ".join(words)
    repeat = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        repeat[start + period] += 1
        repeat[start + length] -= 1
    kept = np.cumsum(repeat[:-1]) == 0
    return b" ".join(w for w, k in zip(words, kept) if k)


def periodic_runs(docs: DataFrame, text_col: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """doc_id, runs (start, length, period by start and period) and collapsed (the text without repeats) per row.

    Defined results: a null text counts as empty; a text without words has no runs and
    collapses to ''; repeated rows each give their own row; a null doc_id stays null;
    other columns are not read; an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct(
        [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            ends = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in texts]) // BATCH_BYTES
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
                if not len(part):
                    continue
                words = [(texts[i].as_py() or b"").split() for i in part.tolist()]
                found = runs_of(words, exponent, least)
                rows = pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found], schema.field("runs").type)
                short = pa.array([collapsed(w, r) for w, r in zip(words, found)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids.slice(int(part[0]), len(part)), rows, short], schema=schema)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """``docs`` with the planted loops of the contract: every tenth text repeats a part of itself to its end.

    With h the crc32 of the decimal doc_id and h % 10 = 0, each word from a on becomes
    word a + (i - a) % p. Texts of other ids, of null ids and without words stay.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all("text", F.lit(f"({SPACED_WORD})"), F.lit(1))

    def with_loop(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        loop = F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
        return F.concat(F.slice(w, F.lit(1), a.cast("int")), F.slice(loop, F.lit(1), (n - a).cast("int")))

    chosen = (h % 10 == 0) & F.col("text").rlike(SPACED_WORD)
    return docs.select("doc_id", F.when(chosen, F.array_join(with_loop(words), " ")).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """Per document n_runs, the run with the greatest exponent, and digests of runs and collapsed text."""
    found = periodic_runs(looped(docs))
    # The greatest length / period, exactly; then the smallest start, then the smallest period.
    better = (lambda a, b: (a["length"] * b["period"] > b["length"] * a["period"])
              | ((a["length"] * b["period"] == b["length"] * a["period"])
                 & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"])))))
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)),
                       lambda a, b: F.when(better(b, a), b).otherwise(a))
    line = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_periodic_runs(spark, sf_dir):
    return run_report(table(spark, sf_dir, "documents"))
