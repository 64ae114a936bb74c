import os
import random
import re
from collections import Counter

import pytest

from tillsight.llm.collocations import collocations, windows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, top=2000):
    """The contract by n-grams of every length, in Python's integers."""
    count, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    count[lang, tuple(w[i:i + k])] += 1
    found = {p: a for p, a in count.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in found.items():
        if any(la == lang and len(lw) > len(w) and 100 * b >= 80 * a and any(lw[i:i + len(w)] == w for i in range(len(lw)))
               for (la, lw), b in found.items()):
            continue
        cuts = [(2000000 * a // (count[lang, w[:k]] + count[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, count[lang, w[:k]], count[lang, w[k:]], n[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:top]
        ranked += [(o[0], i + 1, *o[1:]) for i, o in enumerate(own)]
    return sorted(ranked)


def rows_of(seed):
    rnd = random.Random(seed)
    vocab = ["the", "The", "of", "new", "york", "city", "élan", "Élan", "x", "日本", "a-b"]
    phrases = ["new york", "new york city", "Of the new york city", "x x x x x x", "日本 élan"]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rnd.randrange(0, 14)):
            parts.append(rnd.choice(phrases) if rnd.random() < 0.4 else rnd.choice(vocab))
            parts.append(rnd.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "; ", "\r\n", "\x0b"]))
        rows.append(("".join(parts), rnd.choice(["en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), (" .,; ", "fr"), ("one two three", "fr")]


@pytest.mark.parametrize("seed, least, top, slices", [(0, 30, 2000, 4), (1, 5, 2000, 1), (2, 3, 7, 3), (3, 2, 40, 2)])
def test_matches_plain_ngrams(spark, seed, least, top, slices):
    rows = rows_of(seed)
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    got = collocations(docs, least=least, top=top, slices=slices).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, least, top)


def test_awkward_rows(spark, awkward, clashing):
    rows = [(r["text"], r["lang"]) for r in awkward.collect()]
    got = collocations(clashing(awkward), slices=2).collect()
    assert sorted(tuple(r) for r in got) == plain(rows)
    assert {r["phrase"] for r in got} == {"wörd wörd wörd wörd"}  # a phrase of four holds its parts
    assert collocations(awkward.limit(0), slices=1).collect() == []


@pytest.mark.parametrize("size", [1, 7, 60, 10_000])
def test_windows_across_segments(spark, size):
    """However small the segments that are counted at once, each word gives its whole window."""
    rows = rows_of(9)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    found, expected = Counter(), Counter()
    for part in range(2):
        for r in windows(docs, part, 2, size).collect():
            found[tuple(r)[:5]] += r["n"]
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece) + [None] * 3
            for i in range(len(w) - 3):
                expected[("und" if lang is None else lang, *w[i:i + 4])] += 1
    assert found == expected


def test_shuffles_end_with_their_pass(spark):
    """Nothing of a pass is left in the shuffle folders when the next one begins; the setting is put back."""
    from tillsight.llm.common import shuffles_released, table, written
    from tillsight.llm.collocations import windows

    def blocks():
        """Bytes of shuffle files below the folders of this application."""
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return sum(os.path.getsize(os.path.join(at, f)) for folder in folders for at, _, files in os.walk(folder.getPath())
                   for f in files if f.startswith("shuffle_"))

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, dealt = spark.conf.get(setting), windows(table(spark, "/root/testdata/sf0.001", "documents"), 0, 1).repartition("w1")
    start = blocks()
    with shuffles_released(spark):
        kept = written(dealt, "released")
        assert blocks() <= start
    assert spark.conf.get(setting) == was and kept.count() > 0
    written(dealt, "held")
    assert blocks() > start


def test_windows_are_read_once_in_a_pass(spark, monkeypatch):
    """The phrases of every length come from one shuffle of the windows, and no row is copied for each prefix."""
    from tillsight.llm import collocations as module
    plans, written = [], module.written

    def kept(df, tag):
        plans.append(df._jdf.queryExecution().toString())
        return written(df, tag)

    monkeypatch.setattr(module, "written", kept)
    rows = rows_of(4)
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    found = {(r["lang"], r["phrase"]): r["f"] for r in module._slice_counts(docs, 5, 0, 1).where("words > 0").collect()}
    expected = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            expected.update(("und" if lang is None else lang, " ".join(w[i:j])) for i in range(len(w)) for j in range(i + 1, min(len(w), i + 4) + 1))
    assert found == {p: f for p, f in expected.items() if f >= 5}
    physical = plans[0].split("== Physical Plan ==")[1]
    assert physical.count("MapInArrow") == 1 and "Expand" not in physical


def test_slices_part_the_words():
    import numpy as np
    import pyarrow as pa
    from tillsight.llm.collocations import slices_of
    words = pa.array([b"\xff", *[f"w{i}".encode() for i in range(3000)], b"x" * 5000], pa.binary())
    found = slices_of(words, 3)
    assert (slices_of(words.slice(7), 3) == found[7:]).all()
    assert np.bincount(found[1:].astype(int), minlength=3).min() > 800
