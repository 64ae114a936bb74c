import hashlib
import random
import re

import pytest

from tillsight.llm.winnowing import decontaminated, decontamination_report

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def corpus(seed):
    """Few different words, so that windows repeat, and items of all lengths, short ones included."""
    rnd = random.Random(seed)
    vocab = ["the", "Élan", "élan", "x1", "ß", "of", "AND", "and", "zz", "日本"]
    items = [(i, " ".join(rnd.choice(vocab[:4 + i % 7]) for _ in range(rnd.choice([0, 2, 7, 9, 10, 11, 25])))) for i in range(12)]
    docs = []
    for i in range(40):
        text = " ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 3, 30, 90])))
        if i % 2:
            text += "; " + rnd.choice(items)[1].upper() + "\n" + text[:20]
        docs.append((i, text))
    return docs + [(90, "the " * 300), (91, None), (92, "")], items + [(50, "the " * 40), (51, None), (52, "!!")]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_matches_brute_force(spark, make_docs, seed, broadcast_rows):
    docs, items = corpus(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination_report(make_docs(docs), bench, broadcast_rows=broadcast_rows).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, items)


def test_filter_keeps_clean_rows_whole(spark, awkward, clashing):
    bench = spark.createDataFrame([(1, "B C D e f g h i j k l m n"), (2, "zz zz")], "item_id long, text string")
    docs = clashing(awkward)
    kept = decontaminated(docs, bench)
    assert kept.columns == docs.columns
    text = "a b c d e f g h i j k l"
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.collect() if r.text != text)


def test_items_without_id_hit_in_the_filter(spark, make_docs):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = make_docs([(1, "before " + passage + " after"), (2, "clean text of some words that no item has at all"), (3, "short one")])
    bench = spark.createDataFrame([(None, passage), (None, "SHORT one")], "item_id long, text string")
    assert [r.doc_id for r in decontaminated(docs, bench).collect()] == [2]
    assert not any(r.contaminated for r in decontamination_report(docs, bench).collect())


def test_no_benchmark_and_no_documents(spark, awkward):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert not any(r.contaminated for r in decontamination_report(awkward, bench.where("false")).collect())
    assert decontamination_report(awkward.where("false"), bench).collect() == []


def test_windows_are_broadcast_by_their_own_number_and_bytes(spark, make_docs):
    """Many windows share the fingerprint of one frequent 5-gram."""
    from pyspark.sql import functions as F

    from tillsight.llm.winnowing import benchmark_windows, contamination
    docs, items = corpus(0)
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = benchmark_windows(bench)
    n, prints = known.count(), known.select("len", "m").distinct().count()
    assert prints < n

    def hinted(**bounds):
        found = contamination(make_docs(docs), bench, {"doc_id": F.col("doc_id")}, **bounds)
        return "strategy=broadcast" in found._jdf.queryExecution().analyzed().toString()

    assert hinted(broadcast_rows=n) and not hinted(broadcast_rows=prints) and not hinted(broadcast_bytes=100)
    got = decontamination_report(make_docs(docs), bench, broadcast_rows=prints).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, items)
