import random
import re

import numpy as np
import pytest

from tillsight.llm import ngram_join as N
from tillsight.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(ASCII))
    n = min(5, len(w))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def components(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = components(ids, links)
    return sorted((i, len(sets[i]), comp[i]) for i in ids)


def corpus(seed):
    """Groups of near copies, chains of ever more edits, shared passages, short and odd texts."""
    rnd = random.Random(seed)

    def text(n):
        return [f"w{rnd.randint(0, 400)}" for _ in range(n)]
    docs, passage = [], text(25)
    for _ in range(6):
        base = text(rnd.choice([8, 30, 120]))
        for _ in range(rnd.randint(1, 12)):
            words = list(base)
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = f"e{rnd.randint(0, 10**6)}"
            docs.append(" ".join(words))
        for _ in range(5):  # a chain: each is near the one before
            base = list(base)
            base[rnd.randrange(len(base))] = f"c{rnd.randint(0, 10**6)}"
            docs.append("\n".join(base).upper())
    docs += [" ".join(text(10) + passage + text(rnd.randint(0, 9))) for _ in range(15)]
    docs += ["", None, "a", "A", "a b", "a b c d", "a b c d e", "É é", "é é", " a\tb ", "x " * 50, "x " * 3000]
    rnd.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", range(2))
def test_components_match_brute_force(make_docs, seed, monkeypatch):
    if seed == 1:  # pages of several trees, salted pages, and many segments to a text
        monkeypatch.setattr(N, "SALT_ROWS", 2)
        monkeypatch.setattr(N, "SEGMENT", 64)
    docs = corpus(seed)
    got = N.component_report(make_docs(docs), **({"tree_rows": 3} if seed else {})).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(docs)


def test_tree_joins_what_pairs_would(monkeypatch):
    rnd = np.random.default_rng(4)
    for _ in range(20):
        members = []
        for i in range(rnd.integers(1, 120)):
            s = np.unique(rnd.integers(0, 2**63, rnd.integers(1, 60)).astype(np.uint64))
            if members and rnd.random() < 0.6:
                s = np.unique(np.append(sets[rnd.integers(len(sets))], s[:2]))
            sets = [*sets, s] if i else [s]
            members.append((i, int(rnd.integers(0, 5)), len(s), N.point_of(s)))
        tree = N.tree_of(members)
        got = list(N.tree_pairs(tree, tree))
        assert len(got) == len(set(got))
        want = {(a[0], b[0]) for a in members for b in members if a[0] < b[0] and a[1] != b[1]
                and 4 * min(a[2], b[2]) >= 3 * max(a[2], b[2]) and N.bound_passes(a[3], b[3], a[2], b[2])}
        assert set(got) == want
        linked = {(a[0], b[0]) for a in members for b in members if a[0] < b[0] and a[1] != b[1]
                  and 175 * len(np.intersect1d(sets[a[0]], sets[b[0]])) >= 75 * (a[2] + b[2])}
        assert linked <= want


def test_point_bound_is_an_upper_bound():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rnd.integers(0, 300, rnd.integers(1, 200)).astype(np.uint64)) for _ in range(2))
        a, b = N._mix(a), N._mix(b)
        p, q = N.point_of(a), N.point_of(b)
        g = min(len(p), len(q))
        assert np.minimum(N.folded(p, g), N.folded(q, g)).sum() >= len(np.intersect1d(a, b))


def test_segments_do_not_change_hashes(monkeypatch):
    text = "Some words, ÄÖ of a\ttext " * 50 + "x" * 500
    whole = N.word_hashes(text)
    monkeypatch.setattr(N, "SEGMENT", 7)
    assert N.word_hashes(text).tolist() == whole.tolist() and len(whole) == len(text.split())


@pytest.mark.parametrize("n", [0, 1, 40])
def test_connected_components(spark, n):
    rnd = random.Random(n)
    links = [(rnd.randint(-99, 99), rnd.randint(-99, 99)) for _ in range(n)] + [(i, i + 1) for i in range(1000, 1000 + n)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for link in links for x in link}
    want = components(nodes, links)
    assert got == {x: want[x] for x in nodes if any(x in link and link[0] != link[1] for link in links)}


def test_one_row_of_each_component_stays(make_docs, clashing):
    docs = corpus(7)
    df = clashing(make_docs(docs + docs[:20]))
    kept = N.one_of_each(df)
    assert kept.columns == df.columns
    doubles = {i for i, t in docs[:20] if not shingles(t)}  # rows without words all stay
    want = sorted([i for i, n, c in brute(docs) if i == c] + list(doubles))
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_awkward_rows(awkward, clashing):
    got = N.component_report(clashing(awkward)).collect()
    assert len(got) == awkward.count()
    found = {(r.doc_id, r.component_id) for r in got}
    assert {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 6), (8, 8), (9, 8), (10, 10), (11, 11), (None, 1), (None, None)} == found
    assert N.component_report(awkward.where("false")).collect() == []
    assert N.one_of_each(clashing(awkward)).count() == 9


def test_unlinked_texts_of_a_shared_passage_stay_few_rows(make_docs, monkeypatch):
    """Texts that share a passage but do not link meet in large pages; what leaves a page is links alone."""
    rnd = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [(i, passage + " " + " ".join(f"w{rnd.randrange(10**9)}" for _ in range(8))) for i in range(1200)]
    docs += [(5000 + i, docs[i][1] + " end") for i in range(5)]
    made, page_links = [], N._page_links

    def counted(pages, percent):
        out = page_links(pages, percent)
        made.append(out.count())
        return out

    monkeypatch.setattr(N, "_page_links", counted)
    got = {r["doc_id"]: r["component_id"] for r in N.component_report(make_docs(docs)).collect()}
    assert got == {i: i - 5000 if i >= 5000 else i for i, _ in docs}
    assert sum(made) <= 1205


def test_order_tells_rare_shingles_in_a_large_corpus(make_docs):
    """Among two million other shingles, those that three texts share open no page while they have rarer ones."""
    passage = " ".join(f"p{i}" for i in range(200))
    docs = [(i, " ".join(f"w{i}x{k}" for k in range(800)) + " " + passage) for i in range(3)]
    docs += [(10 + i, " ".join(f"o{i}x{k}" for k in range(40_000))) for i in range(50)]
    texts = N._texts(make_docs(docs))
    counts = N.group_counts(texts, N.SHINGLE)
    assert counts.sum() == 3 * 996 + 50 * 39_996
    rows = N._points(texts.where("doc_id < 3"), counts, N.SHINGLE, N.PERCENT).select("n", "prefix").collect()
    assert {r["n"] for r in rows} == {996} and {len(r["prefix"]) for r in rows} == {996 - 747 + 1}
    assert len({h for r in rows for h in r["prefix"]}) == 3 * 250
