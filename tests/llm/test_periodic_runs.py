import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from tillsight.llm.periodic_runs import lag_scan, periodic_runs, run_report, runs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    """Every stretch by every period, without splitting; a stretch's smallest period alone counts."""
    seen = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                seen.setdefault((s, i - s + q), q)
    return sorted(((s, n, q) for (s, n), q in seen.items()), key=lambda r: (r[0], r[2]))


def plain_report(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def noisy(rnd):
    out = []
    for _ in range(rnd.randrange(1, 5)):
        out += [rnd.choice("abcdefghij") for _ in range(rnd.randrange(0, 12))]
        part = [rnd.choice("abc") for _ in range(rnd.randrange(1, 6))]
        out += (part * rnd.randrange(1, 9))[:rnd.randrange(1, 40)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_words(seed):
    rnd = random.Random(seed)
    texts = [noisy(rnd) for _ in range(150)] + [[], ["a"], ["a"] * 6, ["a"] * 5, ["a", "b"] * 4, ["a", "b"] * 3]
    texts += [[rnd.choice("ab") for _ in range(200)] for _ in range(20)]
    got = runs_of([[x.encode() for x in t] for t in texts])
    assert got == [plain_runs(t) for t in texts]


def test_documents_match_plain_version(spark, make_docs):
    rnd = random.Random(7)
    docs = [(i, " ".join(noisy(rnd)) if i % 3 else "\n".join(rnd.choice(["x", "yy", "Ü"]) + " " for _ in range(60)))
            for i in range(120)] + [(1000, None), (1001, ""), (1002, " \t\n"), (None, "a " * 9), (-5, "b c " * 8), (3, "a " * 9), (3, "a " * 9)]
    # ids whose text the contract loops are among them
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(120))
    got = run_report(make_docs(docs)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted((plain_report(*d) for d in docs), key=repr)


def test_collapsed_text_and_awkward_rows(spark, make_docs, awkward, clashing):
    got = {r["doc_id"]: r for r in periodic_runs(clashing(make_docs([(1, "go go go go go go on"), (2, "x y x y x y x y z")]))).collect()}
    assert got[1]["collapsed"] == "go on" and [tuple(r) for r in got[1]["runs"]] == [(0, 6, 1)]
    assert got[2]["collapsed"] == "x y z" and [tuple(r) for r in got[2]["runs"]] == [(0, 8, 2)]
    report = run_report(clashing(awkward)).collect()
    assert len(report) == awkward.count()
    long_text = next(r for r in report if r["doc_id"] == 9)
    assert (long_text["n_runs"], long_text["start"], long_text["length"], long_text["period"]) == (1, 0, 60_000, 1)
    assert run_report(awkward.limit(0)).collect() == []


def test_long_segments_take_near_linear_time():
    rnd = np.random.default_rng(1)

    def took(n):
        text = np.concatenate([rnd.integers(0, 3, n // 2), np.tile(rnd.integers(0, 3, n // 40), 20)]).astype(np.int64)
        began = time.perf_counter()
        assert (n // 2 >= 0) and any(q == n // 40 for _, _, q in lag_scan(text))
        return time.perf_counter() - began

    took(4_000)
    assert took(100_000) < 40 * max(took(10_000), 0.05)
