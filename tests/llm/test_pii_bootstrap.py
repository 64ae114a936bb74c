import hashlib
import random
import re
from collections import defaultdict

import pytest

from tillsight.llm.pii_bootstrap import pii_report

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
KINDS = list(BASE)
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     ")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else True,
            "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def base_of(text):
    return sorted((m.start(), i, m.end()) for i, k in enumerate(KINDS) for m in re.finditer(BASE[k], text) if good(k, m.group()))


def trim(t):
    return re.sub(r"[\"')>\]},.;:!?]+$", "", re.sub(r"^[\"'(<\[{]+", "", t))


def tokens(text):
    return [(m.start(), m.group()) for m in re.finditer(r"[^ ]+", text.translate(LOW))]


def patterns_at(toks, i):
    out = [toks[i - 1][1]] if i else []
    return out + ([toks[i - 2][1] + " " + toks[i - 1][1]] if i > 1 else [])


def brute(docs, least=3, share=50, trust=700, rounds=3):
    copies = defaultdict(int)
    for _, t in docs:
        copies[t or ""] += 1
    spans = {t: base_of(t) for t in copies}
    seeds, seed_tokens, occurs, total = defaultdict(set), defaultdict(set), defaultdict(int), defaultdict(int)
    follow = defaultdict(set)
    for t, n in copies.items():
        toks = tokens(t)
        place = {}
        for i, (s, w) in enumerate(toks):
            for j in range(len(re.match(r"[\"'(<\[{]*", w).group()) + 1):
                place[s + j] = i
            for p in patterns_at(toks, i):
                total[p] += n
                follow[p].add(w)
        last = {}
        for s, k, e in spans[t]:
            pass
        # Contexts don't reach over the previous match of the kind's pattern, whether it was valid or not.
        for k, kind in enumerate(KINDS):
            edge = 0
            for m in re.finditer(BASE[kind], t):
                s, e = m.span()
                if kind == "card" and not 14 <= len(re.sub("[^0-9]", "", m.group())) <= 19:
                    continue
                before, edge = edge, e
                if not good(kind, m.group()) or s not in place:
                    continue
                i = place[s]
                if s == before and before:
                    continue
                for back, p in enumerate(patterns_at(toks, i), 1):
                    first = toks[i - back][0]
                    if first < before or (before and first == before) or s - first > 79 + (before == 0 and s <= 80):
                        continue
                    low = m.group().translate(LOW)
                    seeds[p, k].add(low)
                    seed_tokens[p].add(toks[i][1])
                    occurs[p] += n
    worth = {p for p in total if any(len(seeds[p, k]) >= least for k in range(4)) and occurs[p] * 100 >= total[p] * share}
    edges = {p: {(i, k) for k in range(4) for i in seeds[p, k]} | {(trim(w), None) for w in follow[p] - seed_tokens[p] if trim(w)} for p in worth}
    sizes = {p: len({i for i, _ in edges[p]}) for p in worth}
    given = {}
    for r in range(rounds):
        conf = {}
        for p in worth:
            for k in range(4):
                scores = [1000 for i, x in edges[p] if x == k] + [given[i, k, p] for i, x in edges[p] if x is None and given.get((i, k, p))]
                c = sum(scores) // sizes[p]
                if c >= trust and len(scores) >= least:
                    conf[p, k] = c
        if r + 1 < rounds:
            given = {}
            for p in worth:
                for i, x in edges[p]:
                    if x is None:
                        for k in range(4):
                            others = [conf[q, k] for q in worth if q != p and (q, k) in conf and (i, None) in edges[q]]
                            if others:
                                given[i, k, p] = max(others)
    kind_of = {}
    for (p, k), c in conf.items():
        for i, x in edges[p]:
            if x is None and len(i) >= 5 and re.search("[0-9@]", i):
                kind_of[i] = min(kind_of.get(i, (0, 9)), (-c, k))
    trusted = {p for p, _ in conf}
    out = []
    for doc_id, t in docs:
        t = t or ""
        toks, found = tokens(t), set()
        for i, (s, w) in enumerate(toks):
            x = trim(w)
            if x in kind_of and any(p in trusted and (x, None) in edges[p] for p in patterns_at(toks, i)):
                s += len(w) - len(re.sub(r"^[\"'(<\[{]+", "", w))
                if not any(a < s + len(x) and s < e for a, _, e in spans[t]):
                    found.add((s, kind_of[x][1] + 4, s + len(x)))
        names = KINDS + ["like_" + k for k in KINDS]
        show = lambda rows: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(rows))
        counts = [sum(k == i for _, k, _ in spans[t]) for i in range(4)]
        out.append((doc_id, *counts, hashlib.sha256(show(spans[t]).encode()).hexdigest(), show(set(spans[t]) | found), len(found)))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    words = ["of", "the", "Line", "x", "über", "日本", "call", "and."]
    docs = []
    for i in range(260):
        parts = [rnd.choice(words) for _ in range(rnd.randrange(3, 9))]
        kind = rnd.choice([0, 0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 7])
        mail, phone = f"u{rnd.randrange(10**4)}.x@mail{i % 7}.example.com", f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}"
        parts += {0: ["write", "E-mail:", mail], 1: ["my", "phone", "number:", phone], 2: ["at", "host", f"10.0.{i % 300}.{rnd.randrange(300)}", "up"],
                  3: ["write", "E-mail:", f"u{i}[at]mail{i % 3}.org,"], 4: ["Pay", "card", rnd.choice(["4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559"])],
                  5: ["at", "host", f"<fe80::{i}>"], 6: ["no", mail + "'s"], 7: ["the", "host", "is", str(rnd.randrange(10**6))]}[kind]
        if rnd.random() < 0.05:
            parts += ["e-mail:", f"u{rnd.choice([3, 11, i])}[at]mail{i % 3}.org"]
        docs.append((i, rnd.choice([" ", "  ", "\n"]).join(parts) + rnd.choice(["", ".", " ", " end of it"])))
    return docs + [(500, docs[3][1]), (501, docs[3][1]), (502, None), (503, ""), (None, docs[5][1])]


EDGES = [
    "a@b.c_x@d.e", "x@a.b.c@d.e.f", "@a.b", "a@b", "a@b.", "a.@-.-", "..@a.b..c", "1.2.3.4.5.6.7.8", "01.002.0003.000255 1.2.3.256 256.1.1.1",
    "1.2.3 4.5.6.7", "4111 1111 1111 1111", "4111  1111 1111 1111", "41111111111111114111111111111111", "5 4111111111111111", "4111-1111-1111-1111-2",
    "+1 (743) 555-3824 ", "+1((((", "++1 23456789012", "+123456789+1234567890", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "tel:+49 30 1234567.", "0" * 30,
    "é@é.de ü.a@b-c.d 日本1.1.1.1日本", "a@b.c,a@b.c\n1.1.1.1", "1-2-3-4-5-6-7-8-9-0-1-2-3-4", "Σ" * 50 + " +1 2223334444 x"]


def test_base_spans_of_odd_texts(spark, make_docs):
    docs = list(enumerate(EDGES))
    got = {r["doc_id"]: r for r in pii_report(make_docs(docs)).collect()}
    for i, text in docs:
        expected = base_of(text)
        joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in expected)
        assert got[i]["spans"] == joined, text
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(x[1] == n for x in expected) for n in range(4)]


@pytest.mark.parametrize("seed", range(3))
def test_bootstrap_matches_brute_force(spark, make_docs, seed):
    docs = corpus(seed)
    got = sorted((tuple(r) for r in pii_report(make_docs(docs)).collect()), key=repr)
    expected = sorted(brute(docs), key=repr)
    assert got == expected
    # The contexts lead to addresses of a form that no pattern of the base knows.
    assert any("like_email" in r[6] for r in got)


def test_contexts_of_ordinary_words_lead_to_nothing(spark, make_docs):
    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choice(["of", "the", "in", "1984a", "x77y9z", f"u{i}@m.org"]) for _ in range(40))) for i in range(60)]
    assert all(r["n_learned"] == 0 for r in pii_report(make_docs(docs)).collect())


def test_awkward_rows(spark, make_docs, awkward, clashing):
    got = pii_report(clashing(awkward)).collect()
    assert len(got) == awkward.count() and all(r["spans"] == "" for r in got)
    assert pii_report(awkward.limit(0)).collect() == []
    long_texts = ["x" * 300_000, "1" * 300_000, "a." * 150_000, "a@" + "b." * 150_000, "+" * 300_000, "+1" + "(" * 300_000, "1 " * 150_000, "u@m.org " * 30_000]
    rows = pii_report(make_docs(list(enumerate(long_texts)))).collect()
    assert sorted((r["doc_id"], r["n_email"]) for r in rows if r["n_email"]) == [(3, 1), (7, 30_000)]
