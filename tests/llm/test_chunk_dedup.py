import random

import numpy as np

from tillsight.llm.chunk_dedup import GEAR, LEAST, MOST, cut_points, gear_hash, repeated_spans, shared_size, text_chunks

LETTERS = "abcdefghijklmnopqrstuvwxyzäß日"


def words(rnd, n):
    return " ".join("".join(rnd.choice(LETTERS) for _ in range(rnd.randint(2, 9))) for _ in range(n))


def test_gear_hash_is_the_rolling_form():
    data = np.random.default_rng(0).integers(0, 256, 500).astype(np.uint8)
    h, rolled = 0, []
    for b in data:
        h = ((h << 1) + int(GEAR[b])) & 0xFFFF
        rolled.append(h)
    assert gear_hash(data).tolist() == rolled


def test_chunks_cover_the_text_within_bounds():
    rnd = random.Random(0)
    for text in (words(rnd, 400), "a" * 5000, "ab " * 900, "x", words(rnd, 3)):
        data = np.frombuffer(text.encode(), np.uint8)
        cuts = cut_points(data)
        sizes = np.diff([0, *cuts])
        assert cuts[-1] == len(data) and sizes.max() <= MOST and (sizes[:-1] >= LEAST).all()
        digests, starts, n_words = text_chunks(text)
        assert len(digests) == len(cuts) == len(n_words) and starts[-1] == len(text) and n_words.sum() == len(text.split())


def test_insertions_do_not_shift_chunks():
    rnd = random.Random(3)
    text = words(rnd, 2000)
    old = set(text_chunks(text)[0].tolist())
    new = text_chunks("inserted words " + text[:5000] + "more " + text[5000:])[0].tolist()
    assert sum(d in old for d in new) > 0.97 * len(new)


def brute(docs, least):
    first, out, seen = {}, [], {i: text_chunks(t) for i, t in docs if t}
    for i in sorted(seen):
        for k, d in enumerate(seen[i][0].tolist()):
            first.setdefault(d, (i, k))
    for i, (digests, starts, n_words) in seen.items():
        run = []
        for k, d in enumerate([*digests.tolist(), None]):
            if d is not None and first[d][0] != i:
                run.append((k, first[d][0]))
                continue
            if run and (n := int(sum(n_words[q] for q, _ in run))) >= least:
                out.append((i, int(starts[run[0][0]]), int(starts[run[-1][0] + 1]), n, len(run), tuple(sorted({f for _, f in run}))))
            run = []
    return sorted(out)


def test_matches_brute_force_and_finds_planted_passages(make_docs):
    rnd = random.Random(5)
    passages = [words(rnd, 60) for _ in range(4)]
    docs = []
    for i in range(60):
        text = words(rnd, rnd.randint(20, 200))
        if i % 3 == 0:
            at = rnd.randint(0, len(text))
            text = text[:at] + " " + passages[i % 4] + " " + text[at:]
        docs.append((i, text if i % 20 else "same line " * 80))
    got = repeated_spans(make_docs(docs)).collect()
    assert sorted((r.doc_id, r.start, r.end, r.n_words, r.n_chunks, tuple(r.first_doc_ids)) for r in got) == brute(docs, 10)
    touched = {r.doc_id for r in got} | {i for r in got for i in r.first_doc_ids}
    assert touched >= {i for i in range(60) if i % 3 == 0 or i % 20 == 0}
    assert not touched & {i for i in range(60) if i % 3 and i % 20}
    text = dict(docs)
    assert all(r.n_words <= len(text[r.doc_id][r.start:r.end].split()) + 1 for r in got)


def test_repeats_within_a_row(make_docs):
    rnd = random.Random(9)
    part = words(rnd, 80)
    docs = make_docs([(1, part + " " + words(rnd, 30) + " " + part), (2, words(rnd, 50))])
    assert repeated_spans(docs).collect() == []
    assert {r.doc_id for r in repeated_spans(docs, within=True).collect()} == {1}


def test_awkward_rows(awkward, clashing):
    got = repeated_spans(clashing(awkward)).collect()
    assert {(r.doc_id, tuple(r.first_doc_ids)) for r in got} <= {(i, (f,)) for i in (1, 2, 9) for f in (None, 8)} | {(1, ()), (2, ())}  # the copies with a null id come first
    assert any(r.doc_id == 9 and r.n_words == 60_000 for r in got)
    assert repeated_spans(awkward.where("false")).collect() == []


def test_text_without_spaces_and_short_whole_copies(make_docs):
    rnd = random.Random(4)

    def unspaced(n):
        return "".join(chr(rnd.randint(0x4E00, 0x9000)) for _ in range(n))

    whole, part, line = unspaced(5000), unspaced(120), "x".join(str(rnd.random()) for _ in range(40))
    docs = [(1, whole), (2, whole), (3, unspaced(300) + part + unspaced(200)), (4, unspaced(90) + part + unspaced(100)),
            (5, line), (6, "z" + line + "z"), (7, "two words"), (8, "two words"), (9, "other words")]
    got = {r.doc_id: r for r in repeated_spans(make_docs(docs)).collect()}
    assert set(got) == {2, 4, 6, 8}
    assert (got[2].start, got[2].end) == (0, 5000) and (got[8].start, got[8].end, got[8].n_words) == (0, 9, 2)
    assert 90 <= got[4].start < got[4].end <= 210 and got[4].first_doc_ids == [3]


def test_the_bar_sees_the_whole_shared_passage(make_docs):
    """Every passage of 51 one-letter words that shares a chunk is reported, however few words the chunk has."""
    rnd = random.Random(12)
    docs, want, few = [], set(), 0
    for i in range(0, 600, 2):
        passage = " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(51))
        a, b = (words(rnd, 40) + " " + passage + " " + words(rnd, 40) for _ in range(2))
        docs += [(i, a), (i + 1, b)]
        first = set(text_chunks(a)[0].tolist())
        digests, _, n_words = text_chunks(b)
        shared = [int(n) for d, n in zip(digests.tolist(), n_words) if d in first]
        if shared:
            want.add(i + 1)
            few += sum(shared) < 10
    assert few > 0
    assert {r.doc_id for r in repeated_spans(make_docs(docs)).collect()} == want


def test_size_of_what_is_shared_beyond_a_run():
    assert shared_size("xx one two ", "yy one two ", ".three four", ".three five") == (3, 16)  # " one two " and "three f"
    assert shared_size("", "abc", "a", "a") == (0, 0) and shared_size("日本", "木本", "語日", "語日") == (0, 6)
    assert shared_size("ab", "ab", "x", "y") == (1, 2)
