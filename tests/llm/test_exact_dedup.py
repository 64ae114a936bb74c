import hashlib
from collections import defaultdict

from tillsight.llm.exact_dedup import exact_groups, exact_report


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        out += [(i, best, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_awkward_rows_match_brute_force(awkward, clashing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = exact_report(clashing(awkward)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
    kept = [r.text_sha256 for r in got if r.kept]
    assert sorted(kept) == sorted({hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows})


def test_equal_prefix_and_length_are_not_enough(make_docs):
    long = "p" * 300
    docs = make_docs([(1, long + "a"), (2, long + "b"), (3, long + "a")])
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_groups(docs).collect()} == {(1, 3, False), (2, 2, True), (3, 3, True)}


def test_empty_table(make_docs):
    assert exact_report(make_docs([(1, "a")]).where("false")).collect() == []
