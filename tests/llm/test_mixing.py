from collections import Counter

import pytest

from tillsight.llm.mixing import mix_report, mixed, planned_copies, source_targets


def reshared(sizes, weights=(1, 2, 3), most=3):
    """The contract word for word: share, cap, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else target[s] for s in names}
        capped |= over


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 10, "c": 10}, {"a": 5, "b": 0, "c": 7, None: 3000},
    {"Z": 1, "a": 10**6, "é": 2, "𝄞": 3, None: 4}, {"only": 17}])
def test_targets_match_the_contract(spark, sizes):
    rows = [(int(s is None), s or "", n) for s, n in sizes.items()]
    df = spark.createDataFrame(rows, "no_source int, src string, source_size long")
    got = {None if r.no_source else r.src: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(reshared(sizes))


def corpus(make_docs, n=3000):
    return make_docs([(i, "w " * (1 + i * 7919 % 97), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(n)], 5)


def test_taken_is_near_the_target_and_reruns_agree(make_docs):
    docs = corpus(make_docs)
    one = mix_report(docs).collect()
    two = mix_report(docs.repartition(2)).collect()
    assert sorted(one) == sorted(two)
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target = Counter(), {}
    for r in one:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    assert taken == pytest.approx(target, abs=200)


def test_slots_do_not_change_what_a_source_gives(make_docs):
    docs = corpus(make_docs)
    for slot_rows in (20, 10**6):
        plan = planned_copies(docs, ["doc_id"], rows_per_slot=slot_rows).collect()
        assert len(plan) == 3000
        source = {r.doc_id: r.source for r in docs.collect()}
        taken, target = Counter(), {}
        for r in plan:
            taken[source[r.row.doc_id]] += r.copies * r["size"]
            target[source[r.row.doc_id]] = r.target
        assert taken == pytest.approx(target, abs=200)


def test_mixed_repeats_whole_rows(make_docs, clashing):
    docs = clashing(corpus(make_docs, 300))
    out = mixed(docs)
    assert out.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mix_report(docs).collect()}
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in copies.items() if v})


def test_awkward_rows(awkward, clashing):
    got = mix_report(clashing(awkward)).collect()
    assert len(got) == awkward.count()
    assert all(r.taken == 0 for r in got if r["size"] == 0)
    assert mix_report(awkward.where("false")).collect() == []


def test_a_source_of_few_documents_takes_the_offset_nearest_to_its_target(make_docs):
    sizes = {s: [1 + (i * 37 + k * 101) % 400 for i in range(5 + k)] for k, s in enumerate("abcdefgh")}
    rows = [(f"{s}{i}", s, n) for s, ns in sizes.items() for i, n in enumerate(ns)]
    docs = make_docs([(j, "w " * n, "en", s) for j, (_, s, n) in enumerate(rows)], 3)
    got = mix_report(docs).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[rows[r.doc_id][1]] += r.taken
        target[rows[r.doc_id][1]] = r.target
    for s, ns in sizes.items():
        rate = target[s] / sum(ns)
        ordered = sorted((int(n ** 0.5), n) for n in ns)

        def gap(u):
            copies = [min(3, int(rate * k + u) - int(rate * (k - 1) + u)) for k in range(1, len(ns) + 1)]
            return abs(sum(c * n for c, (_, n) in zip(copies, ordered)) - target[s])

        # Any choice of 32 evenly spaced offsets holds one below each 32nd.
        assert abs(taken[s] - target[s]) <= max(min(gap(j / 32 + e) for j in range(32)) for e in (0.001, 0.01, 0.02, 0.03))
