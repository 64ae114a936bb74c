"""The pipeline against a plain version of each stage, and its awkward inputs."""

import random
import re
import zlib
from hashlib import md5

import numpy as np
import pytest

import corpus_pipeline as P
from llm.test_mixing import reshared
from llm.test_ngram_join import brute as components
from llm.test_winnowing import brute as windows
from tillsight.llm import lang_id, mixing
from tillsight.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rnd = random.Random(11)
    vocab = {"en": [f"{a}{b}" for a in ("th", "ing", "wh", "ou") for b in ("e", "at", "on", "er", "is")],
             "de": [f"{a}{b}" for a in ("sch", "ü", "kei", "pf") for b in ("en", "ung", "ä", "t", "ß")]}
    items = [(i, " ".join(rnd.choice(vocab["en"]) + str(rnd.randint(0, 99)) for _ in range(18))) for i in range(5)]
    docs = []
    for i in range(150):
        lang = rnd.choice(["en", "de"])
        words = [rnd.choice(vocab[lang]) + rnd.choice(["", "", "s", "x"]) for _ in range(rnd.randint(3, 120))]
        if i % 6 == 0 and docs:
            words = docs[-1][1].split()
            words[len(words) // 2] = "edited"
        if i % 10 == 1:
            words[1:1] = items[i % 5][1].split()
        docs.append((i, " ".join(words), lang, None if i % 9 == 0 else f"s{i % 4}"))
    docs += [(200, None, "en", "s1"), (201, "", "en", "s1"), (202, "123 456 !!", "en", "s1"), (203, "это русский текст " * 4, None, "s1")]
    return docs, items


def plain_mix(docs):
    """Systematic sampling in ascending order of (size, id), as for sources that fill one slot."""
    sizes, groups = {}, {}
    for d in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or ""))
        sizes[d[3]] = sizes.get(d[3], 0) + n
        groups.setdefault(d[3], []).append((int(n ** 0.5), 0, n, d))
    target, out = reshared(sizes), []
    for s, rows in groups.items():
        key = f"{mixing.SEED}{int(s is None)}{s or ''}"
        u = int(md5(key.encode()).hexdigest()[:8], 16) / 2**32
        rate = target[s] / sizes[s] if sizes[s] else 0
        rows.sort(key=lambda r: (r[2], r[3][0]))

        def taken(u):
            return [min(3, int(rate * k + u) - int(rate * (k - 1) + u)) for k in range(1, len(rows) + 1)]

        offsets = [u + j / mixing.OFFSETS - int(u + j / mixing.OFFSETS) for j in range(mixing.OFFSETS)]
        best = min(offsets, key=lambda u: abs(sum(n * r[2] for n, r in zip(taken(u), rows)) - target[s]))
        for n, (*_, d) in zip(taken(best), rows):
            out += [d] * n
    return out


def test_stages_match_a_plain_version(spark, make_docs, tmp_path, clashing):
    from tokenizers import Tokenizer
    docs, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = make_docs(docs)
    df.write.parquet(str(tmp_path / "documents.parquet"))

    def after(name, frame):
        out = dict(P.STAGES)[name](spark, frame, str(tmp_path))
        assert out.columns == COLUMNS
        return sorted((r.doc_id, r.text, r.lang, r.source) for r in out.collect())

    model = lang_id.fit(df)
    left = [d for d in docs if not model.predict(d[1])[2]]
    assert after("language", df) == left == docs[:150]

    first = {i for i, _, c in components([d[:2] for d in left]) if i == c}
    assert 100 < len(first) < len(left)
    near = after("near_copies", make_docs(left))
    left = [d for d in left if d[0] in first]
    assert near == left

    hit = {r[0] for r in windows([d[:2] for d in left], items) if r[-1]}
    assert hit
    clean = after("decontaminate", make_docs(left))
    left = [d for d in left if d[0] not in hit]
    assert clean == left

    mixed = after("mix", make_docs(left))
    left = sorted(plain_mix(left), key=lambda d: d[0])
    assert [d[0] for d in mixed] == [d[0] for d in left]

    whole = Tokenizer.from_file(tokenizer_path())
    want, at = [], 0
    for d in left:
        ids = whole.encode(d[1], add_special_tokens=False).ids + [2]
        want.append((d[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in P.run(spark, str(tmp_path)).collect())
    assert got == want


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_take_awkward_and_empty_docs(spark, awkward, clashing, tmp_path, name):
    spark.createDataFrame([(1, "zz yy")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage, docs = dict(P.STAGES)[name], clashing(awkward)
    out = stage(spark, docs, str(tmp_path))
    assert name == "tokens" or out.columns == docs.columns
    out.collect()
    assert stage(spark, docs.where("false"), str(tmp_path)).collect() == []


def test_registered():
    import __spark_entry__ as E
    names = list(E.queries())
    assert [n for n in names if re.match(r"op\d+_", n)] == sorted((n for n in names if re.match(r"op\d+_", n)), key=lambda n: int(n[2:].split("_")[0]))
    assert {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
