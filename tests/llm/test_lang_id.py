import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.llm.lang_id import DIM, fit, language_report, ngram_counts, of_known_language, spherical_kmeans

VOCAB = {"en": "the of and thing reason was that with house river from".split(), "de": "der die und nicht haus fluß ein schön mit über".split(),
         "fr": "le la et maison rivière est où avec été dans".split()}


@pytest.fixture(scope="module")
def corpus(make_docs):
    rnd = random.Random(2)
    rows = []
    for i in range(600):
        lang = rnd.choice(list(VOCAB))
        rows.append((i, " ".join(rnd.choice(VOCAB[lang]) for _ in range(rnd.randint(4, 80))), lang, "s"))
    return make_docs(rows + [(9000, None, "en", "s"), (9001, "12 !!", "en", "s"), (9002, "これは日本語の文章です。" * 5, None, "s")], 4)


def test_held_out_accuracy_and_unknown(corpus):
    rows = language_report(corpus).join(corpus.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == 603
    held = [r for r in rows if r.held_out and r.doc_id < 9000]
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    by_id = {r.doc_id: r for r in rows}
    assert by_id[9000].lang_pred == by_id[9001].lang_pred == "und" and by_id[9000].score == 0
    assert by_id[9002].rejected and by_id[9002].lang_pred in VOCAB
    assert all(0 <= r.score <= 1 for r in rows)
    assert not any(r.rejected for r in rows if r.doc_id < 9000)


def test_never_learns_from_held_out_rows(corpus):
    changed = corpus.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit("xx")).otherwise(F.col("lang")))
    assert "xx" not in fit(changed).languages
    assert np.allclose(fit(changed).centroids, fit(corpus).centroids)


def test_sample_is_bounded_and_fit_does_not_depend_on_partitions(corpus):
    one, two = fit(corpus, per_language=50), fit(corpus.repartition(9), per_language=50)
    assert one.languages == two.languages and np.allclose(one.centroids, two.centroids)
    assert all(one.languages.count(x) <= 4 for x in VOCAB)


def test_counts_cover_whole_texts():
    a, b = "abc " * 10, "xyz " * 10
    assert np.array_equal(ngram_counts(a + b), ngram_counts((a + b).upper()))
    assert ngram_counts(a * 200_000).sum() == pytest.approx(200_000 * 10 * 12, rel=0.01)
    assert ngram_counts("...") is None and ngram_counts(None) is None and len(ngram_counts("a")) == DIM


def test_kmeans_finds_clusters():
    rng = np.random.default_rng(0)
    rows = np.abs(np.concatenate([rng.normal(c, 0.01, (20, 3)) for c in np.eye(3)]))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    assert sorted(np.argmax(spherical_kmeans(rows, 3), axis=1)) == [0, 1, 2]


def test_filter_keeps_whole_rows(corpus, clashing):
    docs = clashing(corpus)
    kept = of_known_language(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(600))


def test_awkward_rows(awkward, clashing):
    assert language_report(clashing(awkward)).count() == awkward.count()
    assert language_report(awkward.where("false")).collect() == []
    assert {r.lang_pred for r in language_report(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


UNLEARNED = {"fi": "ja talo joki kaunis yli syy oli että kanssa mistä ei se", "tr": "ve ev nehir güzel değil ile neden bir bu şey için çok",
             "pl": "i dom rzeka piękny nie przez powód był że skąd się jest"}


def test_far_latin_texts_of_any_length_are_rejected(corpus):
    rnd = random.Random(3)
    model = fit(corpus)
    for n in (20, 200, 2000):
        for lang, text in UNLEARNED.items():
            assert model.predict(" ".join(rnd.choices(text.split(), k=n)))[2], (lang, n)
        letters = (" ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9))) for _ in range(n)))
        assert model.predict(letters)[2] and model.predict(base64.b64encode(rnd.randbytes(5 * n)).decode())[2], n
        for lang, vocab in VOCAB.items():
            assert model.predict(" ".join(rnd.choices(vocab, k=n)))[::2] == (lang, False)
