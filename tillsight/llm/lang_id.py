"""Language ID by nearest centroid.

A text becomes a vector of hashed character 1- to 3-grams (letters in lower case,
everything between words one space), weighted by TF-IDF and normalised. Each
language has several centroids, clustered by spherical k-means from a bounded
sample of its labelled texts. A text gets the language of the centroid with the
highest cosine; below that centroid's bound for texts of its length it is rejected.
The bounds are learned from the cosines of the sample.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import written

#: Hash buckets of n-grams.
DIM = 1 << 13
#: Labelled rows per language that the classifier is fitted on, about (chosen by hash).
SAMPLE_PER_LANGUAGE = 1_000
#: Centroids per language, and k-means rounds.
CENTROIDS, ROUNDS = 4, 8
#: Least cosine of a text that is not rejected, whatever was learned.
LEAST_COSINE = 0.1
#: A centroid's bound: this quantile of the cosines of the sample's texts nearest to it, times this margin.
BOUND_QUANTILE, BOUND_MARGIN = 0.01, 0.6
#: Texts that a quantile is taken of, at least: with fewer those of the language's centroids are taken together.
BOUND_ROWS = 50
#: Length classes of bounds (cosines rise with length): class i has texts of 2**i letters and spaces or more.
LENGTHS = 21
#: The label of texts without letters.
UNKNOWN = "und"
#: Code points that are turned into n-grams at a time (a longer text takes several turns).
CHUNK = 1 << 20

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter (made once per worker)."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed 1- to 3-grams, over the whole text; None without a letter."""
    total, found, is_letter = np.zeros(DIM), False, letters()
    text = text or ""
    for at in range(0, len(text), CHUNK):
        code = np.frombuffer(text[at:at + CHUNK].lower().encode("utf-32-le", "replace"), dtype="<u4")
        letter = is_letter[code]
        if not letter.any():
            continue
        found = True
        code = np.where(letter, code, 32).astype(np.uint64)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # of a run without letters its first place stays, as a space
        code = np.concatenate([[np.uint64(32)], code[keep], [np.uint64(32)]])
        gram = np.zeros(len(code), dtype=np.uint64)
        for n in range(3):
            gram = gram[:len(code) - n] * _FACTORS[n] + code[n:] + np.uint64(n + 1)
            total += np.bincount((gram * _FACTORS[0]) >> np.uint64(51), minlength=DIM)
    return total if found else None


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=-1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def spherical_kmeans(rows: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows; starts from the mean's nearest row and the farthest after it."""
    first = rows[np.argmax(rows @ _unit(rows.mean(axis=0)))]
    centers = [first]
    nearest = rows @ first
    while len(centers) < min(k, len(rows)) and nearest.min() < 1 - 1e-6:
        centers.append(rows[np.argmin(nearest)])
        nearest = np.maximum(nearest, rows @ centers[-1])
    centers = np.array(centers)
    for _ in range(rounds):
        own = np.argmax(rows @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, rows)
        centers = np.where((np.bincount(own, minlength=len(centers)) > 0)[:, None], _unit(sums), centers)
    return centers


def length_class(counts: np.ndarray) -> int:
    """The class of a text by its n-grams, of which it has three per letter or space."""
    return min(int(np.log2(max(counts.sum() / 3, 1))), LENGTHS - 1)


class Model:
    """``languages[i]`` is the language of centroid ``i``; ``idf`` weighs the counts; ``bounds[i, j]`` is
    the least cosine of a text of length class ``j`` that centroid ``i`` does not reject (``least`` if not given)."""

    def __init__(self, languages: list[str], centroids: np.ndarray, idf: np.ndarray, least: float,
                 bounds: np.ndarray | None = None):
        self.languages, self.centroids, self.idf, self.least = languages, centroids.astype(np.float32), idf, least
        self.bounds = np.full((len(languages), LENGTHS), least) if bounds is None else bounds

    def nearest(self, counts: np.ndarray) -> tuple[int, float]:
        """(centroid, cosine in 0 to 1)."""
        vector = _unit(np.log1p(counts) * self.idf).astype(np.float32)
        cosines = self.centroids @ vector
        best = int(np.argmax(cosines))
        return best, float(min(max(cosines[best], 0.0), 1.0))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine in 0 to 1, rejected)."""
        counts = ngram_counts(text)
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, True
        best, score = self.nearest(counts)
        return self.languages[best], score, bool(score < self.bounds[best, length_class(counts)])


def learned_bounds(model: Model, sample: DataFrame) -> np.ndarray:
    """The bounds of ``model`` from the texts of ``sample`` and their beginnings of 8, 16, 32 ... code points.

    With too few texts of a class near a centroid, all near its language's count; with
    too few of these the bound of the next shorter class holds, so that a text longer
    than all of the sample is held to no more than they are. The driver receives two
    quantiles per centroid and class.
    """
    def cosines(frames):
        for frame in frames:
            made = []
            for text in frame["text"]:
                sizes = [1 << i for i in range(3, LENGTHS) if 1 << i < len(text)]
                for part in [text[:n] for n in sizes] + [text]:
                    if (counts := ngram_counts(part)) is not None:
                        no, cosine = model.nearest(counts)
                        made.append((no, model.languages[no], length_class(counts), cosine))
            yield pd.DataFrame(made, columns=["no", "lang", "size", "cosine"])

    near = written(sample.select("text").mapInPandas(cosines, "no int, lang string, size int, cosine double"), "lang-cosines")
    low = {}
    for by in ("no", "lang"):
        found = near.groupBy(by, "size").agg(F.percentile("cosine", F.lit(BOUND_QUANTILE)).alias("low"), F.count(F.lit(1)).alias("n"))
        low.update({(r[by], r["size"]): r["low"] for r in found.where(F.col("n") >= BOUND_ROWS).collect()})
    bounds = np.full((len(model.languages), LENGTHS), model.least)
    for no, lang in enumerate(model.languages):
        for size in range(LENGTHS):
            shorter = bounds[no, size - 1] if size else model.least
            least = low.get((no, size), low.get((lang, size)))
            bounds[no, size] = shorter if least is None else max(model.least, BOUND_MARGIN * least)
    return bounds


def held_out() -> Column:
    """Whether a row is never learned from: crc32 of its id as text leaves 2 modulo 4 (null id: not held out)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, k: int = CENTROIDS,
        least: float = LEAST_COSINE) -> Model:
    """Learn from the rows that are not held out and have a language.

    The sample is bounded (``per_language``, chosen by hash of id and text); the
    driver receives one count per language, one partial count vector per file of
    the sample, and ``k`` centroids per language.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((0, DIM)), np.ones(DIM), least)
    bar = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    sample = labelled.where(draw < F.element_at(bar, F.col("lang"))).select("lang", "text")

    def vectors(frames):
        for frame in frames:
            made = [(lang, c, text) for lang, text in zip(frame["lang"], frame["text"]) if (c := ngram_counts(text)) is not None]
            yield pd.DataFrame({"lang": [m[0] for m in made], "counts": [m[1].astype("<f4").tobytes() for m in made],
                                "text": [m[2] for m in made]})

    sample = written(sample.mapInPandas(vectors, "lang string, counts binary, text string"), "lang-sample")

    def frequencies(frames):
        df, n = np.zeros(DIM), 0
        for frame in frames:
            n += len(frame)
            for c in frame["counts"]:
                df += np.frombuffer(c, "<f4") > 0
        yield pd.DataFrame({"n": [n], "df": [df.tolist()]})

    parts = sample.select("counts").mapInPandas(frequencies, "n long, df array<double>").collect()
    idf = np.log((1 + sum(p["n"] for p in parts)) / (1 + np.sum([p["df"] for p in parts], axis=0))) + 1

    def clustered(frame):
        rows = np.stack([np.frombuffer(c, "<f4") for c in sorted(frame["counts"])]).astype(np.float64)
        centers = spherical_kmeans(_unit(np.log1p(rows) * idf), k)
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "no": range(len(centers)),
                             "centroid": [c.tolist() for c in centers]})

    found = sample.select("lang", "counts").groupBy("lang").applyInPandas(clustered, "lang string, no int, centroid array<double>").collect()
    found = sorted(found, key=lambda r: (r["lang"], r["no"]))
    model = Model([r["lang"] for r in found], np.array([r["centroid"] for r in found]).reshape(-1, DIM), idf, least)
    model.bounds = learned_bounds(model, sample)
    return model


def predicted(model: Model, text: str = "text") -> Column:
    """struct(lang_pred, score, rejected) of the text column."""
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])
    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "lang_pred string, score double, rejected boolean")(F.col(text))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row.

    Defined results: a null text or one without a letter is ``und`` with score 0
    and rejected; a far text keeps its nearest language but is rejected; equal
    cosines give the first language by name; an empty table gives no rows.
    """
    model = fit(docs.select("doc_id", "text", "lang"))
    return docs.select("doc_id", held_out().alias("held_out"), predicted(model).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def of_known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    model = fit(docs.select("doc_id", "text", "lang"))
    return docs.where(~predicted(model)["rejected"])
