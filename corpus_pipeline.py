"""Corpus pipeline: documents -> language -> one of each near-copy group -> no
benchmark passages -> mixed sources -> token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``; the last returns, per document of the mix in ascending
doc_id order, what is read back from the token files.

Every stage gives an empty result for empty docs; what it does with nulls, ties
and repeated rows is stated in its operator's docstring.
"""

from __future__ import annotations

from tillsight.llm import lang_id, mixing, ngram_join, token_store, winnowing
from tillsight.llm.common import table, written
from tillsight.llm.queries import tokenizer_path


def language(spark, docs, sf_dir):
    """Rows whose text is near a learned language; texts without letters or far from all go."""
    return lang_id.of_known_language(docs)


def near_copies(spark, docs, sf_dir):
    """One row of each group of linked texts: that with the smallest doc_id."""
    return ngram_join.one_of_each(docs)


def decontaminate(spark, docs, sf_dir):
    """Rows without a window of a benchmark item."""
    return winnowing.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark, docs, sf_dir):
    """Rows as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def tokens(spark, docs, sf_dir):
    """Token files of the mix, and doc_id, start, n_tokens and ids_crc32 as read back from them."""
    return token_store.token_report(docs, tokenizer_path())


STAGES = [("language", language), ("near_copies", near_copies), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: Clustering and byte-pair merges are beyond SQL: tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
