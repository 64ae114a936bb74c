"""Registered corpus queries: name -> (spark, sf_dir) -> DataFrame, and their DuckDB oracles."""

from __future__ import annotations

from tillsight.llm import (
    chunk_dedup, collocations, exact_dedup, html_extract, lang_id, mixing, ngram_join, secret_links, sharding, token_store, winnowing,
)
from tillsight.llm.collocations import op13_collocations
from tillsight.llm.common import table
from tillsight.llm.periodic_runs import op12_periodic_runs
from tillsight.llm.pii_bootstrap import op11_context_bootstrap


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public tokenizers keep ``name``."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_token_store(spark, sf_dir):
    return token_store.token_report(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_credential_links(spark, sf_dir):
    return secret_links.secret_report(table(spark, sf_dir, "documents"), gaps=True)


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_report(table(spark, sf_dir, "documents"))


def op4_subsequence_text(spark, sf_dir):
    return html_extract.main_text_report(table(spark, sf_dir, "pages"))


def op5_nearest_centroid(spark, sf_dir):
    return lang_id.language_report(table(spark, sf_dir, "documents"))


def op6_winnowing(spark, sf_dir):
    return winnowing.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_extendible_shards(spark, sf_dir):
    return sharding.sharded_documents(table(spark, sf_dir, "documents"))


def op8_gear_chunks(spark, sf_dir):
    return chunk_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op9_count_vector_join(spark, sf_dir):
    return ngram_join.component_report(table(spark, sf_dir, "documents"))


def op10_systematic_mix(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_store, op2_credential_links, op3_exact_dedup, op4_subsequence_text, op5_nearest_centroid, op6_winnowing, op7_extendible_shards, op8_gear_chunks,
                                   op9_count_vector_join, op10_systematic_mix, op11_context_bootstrap, op12_periodic_runs, op13_collocations)}

ORACLE = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op6_winnowing": winnowing.SQL,
    "op7_extendible_shards": sharding.SQL,
    "op10_systematic_mix": mixing.SQL,
    "op13_collocations": collocations.SQL,
}
