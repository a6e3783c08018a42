"""Registered queries of the training-data operators: each runs over the whole of its tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from gavilla.llm import (
    chat, decontaminate, extraction, language, licences, quality, simhash, tokens, toxicity, trie, urls, warc, whitening,
)
from gavilla.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_quality_rules(spark, sf):
    return quality.verdicts(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op2_benchmark_decontamination(spark, sf):
    """(doc_id, item_id) of documents that hold a benchmark passage."""
    return decontaminate.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op3_html_extraction(spark, sf):
    return extraction.page_texts(table(spark, sf, "pages"))


def op4_byte_bpe(spark, sf):
    return tokens.token_digests(table(spark, sf, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_chat_quotations(spark, sf):
    return chat.reply_ordered(table(spark, sf, "conversations"))


def op6_simhash_near_dedup(spark, sf):
    near = simhash.near_copies(table(spark, sf, "documents"))
    return near.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_url_filter(spark, sf):
    return urls.verdicts(table(spark, sf, "pages"))


def op8_license_scan(spark, sf):
    return licences.licence_labels(table(spark, sf, "documents"))


def op9_toxicity(spark, sf):
    return toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op10_warc_bundles(spark, sf):
    return warc.round_trip(table(spark, sf, "pages"))


def op11_embedding_whitening(spark, sf):
    return whitening.whitened_rows(table(spark, sf, "embeddings"))


def op12_language_id(spark, sf):
    return language.identify(table(spark, sf, "documents"))


def op13_prefix_trie(spark, sf):
    return trie.prefix_trie(table(spark, sf, "conversations"))


QUERIES = [
    op1_quality_rules, op2_benchmark_decontamination, op3_html_extraction, op4_byte_bpe, op5_chat_quotations,
    op6_simhash_near_dedup, op7_url_filter, op8_license_scan, op9_toxicity, op10_warc_bundles,
    op11_embedding_whitening, op12_language_id, op13_prefix_trie,
]


def queries():
    return {query.__name__: query for query in QUERIES}
