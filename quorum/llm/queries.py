"""The registered queries of this subpackage: thin calls over whole tables."""

from __future__ import annotations

import public_tokenizers

from quorum.llm import (bpe, chat, decontaminate, licenses, negatives, ngrams, quality, resample, simhash, sitetree,
                        substrings, templates, urlfilter)
from quorum.llm.common import read

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_ngram_trie(spark, sf_dir):
    return ngrams.report(read(spark, sf_dir, "documents"))


def op2_simhash(spark, sf_dir):
    return simhash.report(read(spark, sf_dir, "documents"))


def op3_chat_format(spark, sf_dir):
    return chat.report(chat.with_probe(spark, read(spark, sf_dir, "conversations")))


def op4_substring_dedup(spark, sf_dir):
    return substrings.report(read(spark, sf_dir, "documents"))


def op5_license_scan(spark, sf_dir):
    return licenses.report(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark, sf_dir):
    return quality.report(read(spark, sf_dir, "documents"))


def op7_byte_bpe(spark, sf_dir):
    return bpe.report(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY),
                      public_tokenizers.PATTERN)


def op8_line_templates(spark, sf_dir):
    return templates.report(read(spark, sf_dir, "documents"))


def op9_decontaminate(spark, sf_dir):
    d = decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return decontaminate.digest(d)


def op10_site_tree(spark, sf_dir):
    return sitetree.report(read(spark, sf_dir, "pages"))


def op11_hard_negatives(spark, sf_dir):
    return negatives.report(read(spark, sf_dir, "embeddings"))


def op12_url_filter(spark, sf_dir):
    return urlfilter.report(read(spark, sf_dir, "pages"))


def op13_resample(spark, sf_dir):
    return resample.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_trie, op2_simhash, op3_chat_format, op4_substring_dedup, op5_license_scan, op6_quality_rules,
    op7_byte_bpe, op8_line_templates, op9_decontaminate, op10_site_tree, op11_hard_negatives, op12_url_filter,
    op13_resample)}
