"""The queries of this subpackage: (spark, folder of tables) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers

from latticework.llm.ann import nearest
from latticework.llm.bpe import bpe_digests
from latticework.llm.grid_join import near_duplicates
from latticework.llm.jaccard_join import jaccard_classes
from latticework.llm.packing import pack_documents
from latticework.llm.pii import pii_spans
from latticework.llm.prefix_trie import prefix_trie
from latticework.llm.quality_model import quality
from latticework.llm.quality_rules import line_rules
from latticework.llm.repair import repair
from latticework.llm.sql import JACCARD, LINE_RULES
from latticework.llm.suffix_dedup import repeat_digests
from latticework.llm.token_counts import token_counts
from latticework.llm.toxicity import toxicity


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pattern_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_line_rules(spark, sf_dir):
    return line_rules(table(spark, sf_dir, "documents")).drop("cleaned")


def op5_suffix_dedup(spark, sf_dir):
    return repeat_digests(table(spark, sf_dir, "documents"), length=100)


def op6_revealing_terms(spark, sf_dir):
    return pii_spans(table(spark, sf_dir, "documents"), classes=True)


def op7_quality_model(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe_codec(spark, sf_dir):
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents"), width=4, percent=85)


def op10_score_aware_search(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_structure_repair(spark, sf_dir):
    return repair(table(spark, sf_dir, "conversations"))


def op13_grid_order_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_toxicity, op3_pattern_packing, op4_line_rules, op5_suffix_dedup, op6_revealing_terms, op7_quality_model, op8_bpe_codec, op9_jaccard_join, op10_score_aware_search, op11_prefix_trie, op12_structure_repair, op13_grid_order_join)}
SQL = {"op4_line_rules": LINE_RULES, "op9_jaccard_join": JACCARD}
