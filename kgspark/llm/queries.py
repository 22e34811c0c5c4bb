"""The queries of the pipeline operators and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgspark.llm import conversation_trie, exact_dedup, hard_negatives, quality_rules
from kgspark.llm.bpe import op10_bpe_chunk_reuse
from kgspark.llm.fingerprints import op2_merkle_fingerprints
from kgspark.llm.jaccard_join import op7_ngram_jaccard_join
from kgspark.llm.license_scan import op5_license_scan
from kgspark.llm.line_dedup import op8_line_dedup
from kgspark.llm.packing import op3_best_fit_packing
from kgspark.llm.quality_crf import op9_quality_crf
from kgspark.llm.secret_scan import op6_secret_scan
from kgspark.llm.suffix_dedup import op4_suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_merkle_fingerprints": op2_merkle_fingerprints,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_crf": op9_quality_crf,
    "op6_secret_scan": op6_secret_scan,
    "op5_license_scan": op5_license_scan,
    "op10_bpe_chunk_reuse": op10_bpe_chunk_reuse,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_conversation_trie": conversation_trie.op12_conversation_trie,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op12_conversation_trie": conversation_trie.SQL,
    "op13_exact_dedup": exact_dedup.SQL,
}
