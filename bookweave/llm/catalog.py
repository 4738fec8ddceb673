"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bookweave.llm.conversation_repair import op13_conversation_repair
from bookweave.llm.decontamination import op8_benchmark_decontamination
from bookweave.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from bookweave.llm.jaccard_join import op4_ngram_jaccard_join
from bookweave.llm.jaccard_sql import OP4_SQL, OP11_SQL
from bookweave.llm.language_id import op10_language_id
from bookweave.llm.lm_scoring import op3_lm_scoring
from bookweave.llm.lsh_forest import op11_lsh_forest
from bookweave.llm.packing import op2_packing
from bookweave.llm.quality import op9_quality_classifier
from bookweave.llm.secrets import op5_secret_scan
from bookweave.llm.spelling import op12_spelling_variants
from bookweave.llm.token_counts import op7_token_counts
from bookweave.llm.warc import OP1_SQL, op1_warc_revisits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_packing": op2_packing,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_secret_scan": op5_secret_scan,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_language_id": op10_language_id,
    "op11_lsh_forest": op11_lsh_forest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_repair": op13_conversation_repair,
}
SQL: dict[str, str] = {"op1_warc_revisits": OP1_SQL, "op4_ngram_jaccard_join": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op11_lsh_forest": OP11_SQL}
