"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palisade.llm import byte_pairs, exact_dedup, html_extract, licenses, mixing, near_dedup, packing, prefix_trie, quality, sharding, substring_dedup, token_transducer, whitening
from palisade.session import ship


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_hash_tree_sharding": sharding.op1,
        "op2_odd_sketch_near_dedup": near_dedup.op2,
        "op3_html_extraction": html_extract.op3,
        "op4_token_transducer": token_transducer.op4,
        "op5_pareto_mixing": mixing.op5,
        "op6_perplexity_quality": quality.op6,
        "op7_license_join": licenses.op7,
        "op8_substring_dedup": substring_dedup.op8,
        "op9_exact_dedup": exact_dedup.op9,
        "op10_best_fit_packing": packing.op10,
        "op11_rank_queue_bpe": byte_pairs.op11,
        "op12_conversation_trie": prefix_trie.op12,
        "op13_embedding_whitening": whitening.op13,
        "pipeline": _pipeline,
    }
    return {name: _shipped(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op9_exact_dedup": exact_dedup.OP9_SQL, "op12_conversation_trie": prefix_trie.OP12_SQL}
