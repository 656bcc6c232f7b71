"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from boxloom.llm import chat, jaccard, language, licenses, mixing, packing, quality, sharding, topk, warc


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_warc_archive": warc.op1_warc_archive,
        "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
        "op3_exact_topk": topk.op3_exact_topk,
        "op4_language_id": language.op4_language_id,
        "op5_histogram_shards": sharding.op5_histogram_shards,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_source_mix": mixing.op7_source_mix,
        "op8_license_scan": licenses.op8_license_scan,
        "op9_retrieval_pack": packing.op9_retrieval_pack,
        "op10_chat_prefix_tree": chat.op10_chat_prefix_tree,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_archive": warc.SQL, "op2_ngram_jaccard": jaccard.SQL, "op3_exact_topk": topk.SQL, "op6_quality_rules": quality.SQL, "op10_chat_prefix_tree": chat.SQL}
