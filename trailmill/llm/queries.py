"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import conversations, decontam, langid, lexical, lm_score, mixing, neardup_vectors, pieces, pii, sharding, simhash, training_order, warc


def queries() -> dict:
    return {
        "op1_benchmark_decontamination": decontam.op1_benchmark_decontamination,
        "op2_embedding_near_dedup": neardup_vectors.op2_embedding_near_dedup,
        "op3_sharding": sharding.op3_sharding,
        "op4_training_order": training_order.op4_training_order,
        "op5_warc": warc.op5_warc,
        "op6_pii": pii.op6_pii,
        "op7_language_id": langid.op7_language_id,
        "op8_sentencepiece": pieces.op8_sentencepiece,
        "op9_lm_score": lm_score.op9_lm_score,
        "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
        "op11_conversation_repair": conversations.op11_conversation_repair,
        "op12_lexical_search": lexical.op12_lexical_search,
        "op13_mixing": mixing.op13_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_benchmark_decontamination": decontam.SQL, "op2_embedding_near_dedup": neardup_vectors.SQL, "op5_warc": warc.SQL, "op9_lm_score": lm_score.SQL, "op12_lexical_search": lexical.SQL, "op13_mixing": mixing.SQL}
