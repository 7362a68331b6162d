"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import align, bpe, chat, decontam, elkan, hmm, hnsw, langid, minhash, mixing, quality, toxicity, warc


def queries() -> dict:
    return {
        "op1_embedding_dedup": hnsw.op1_embedding_dedup,
        "op2_minhash": minhash.op2_minhash,
        "op3_hmm_scores": hmm.op3_hmm_scores,
        "op4_quality": quality.op4_quality,
        "op5_language_id": langid.op5_language_id,
        "op6_decontaminate": decontam.op6_decontaminate,
        "op7_token_counts": bpe.op7_token_counts,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_chat_format": chat.op9_chat_format,
        "op10_warc": warc.op10_warc,
        "op11_elkan_clusters": elkan.op11_elkan_clusters,
        "op12_align_tokenizers": align.op12_align_tokenizers,
        "op13_toxicity": toxicity.op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_dedup": hnsw.ORACLE,
        "op2_minhash": minhash.ORACLE,
        "op6_decontaminate": decontam.ORACLE,
        "op8_mix_sources": mixing.ORACLE,
        "op9_chat_format": chat.ORACLE,
        "op10_warc": warc.ORACLE,
        "op11_elkan_clusters": elkan.ORACLE,
    }
