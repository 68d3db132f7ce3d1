"""The registered queries of the subpackage, and their SQL where SQL can express them."""
from . import chat, decontam, embed, langid, lmscore, mixing, simhash, substring, suffix, warc

_ALL = {
    "op1_suffix_dedup": suffix, "op2_warc": warc, "op3_chat_format": chat, "op4_embedding_dedup": embed,
    "op5_decontaminate": decontam, "op6_mix_sources": mixing, "op7_substring_dedup": substring,
    "op8_lm_score": lmscore, "op9_language_id": langid, "op10_simhash": simhash,
}


def queries():
    import corpus_pipeline

    return {name: m.query for name, m in _ALL.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return {name: m.SQL for name, m in _ALL.items() if m.SQL}
