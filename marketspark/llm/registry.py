"""Queries of this subpackage and, where SQL can express them, their SQL."""

from marketspark.llm import bpe, chat, decontaminate, grammars, lm, periods, pii, search, sharding, simhash, suffixes, toxicity, whitening

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_chat": chat.query,
    "op3_bpe": bpe.query,
    "op4_sharding": sharding.query,
    "op5_suffixes": suffixes.query,
    "op6_lm": lm.query,
    "op7_decontaminate": decontaminate.query,
    "op8_search": search.query,
    "op9_toxicity": toxicity.query,
    "op10_pii": pii.query,
    "op11_secrets": grammars.query,
    "op12_runs": periods.query,
    "op13_whitening": whitening.query,
}
ORACLES: dict[str, str] = {"op2_chat": chat.ORACLE, "op8_search": search.ORACLE, "op12_runs": periods.ORACLE}
