"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from panweave.llm import chat, embed, langid, minhash, mixing, negatives, packing, periodic, quality, rules, secrets, sharding, topk

QUERIES = {
    "op1_embedding_neardup": embed.query,
    "op2_minhash_neardup": minhash.query,
    "op3_best_fit_packing": packing.query,
    "op4_quality_classifier": quality.query,
    "op5_language_id": langid.query,
    "op6_sharding": sharding.query,
    "op7_mixing": mixing.query,
    "op8_secret_scans": secrets.query,
    "op9_quality_rules": rules.query,
    "op10_chat_formatting": chat.query,
    "op11_hard_negatives": negatives.query,
    "op12_periodic_runs": periodic.query,
    "op13_exact_topk": topk.query,
}
ORACLES = {
    "op1_embedding_neardup": embed.ORACLE_SQL,
    "op2_minhash_neardup": minhash.ORACLE_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
    "op8_secret_scans": secrets.ORACLE_SQL,
    "op9_quality_rules": rules.ORACLE_SQL,
    "op10_chat_formatting": chat.ORACLE_SQL,
    "op11_hard_negatives": negatives.ORACLE_SQL,
    "op12_periodic_runs": periodic.ORACLE_SQL,
    "op13_exact_topk": topk.ORACLE_SQL,
}
