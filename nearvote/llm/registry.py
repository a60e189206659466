"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from nearvote.llm import align, bpe, chat, cotraining, exact_dedup, fingerprints, minhash, mixing, negatives, secrets, token_files, toxicity, word_table

QUERIES = {
    "op1_chat_tree": chat.op1_chat_tree,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_minhash": minhash.op6_minhash,
    "op7_quality": cotraining.op7_quality,
    "op8_token_files": token_files.op8_token_files,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_secret_ledger": secrets.op10_secret_ledger,
    "op11_word_table": word_table.op11_word_table,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_alignment": align.op13_alignment,
}

ORACLE_SQL = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
}
