"""The training-data queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import cascade, chat, curriculum, kneser_ney, langid, line_runs, minhash, mtree, positional, surrogates

QUERIES = {
    "op1_mtree_topk": mtree.op1_mtree_topk,
    "op2_line_dedup": line_runs.op2_line_dedup,
    "op3_lm_score": kneser_ney.op3_lm_score,
    "op4_decontaminate": positional.op4_decontaminate,
    "op5_language_id": langid.op5_language_id,
    "op6_minhash": minhash.op6_minhash,
    "op7_url_filter": cascade.op7_url_filter,
    "op8_mixing": curriculum.op8_mixing,
    "op9_pii_surrogates": surrogates.op9_pii_surrogates,
    "op10_chat": chat.op10_chat,
}
ORACLE_SQL = {
    "op1_mtree_topk": mtree.SQL,
    "op2_line_dedup": line_runs.SQL,
    "op4_decontaminate": positional.SQL,
    "op6_minhash": minhash.SQL,
    "op7_url_filter": cascade.SQL,
    "op8_mixing": curriculum.SQL,
    "op10_chat": chat.SQL,
}
