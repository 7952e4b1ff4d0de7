"""The training-data queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from . import chat, decontaminate, hmm, language, licenses, lines, mixing, negatives, pii, repeats, simhash, topk, whitening
from .common import table

QUERIES = {
    "op1_hmm": lambda spark, d: hmm.op1_hmm(table(spark, d, "documents")),
    "op2_language": lambda spark, d: language.op2_language(table(spark, d, "documents")),
    "op3_mix": lambda spark, d: mixing.op3_mix(table(spark, d, "documents")),
    "op4_chat": lambda spark, d: chat.op4_chat(table(spark, d, "conversations")),
    "op5_topk": lambda spark, d: topk.op5_topk(table(spark, d, "embeddings")),
    "op6_licenses": lambda spark, d: licenses.op6_licenses(table(spark, d, "documents")),
    "op7_decontaminate": lambda spark, d: decontaminate.op7_decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op8_simhash": lambda spark, d: simhash.op8_simhash(table(spark, d, "documents")),
    "op9_pii": lambda spark, d: pii.op9_pii(table(spark, d, "documents")),
    "op10_repeats": lambda spark, d: repeats.op10_repeats(table(spark, d, "documents")),
    "op11_negatives": lambda spark, d: negatives.op11_negatives(table(spark, d, "embeddings")),
    "op12_lines": lambda spark, d: lines.op12_lines(table(spark, d, "documents")),
    "op13_whitening": lambda spark, d: whitening.op13_whitening(table(spark, d, "embeddings")),
}
ORACLE_SQL = {"op3_mix": mixing.OP3_SQL, "op5_topk": topk.OP5_SQL, "op6_licenses": licenses.oracle(), "op11_negatives": negatives.OP11_SQL, "op12_lines": lines.OP12_SQL}
