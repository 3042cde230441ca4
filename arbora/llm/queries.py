"""The queries of this subpackage, by the names under which the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arbora.llm import conversations, decontamination, embeddings, licenses, lines, minhash, mixing, sharding, token_counts, tokens, toxicity, variants, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.op1_warc,
    "op2_licenses": licenses.op2_licenses,
    "op3_token_ids": tokens.op3_token_ids,
    "op4_sharding": sharding.op4_sharding,
    "op5_mixing": mixing.op5_mixing,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_embeddings": embeddings.op8_embeddings,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_minhash": minhash.op10_minhash,
    "op11_spelling": variants.op11_spelling,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.OP1_SQL,
    "op2_licenses": licenses.OP2_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_decontamination": decontamination.OP6_SQL,
    "op7_line_dedup": lines.OP7_SQL,
    "op8_embeddings": embeddings.OP8_SQL,
    "op10_minhash": minhash.OP10_SQL,
    "op11_spelling": variants.OP11_SQL,
    "op13_conversation_repair": conversations.OP13_SQL,
}
