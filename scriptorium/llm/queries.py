"""The queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import bytebpe, decontaminate, licences, minhash, repeats, secrets, sharding, tokenids, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontaminate.op1_decontamination,
        "op2_token_ids": tokenids.op2_token_ids,
        "op3_minhash": minhash.op3_minhash,
        "op4_byte_bpe": bytebpe.op4_byte_bpe,
        "op5_suffix_dedup": repeats.op5_suffix_dedup,
        "op6_secrets": secrets.op6_secrets,
        "op7_licences": licences.op7_licences,
        "op8_topk": topk.op8_topk,
        "op9_sharding": sharding.op9_sharding,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {k: s for m in (bytebpe, decontaminate, licences, minhash, repeats, secrets, sharding, tokenids, topk, toxicity) for k, s in m.ORACLE_SQL.items()}
