"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veldt.llm import chat, embedding_dup, lines, lm, mixing, near_dup, pieces, quality, secrets, top_products
from veldt.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_minhash_near_dedup": lambda spark, d: near_dup.query(table(spark, d, "documents")),
    "op2_embedding_near_dedup": lambda spark, d: embedding_dup.query(table(spark, d, "embeddings")),
    "op3_exact_top_k": lambda spark, d: top_products.query(table(spark, d, "embeddings")),
    "op4_chat_formatting": lambda spark, d: chat.query(table(spark, d, "conversations")),
    "op5_sentencepiece": lambda spark, d: pieces.query(table(spark, d, "documents")),
    "op6_line_dedup": lambda spark, d: lines.query(table(spark, d, "documents")),
    "op7_quality_classifier": lambda spark, d: quality.query(table(spark, d, "documents"), table(spark, d, "labels")),
    "op8_secret_scans": lambda spark, d: secrets.query(table(spark, d, "documents")),
    "op9_source_mixing": lambda spark, d: mixing.query(table(spark, d, "documents")),
    "op10_lm_scoring": lambda spark, d: lm.query(table(spark, d, "documents")),
}

SQL: dict[str, str] = {
    "op1_minhash_near_dedup": near_dup.SQL,
    "op2_embedding_near_dedup": embedding_dup.SQL,
    "op3_exact_top_k": top_products.SQL,
    "op4_chat_formatting": chat.SQL,
    "op6_line_dedup": lines.SQL,
    "op8_secret_scans": secrets.SQL,
    "op9_source_mixing": mixing.SQL,
}
