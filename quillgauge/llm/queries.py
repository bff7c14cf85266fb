"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), shrunk=True)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), "word_bpe_49k.json")


def op3_rotated_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rabitq import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import token_counts

    return token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op6_token_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .idstore import read_store, write_store

    return read_store(write_store(table(spark, sf_dir, "documents"), "byte_bpe_50k.json"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scanned

    return scanned(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades are derived from the two labels: 0 poor, 1 good but toxic, 2 good and clean."""
    from .ordinal import fit, graded

    docs = table(spark, sf_dir, "documents")
    return graded(docs, fit(docs, table(spark, sf_dir, "labels")))


def op10_tool_call_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` has plain dialogues: each user turn is taken as a call of ``reply``, the assistant's next turn as its result."""
    from .chat import REPLY, dialogue, formatted

    return formatted(dialogue(table(spark, sf_dir, "conversations")), {"reply": REPLY})


OP10_SQL = """
WITH ids AS (
  SELECT conv_id, turn, role, text,
         CASE WHEN role = 'user' THEN conv_id || ':' || turn WHEN role = 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id
  FROM conversations),
calls AS (SELECT conv_id, call_id, min(turn) AS call_turn FROM ids WHERE role = 'user' GROUP BY ALL),
answers AS (SELECT DISTINCT conv_id, call_id FROM ids WHERE role = 'assistant')
SELECT i.conv_id, i.turn,
       CASE i.role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
       i.call_id,
       CASE i.role WHEN 'user' THEN a.call_id IS NOT NULL AND i.turn = c.call_turn WHEN 'assistant' THEN c.call_id IS NOT NULL ELSE false END AS linked,
       CASE WHEN i.role = 'user' THEN coalesce(length(i.text) BETWEEN 1 AND 4000, false) AND i.turn >= 0 END AS valid,
       CASE i.role WHEN 'assistant' THEN greatest(i.turn, coalesce(c.call_turn, i.turn)) ELSE i.turn END AS order_turn,
       CASE i.role WHEN 'assistant' THEN 1 ELSE 0 END AS order_kind,
       CASE i.role
         WHEN 'user' THEN '{"role":"assistant","tool_calls":[{"arguments":{"request":' || coalesce(to_json(i.text)::VARCHAR, 'null') || ',"turn":' || i.turn || '},"id":"' || i.call_id || '","name":"reply"}]}'
         WHEN 'assistant' THEN '{"content":' || coalesce(to_json(i.text)::VARCHAR, 'null') || ',"role":"tool","tool_call_id":"' || i.call_id || '"}'
         ELSE '{"content":' || coalesce(to_json(i.text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(i.role)::VARCHAR, 'null') || '}' END AS json
FROM ids i LEFT JOIN calls c USING (conv_id, call_id) LEFT JOIN answers a USING (conv_id, call_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op10_tool_call_chat": OP10_SQL}
