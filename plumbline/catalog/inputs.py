"""Operator inputs derived from the given tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.base import table
from plumbline.operators.audit import rank_hits

NORM = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\\s+', ' ', 'g'))"


def norm_sql(x: str) -> str:
    return NORM.format(x)


def order_hits(spark: SparkSession, sf_dir: str, k: int | None = None) -> DataFrame:
    """An order as a query, its lines as results; lists are cut to ``k`` inside the ranking."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("seq"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("query"),
        F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), F.lit(None))
        .otherwise(F.col("l_partkey").cast("string")).alias("id"),
        F.concat("l_returnflag", F.lit("  "), "l_linestatus", F.lit(" ")).alias("text"),
        F.col("l_discount").alias("score"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return rank_hits(lines, order, k).select("seq", "query", "pos", "id", "text", "score")


ORDER_HITS_SQL = """order_hits AS (
  SELECT l_orderkey AS seq, 'order ' || l_orderkey AS query,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos,
         CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN NULL ELSE CAST(l_partkey AS VARCHAR) END AS id,
         l_returnflag || '  ' || l_linestatus || ' ' AS text, l_discount AS score
  FROM lineitem)"""


def language_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language as a query, its documents as results in id order."""
    return table(spark, sf_dir, "documents").select(
        F.ascii("lang").cast("long").alias("seq"), F.col("lang").alias("query"), F.col("doc_id").alias("pos"),
        F.col("doc_id").cast("string").alias("id"), "text", F.col("n_chars").cast("double").alias("score"),
    )


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``turns(seq, conv_id, turn, role, text)`` with one LONG order over all conversations."""
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1048576 + F.col("turn")).alias("seq"), "conv_id", "turn", "role", "text"
    )


TURNS_SQL = "turns AS (SELECT conv_id * 1048576 + turn AS seq, conv_id, turn, role, text FROM conversations)"
