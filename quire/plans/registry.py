"""Registry shared by the query modules: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.sources.tables import load_table

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
IDS: dict[str, str] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register a query under ``name`` covering SURVEY ``ids``, with its oracle SQL (if any)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        IDS[name] = ids
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    small_files = spark.conf.get("spark.quire.spreadScans", "false") == "true"  # set by bench.py alone
    return load_table(spark, d, name, list(cols) or None, spread_rows=small_files)


# ------------------------------------------------------------------ SQL fragments
# DuckDB spelling of the code-point encoder (quire.functions.ids.codepoint_ids).
def sql_cp(expr: str) -> str:
    return (f"list_transform(regexp_extract_all({expr}, '<\\|im_start\\|>|<\\|im_end\\|>|(?s:.)'), "
            "lambda p: CASE p WHEN '<|im_start|>' THEN 3 WHEN '<|im_end|>' THEN 4 ELSE unicode(p) END)")


def sql_join(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"


def sql_pad(expr: str, n: int, pad: int) -> str:
    return f"list_concat({expr}, list_transform(range({n} - len({expr})), lambda _i: {pad}))"


SQL_CHUNKS = """
chunks AS (
  SELECT doc_id, lang, source, s // 512 AS chunk_id, substring(text, s + 1, 512) AS text
  FROM (SELECT doc_id, lang, source, text, unnest(range(0, length(text), 512)) AS s FROM documents)
)"""
