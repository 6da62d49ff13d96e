"""Driver contract, oracle agreement on the smallest data set, and plan shape."""

import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"

def _oracle_names():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    return sorted(E.oracle_sql())


ORACLE_ALL = _oracle_names()


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_contract(spark):
    import __spark_entry__ as E
    out = E.entry(spark)
    assert set(out.columns) >= {"lang", "n_rows", "sum_text_len"} and out.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 70


@pytest.mark.parametrize("name", ORACLE_ALL)
def test_oracle_sample(spark, name):
    import duckdb
    from oracle_check import TABLES, norm
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    srows = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    assert Counter(tuple(norm(r[i]) for i in idx) for r in rel.fetchall()) == srows


def test_row_builders_are_one_narrow_stage(spark):
    from pyspark.sql import functions as F
    from quire.functions import ids as I
    from quire.operators import reshape as R
    from quire.operators import rows as B
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = B.pretrain_rows(R.chunk_text(docs), "text", I.codepoint_ids, 512, keep=["doc_id", "chunk_id"])
    p = plan_text(rows)
    assert "Exchange" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_scan_prunes_columns_and_pushes_filters(spark):
    from pyspark.sql import functions as F
    from quire.sources.tables import load_table
    df = load_table(spark, SF, "documents", ["doc_id", "text", "lang"], spread_rows=False).filter(F.col("lang") == "en")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in p
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in p


def test_global_index_has_no_single_partition_over_rows(spark):
    from quire.operators import split as S
    df = spark.range(1000).withColumnRenamed("id", "k")
    out = S.with_global_index(df, ["k"], "idx", num_partitions=4)
    p = plan_text(out)
    # the data rows come from the range-partitioned checkpoint; only the tiny
    # per-partition count table is windowed in one partition
    assert "BroadcastHashJoin" in p
    assert out.agg({"idx": "max"}).first()[0] == 999
