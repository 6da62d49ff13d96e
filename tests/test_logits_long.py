"""Long tables and shards of logits against the array forms."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import logits as L
from quire.operators import logits_long as LL


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = [(i, rnd.randrange(40), [rnd.choice([0.0, 1.0, rnd.gauss(0, 50)]) for _ in range(40)]) for i in range(60)]
    return spark.createDataFrame(data + [(99, 3, [2.0] * 40)], "row long, target int, logits array<double>")


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_equal_the_array_form(rows, shards):
    got = {r.row: r for r in LL.sharded_cross_entropy(LL.split_logits(rows, ["row", "target"], shards), ["row"]).collect()}
    want = rows.select("row", L.logsumexp("logits").alias("l"), L.cross_entropy("logits", "target", F.lit(-1)).alias("x")).collect()
    assert len(got) == len(want)
    for r in want:
        assert got[r.row].logsumexp == pytest.approx(r.l, abs=1e-9) and got[r.row].xent == pytest.approx(r.x, abs=1e-9)


def test_shards_of_a_long_table_masked_parts_and_absent_targets(spark, rows):
    long = LL.explode_logits(rows, ["row", "target"])
    got = {r.row: r.logsumexp for r in LL.sharded_cross_entropy(LL.long_to_shards(long, ["row", "target"], 16), ["row"]).collect()}
    want = {r.row: r.l for r in rows.select("row", L.logsumexp("logits").alias("l")).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    inf = float("-inf")
    df = spark.createDataFrame([(1, 9, 0, [inf, inf]), (1, 9, 2, [0.0, inf])], "row long, target int, first_token int, part array<double>")
    r = LL.sharded_cross_entropy(df, ["row"]).first()
    assert r.logsumexp == 0.0 and r.xent is None
    assert LL.sharded_cross_entropy(df, ["row"], ignore=F.lit(9)).first().xent == 0.0


def test_topk_keeps_ties_and_is_limited_before_the_shuffle(rows):
    top = LL.topk_long(LL.explode_logits(rows, ["row"]), ["row"], 5)
    got = {}
    for r in top.collect():
        got.setdefault(r.row, set()).add(r.token)
    kept = rows.select("row", L.topk_filter("logits", 5).alias("f")).collect()
    assert got == {r.row: {i for i, x in enumerate(r.f) if x > -math.inf} for r in kept}
    assert len(got[99]) == 40
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")


@pytest.mark.parametrize("block,top_k", [(1, None), (16, 10), (4096, 3)])
def test_draws_equal_the_array_form(rows, block, top_k):
    got = {r.row: r.pick for r in LL.sample_long(LL.explode_logits(rows, ["row"]), ["row"], 20.0, top_k, 7, "row", 2, block).collect()}
    want = {r.row: r.p for r in rows.select("row", L.seeded_sample("logits", 20.0, top_k, 7, F.col("row"), 2).alias("p")).collect()}
    assert got == want
