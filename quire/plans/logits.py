"""Logits operators over ``embeddings``: the 64 floats stand in for one position's
logits and ``label`` for the target id."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import logits as L
from quire.operators import logits as LO
from quire.operators import logits_long as LL
from quire.plans.registry import ORACLES, query, table

_E_SQL = """
WITH e AS (SELECT vec_id, vec_id // 64 AS batch_id, CAST(embedding AS DOUBLE[]) AS l, label AS target FROM embeddings),
z AS (SELECT *, list_max(l) AS m FROM e),
s AS (SELECT *, m + ln(list_sum(list_transform(l, lambda x: exp(x - m)))) AS lse FROM z)
"""


def logit_rows(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    return e.select("vec_id", F.floor(F.col("vec_id") / 64).cast("bigint").alias("batch_id"),
                    F.col("embedding").cast("array<double>").alias("logits"), F.col("label").alias("target"))


@query("softmax", "M-1", _E_SQL + """
SELECT vec_id, round(list_max(list_transform(l, lambda x: exp(x - lse))), 9) AS max_prob,
       round(lse, 9) AS logsumexp, round(l[target + 1] - lse, 9) AS target_logprob
FROM s
""")
def softmax(spark, d):
    r = logit_rows(spark, d).select("vec_id", "target", L.softmax("logits").alias("p"),
                                    L.log_softmax("logits").alias("lp"), L.logsumexp("logits").alias("lse"))
    return r.select("vec_id", F.round(F.array_max("p"), 9).alias("max_prob"), F.round("lse", 9).alias("logsumexp"),
                    F.round(F.get("lp", F.col("target")), 9).alias("target_logprob"))


@query("cross_entropy", "M-2", _E_SQL + """,
b AS (SELECT *, max(CASE WHEN target = -100 THEN 1 ELSE 0 END) OVER (PARTITION BY batch_id) = 1 AS sw FROM s)
SELECT vec_id, batch_id,
       round(CASE WHEN target = CASE WHEN sw THEN -100 ELSE 4 END THEN 0.0 ELSE lse - l[target + 1] END, 9) AS xent
FROM b
""")
def cross_entropy(spark, d):
    x = LO.token_cross_entropy(logit_rows(spark, d), "logits", "target", "batch_id", pad_id=4)
    return x.select("vec_id", "batch_id", F.round("xent", 9).alias("xent"))


@query("mean_cross_entropy", "M-4", _E_SQL + """
SELECT batch_id, round(avg(CASE WHEN target <> -1 THEN lse - l[target + 1] END), 9) AS mean_xent,
       count(CASE WHEN target <> -1 THEN 1 END) AS n_targets
FROM s GROUP BY batch_id
""")
def mean_cross_entropy(spark, d):
    r = logit_rows(spark, d)
    x = r.withColumn("xent", L.cross_entropy("logits", "target", -1))
    m = LO.mean_cross_entropy(x, "xent", "target", -1, ["batch_id"])
    return m.select("batch_id", F.round("mean_xent", 9).alias("mean_xent"), "n_targets")


@query("temperature_greedy", "M-3 W-9", _E_SQL + """
SELECT vec_id, list_position(l, list_max(l)) - 1 AS greedy,
       list_position(list_transform(l, lambda x: x / 0.7), list_max(list_transform(l, lambda x: x / 0.7))) - 1 AS greedy_t
FROM e
""")
def temperature_greedy(spark, d):
    r = logit_rows(spark, d)
    return r.select("vec_id", L.greedy_next("logits").alias("greedy"),
                    L.greedy_next(L.temperature("logits", 0.7)).alias("greedy_t"))


@query("topk_filter", "W-6", _E_SQL + """,
k AS (SELECT *, list_sort(l, 'DESC')[5] AS thr FROM e)
SELECT vec_id, len(list_filter(l, lambda x: x >= thr)) AS n_kept,
       round(list_sum(list_filter(l, lambda x: x >= thr)), 9) AS kept_sum
FROM k
""")
def topk_filter(spark, d):
    r = logit_rows(spark, d).select("vec_id", L.topk_filter("logits", 5).alias("f"))
    kept = F.filter("f", lambda x: x > float("-inf"))
    return r.select("vec_id", F.size(kept).alias("n_kept"), F.round(L.array_sum(kept), 9).alias("kept_sum"))


@query("seeded_sample", "W-10 M-1 M-3 W-6", """
WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / 0.05) AS l FROM embeddings),
k AS (SELECT *, list_sort(l, 'DESC')[10] AS thr, list_max(l) AS m FROM e),
p AS (SELECT vec_id, list_transform(l, lambda x: CASE WHEN x < thr THEN 0.0 ELSE exp(x - m) END) AS w FROM k),
q AS (SELECT vec_id, list_transform(w, lambda x: x / list_sum(w)) AS pr,
             CAST(('0x' || substr(md5('42:' || CAST(vec_id AS VARCHAR) || ':0'), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
      FROM p),
c AS (SELECT vec_id, pr, u, list_transform(range(1, len(pr) + 1), lambda i: list_sum(pr[1:i])) AS cum FROM q)
SELECT vec_id, CAST(list_filter(range(0, len(pr)), lambda i: cum[i + 1] > u * list_sum(pr) AND pr[i + 1] > 0)[1] AS INTEGER) AS pick
FROM c
""")
def seeded_sample(spark, d):
    r = logit_rows(spark, d)
    return r.select("vec_id", L.seeded_sample("logits", 0.05, 10, 42, F.col("vec_id"), 0).alias("pick"))


# ---------------------------------------------------------------- long tables and vocabulary shards
@query("sharded_cross_entropy", "M-1 M-2", _E_SQL + """
SELECT vec_id, round(lse, 9) AS logsumexp, round(lse - l[target + 1], 9) AS xent FROM s
""")
def sharded_cross_entropy(spark, d):
    """Eight shards a row: two numbers of each are merged, the logits stay."""
    shards = LL.split_logits(logit_rows(spark, d), ["vec_id", "target"], 8)
    x = LL.sharded_cross_entropy(shards, ["vec_id"])
    return x.select("vec_id", F.round("logsumexp", 9).alias("logsumexp"), F.round("xent", 9).alias("xent"))


@query("topk_long", "W-6", _E_SQL + """,
k AS (SELECT *, list_sort(l, 'DESC')[5] AS thr FROM e)
SELECT vec_id, token, round(l[token + 1], 9) AS logit FROM (SELECT vec_id, l, thr, unnest(range(len(l))) AS token FROM k) WHERE l[token + 1] >= thr
""")
def topk_long(spark, d):
    rows = LL.explode_logits(logit_rows(spark, d), ["vec_id"])
    return LL.topk_long(rows, ["vec_id"], 5).select("vec_id", F.col("token").cast("long").alias("token"), F.round("logit", 9).alias("logit"))


@query("sample_long", "W-10 W-6", ORACLES["seeded_sample"])
def sample_long(spark, d):
    rows = LL.explode_logits(logit_rows(spark, d), ["vec_id"])
    return LL.sample_long(rows, ["vec_id"], 0.05, 10, 42, "vec_id", 0, block=16).select("vec_id", "pick")
