"""Questions, answers, rewards, accuracy and loss reports over the test tables.

No table holds ``####`` or ``\\boxed``: answer and completion texts are built
in the query from whole documents, as a math set would carry them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import chat as C
from quire.functions import text as T
from quire.operators import reshape as R
from quire.operators import scoring as A
from quire.plans.registry import query, table

# Fixed value from the reference's RL evaluation.
RL_SYSTEM_PROMPT = ("You are a helpful assistant that solves problems step by step. "
                    "Always include the final numeric answer inside \\boxed{}.")

_WS = "[\\s\\x1c-\\x1f]"


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_QA_SQL = f"""
WITH qa AS (
  SELECT doc_id, lang, text,
         text || ' #### ' || CAST(length(text) // 100 AS VARCHAR) AS answer,
         text || chr(10) || 'So the answer is \\boxed{{ ' ||
           CAST(n_chars // 100 + CASE WHEN lang <> 'en' THEN 1 ELSE 0 END AS VARCHAR) || ' }}.' AS completion
  FROM documents),
scored AS (
  SELECT doc_id, lang, nullif(regexp_extract(answer, '####\\s*(-?\\d+)', 1), '') AS ground_truth,
         {_sql_strip("regexp_extract(completion, '\\\\boxed\\{(.*?)\\}', 1)")} AS pred
  FROM qa),
rewarded AS (SELECT *, CASE WHEN pred = ground_truth THEN 1.0 ELSE 0.0 END AS reward FROM scored)
"""


def qa_table(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang", "text", "n_chars")
    answer = F.concat("text", F.lit(" #### "), F.floor(F.length("text") / 100).cast("string"))
    bump = F.when(F.col("lang") != "en", 1).otherwise(0)
    completion = F.concat("text", F.lit("\nSo the answer is \\boxed{ "),
                          (F.floor(F.col("n_chars") / 100) + bump).cast("string"), F.lit(" }."))
    return docs.select("doc_id", "lang", "text", answer.alias("answer"), completion.alias("completion"))


def scored(spark, d):
    qa = qa_table(spark, d).withColumn("ground_truth", T.extract_ground_truth("answer"))
    return R.drop_columns(A.score_completions(qa, "completion", "ground_truth"), "answer", "completion", "text")


@query("rewards", "A-1 A-2 P-8 P-7", _QA_SQL + "SELECT doc_id, ground_truth, pred, reward FROM rewarded")
def rewards(spark, d):
    return scored(spark, d).select("doc_id", "ground_truth", "pred", "reward")


@query("reward_callable", "A-2 P-8", _QA_SQL + """
SELECT lang, count(*) AS n, count(*) - count(ground_truth) AS n_null_truth,
       round(sum(CASE WHEN pred = ground_truth THEN 1.0
                      WHEN abs(TRY_CAST(pred AS DOUBLE) - TRY_CAST(ground_truth AS DOUBLE)) <= 1 THEN 0.5 ELSE 0.0 END), 6) AS partial_credit
FROM scored GROUP BY lang
""")
def reward_callable(spark, d):
    def near(pred, truth):  # half a point for an answer one off
        gap = F.abs(pred.try_cast("double") - truth.try_cast("double"))
        return F.when(pred == truth, F.lit(1.0)).when(gap <= 1, F.lit(0.5)).otherwise(F.lit(0.0))
    qa = qa_table(spark, d).withColumn("ground_truth", T.extract_ground_truth("answer"))
    s = A.score_completions(qa, "completion", "ground_truth", reward=near)
    credit = s.groupBy("lang").agg(F.round(F.sum("reward"), 6).alias("partial_credit"))
    return A.truth_report(s, "ground_truth", ["lang"]).join(credit, "lang")


@query("accuracy", "A-3", _QA_SQL + """
SELECT lang, coalesce(avg(reward), 0.0) AS accuracy, count(*) AS n FROM rewarded GROUP BY lang
UNION ALL SELECT 'all' AS lang, coalesce(avg(reward), 0.0) AS accuracy, count(*) AS n FROM rewarded
""")
def accuracy(spark, d):
    s = scored(spark, d)
    by = A.accuracy(s, "reward", ["lang"])
    return by.unionByName(A.accuracy(s, "reward").withColumn("lang", F.lit("all"))).select("lang", "accuracy", "n")


@query("rl_prompts", "P-6 P-7 P-8 R-1", f"""
SELECT doc_id, nullif(regexp_extract(text || ' #### ' || CAST(length(text) // 100 AS VARCHAR), '####\\s*(-?\\d+)', 1), '') AS ground_truth,
       '<|im_start|>system' || chr(10) || '{RL_SYSTEM_PROMPT}' || '<|im_end|>' || chr(10) ||
       '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt
FROM documents
""")
def rl_prompts(spark, d):
    qa = qa_table(spark, d)
    mapped = qa.select("doc_id", "text", "answer", T.extract_ground_truth("answer").alias("ground_truth"),
                       C.build_prompt("text", RL_SYSTEM_PROMPT).alias("prompt_messages"))
    kept = R.drop_columns(mapped, "text", "answer")
    return kept.select("doc_id", "ground_truth",
                       C.render_chatml("prompt_messages", add_generation_prompt=True).alias("prompt"))


# ---------------------------------------------------------------- J-1
_J1_SQL = _QA_SQL + """,
truth AS (SELECT doc_id, CAST(quality AS VARCHAR) AS ground_truth FROM labels)
"""


@query("join_predictions", "J-1 A-2", _J1_SQL + """
SELECT r.doc_id, r.pred, t.ground_truth, CASE WHEN r.pred = t.ground_truth THEN 1.0 ELSE 0.0 END AS reward
FROM rewarded r JOIN truth t ON r.doc_id = t.doc_id
""")
def join_predictions(spark, d):
    preds = scored(spark, d).select("doc_id", "pred")
    truth = table(spark, d, "labels", "doc_id", "quality").select("doc_id", F.col("quality").cast("string").alias("ground_truth"))
    j = A.join_predictions(preds, truth, "doc_id")
    return j.select("doc_id", "pred", "ground_truth", A.reward("pred", "ground_truth").alias("reward"))


@query("unmatched_predictions", "J-1", _J1_SQL + """
SELECT doc_id, 'prediction_only' AS side FROM rewarded WHERE doc_id NOT IN (SELECT doc_id FROM truth)
UNION ALL SELECT doc_id, 'truth_only' AS side FROM truth WHERE doc_id NOT IN (SELECT doc_id FROM rewarded)
""")
def unmatched_predictions(spark, d):
    preds = scored(spark, d).select("doc_id", "pred")
    truth = table(spark, d, "labels", "doc_id", "quality")
    return A.unmatched(preds, truth, "doc_id")


# ---------------------------------------------------------------- J-2, A-4
_RUNS_SQL = _QA_SQL + """,
j AS (SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, b.reward AS reward_before, a.reward AS reward_after,
             b.doc_id IS NOT NULL AND a.doc_id IS NOT NULL AS matched
      FROM rewarded b FULL OUTER JOIN (SELECT doc_id, CAST(quality AS DOUBLE) AS reward FROM labels) a ON b.doc_id = a.doc_id),
f AS (SELECT *, CASE WHEN NOT matched THEN 'unmatched'
                     WHEN coalesce(reward_after, 0.0) > coalesce(reward_before, 0.0) THEN 'gained'
                     WHEN coalesce(reward_after, 0.0) < coalesce(reward_before, 0.0) THEN 'lost' ELSE 'same' END AS flip FROM j)
"""


def _runs(spark, d):
    before = scored(spark, d).select("doc_id", "reward")
    after = table(spark, d, "labels", "doc_id", "quality").select("doc_id", F.col("quality").cast("double").alias("reward"))
    return A.compare_runs(before, after, "doc_id")


@query("compare_runs", "J-2", _RUNS_SQL + "SELECT doc_id, reward_before, reward_after, flip FROM f")
def compare_runs(spark, d):
    return _runs(spark, d).select("doc_id", "reward_before", "reward_after", "flip")


@query("accuracy_delta", "A-4 J-2", _RUNS_SQL + """,
s AS (SELECT coalesce(avg(reward_before) FILTER (WHERE matched), 0.0) AS acc_before,
             coalesce(avg(reward_after) FILTER (WHERE matched), 0.0) AS acc_after,
             count(*) FILTER (WHERE flip = 'gained') AS n_gained, count(*) FILTER (WHERE flip = 'lost') AS n_lost,
             count(*) FILTER (WHERE NOT matched) AS n_unmatched, count(*) FILTER (WHERE matched) AS n FROM f)
SELECT acc_before, acc_after, n_gained, n_lost, n_unmatched, n, acc_after - acc_before AS delta,
       printf('%+.2f%%', (acc_after - acc_before) * 100.0) AS delta_text FROM s
""")
def accuracy_delta(spark, d):
    s = A.accuracy_delta(_runs(spark, d))
    return s.select("acc_before", "acc_after", "n_gained", "n_lost", "n_unmatched", "n", "delta", "delta_text")


# ---------------------------------------------------------------- A-5
@query("reward_groups", "A-5", """
WITH c AS (SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN 1.0 ELSE 0.0 END AS reward
           FROM conversations WHERE role = 'assistant'),
g AS (SELECT conv_id, avg(reward) AS group_mean, stddev_samp(reward) AS group_std, count(*) AS group_size,
             max(reward) = min(reward) AS no_signal FROM c GROUP BY conv_id)
SELECT c.conv_id, c.turn, c.reward, round(g.group_mean, 9) AS group_mean, round(g.group_std, 9) AS group_std,
       g.group_size, g.no_signal
FROM c JOIN g ON c.conv_id = g.conv_id
""")
def reward_groups(spark, d):
    long = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    comps = long.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.when(F.length("text") > 300, 1.0).otherwise(0.0).alias("reward"))
    g = A.reward_groups(comps, "conv_id", "reward")
    return g.select("conv_id", "turn", "reward", F.round("group_mean", 9).alias("group_mean"),
                    F.round("group_std", 9).alias("group_std"), "group_size", "no_signal")


# ---------------------------------------------------------------- A-6, A-7
def _steps(spark, d):
    ev = table(spark, d, "events", "event_id", "event_type", "value")
    return ev.select("event_id", F.col("value").alias("loss"),
                     (F.col("event_type") != "error").cast("int").alias("mask"),
                     F.floor(F.col("event_id") / 100).cast("bigint").alias("log_step"))


@query("masked_mean", "A-6", """
SELECT round(sum(value * CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)
             / nullif(sum(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 0), 9) AS masked_mean,
       sum(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS mask_sum
FROM events
""")
def masked_mean(spark, d):
    m = A.masked_mean(_steps(spark, d), "loss", "mask")
    return m.select(F.round("masked_mean", 9).alias("masked_mean"), "mask_sum")


@query("loss_by_batch", "A-7", """
SELECT event_id // 100 AS log_step,
       round(sum(value * CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)
             / nullif(sum(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 0), 9) AS masked_mean,
       sum(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS mask_sum
FROM events GROUP BY 1
""")
def loss_by_batch(spark, d):
    m = A.masked_mean(_steps(spark, d), "loss", "mask", ["log_step"])
    return m.select("log_step", F.round("masked_mean", 9).alias("masked_mean"), "mask_sum")


# ---------------------------------------------------------------- A-8
@query("count_rows", "A-8", """
SELECT 'documents' AS name, count(*) AS n_rows FROM documents
UNION ALL SELECT 'conversations', count(*) FROM conversations
UNION ALL SELECT 'benchmark', count(*) FROM benchmark
UNION ALL SELECT 'labels', count(*) FROM labels
""")
def count_rows(spark, d):
    return A.count_rows({n: table(spark, d, n) for n in ("documents", "conversations", "benchmark", "labels")})
