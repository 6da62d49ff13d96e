"""Answers, rewards, accuracy and loss reports (A-1..A-8, J-1, J-2)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T


def reward(pred, truth) -> Column:
    """A-2: 1.0 on exact string equality, else 0.0; a null truth scores 0.0."""
    p = F.col(pred) if isinstance(pred, str) else pred
    t = F.col(truth) if isinstance(truth, str) else truth
    return F.when(F.coalesce(p == t, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))


def score_completions(df: DataFrame, completion: str, truth: str, as_messages: bool = False,
                      reward: Callable[[Column, Column], Column] = reward) -> DataFrame:
    """A-1 + A-2 on a table: extracted answer and reward per row.

    ``as_messages``: the completion is a message list and its first item's
    content is used. ``reward``: any function of the answer and the truth
    columns (a column expression, or an Arrow UDF applied to them).
    """
    text = T.first_content(completion) if as_messages else F.col(completion)
    return df.withColumn("pred", T.boxed_answer(text)).withColumn("reward", reward(F.col("pred"), F.col(truth)))


def truth_report(df: DataFrame, truth: str, group: list[str] | None = None) -> DataFrame:
    """P-8 companion: rows, and rows whose truth is null (they can only score 0.0)."""
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth).isNull()).alias("n_null_truth")]
    return df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)


def accuracy(df: DataFrame, reward_col: str = "reward", group: list[str] | None = None) -> DataFrame:
    """A-3: mean reward; 0.0 for no rows."""
    agg = F.coalesce(F.avg(F.col(reward_col)), F.lit(0.0)).alias("accuracy")
    n = F.count(F.lit(1)).alias("n")
    return df.groupBy(*group).agg(agg, n) if group else df.agg(agg, n)


def join_predictions(pred: DataFrame, truth: DataFrame, key: str = "question_id") -> DataFrame:
    """J-1: inner equi-join of predictions and truth on ``key``."""
    return pred.join(truth, key, "inner")


def unmatched(pred: DataFrame, truth: DataFrame, key: str = "question_id") -> DataFrame:
    """J-1 companion: keys present on one side only (the positional zip drops them silently)."""
    a = pred.select(key).join(truth.select(key), key, "left_anti").withColumn("side", F.lit("prediction_only"))
    b = truth.select(key).join(pred.select(key), key, "left_anti").withColumn("side", F.lit("truth_only"))
    return a.unionByName(b)


def compare_runs(before: DataFrame, after: DataFrame, key: str = "question_id",
                 reward_col: str = "reward") -> DataFrame:
    """J-2 per question: reward before and after and the flip (full outer join).

    ``flip`` compares the questions both runs answered (a null reward of a
    matched question counts as 0.0); a question of one run alone is ``unmatched``.
    """
    b = before.select(key, F.col(reward_col).alias("reward_before"), F.lit(True).alias("_b"))
    a = after.select(key, F.col(reward_col).alias("reward_after"), F.lit(True).alias("_a"))
    j = b.join(a, key, "full_outer")
    rb, ra = F.coalesce("reward_before", F.lit(0.0)), F.coalesce("reward_after", F.lit(0.0))
    both = F.col("_b").isNotNull() & F.col("_a").isNotNull()
    flip = (F.when(~both, F.lit("unmatched")).when(ra > rb, F.lit("gained"))
            .when(ra < rb, F.lit("lost")).otherwise(F.lit("same")))
    return j.withColumn("flip", flip).drop("_a", "_b")


def format_delta(delta: Column) -> Column:
    """A-4 text: signed percent with two decimals (``+8.00%``)."""
    return F.format_string("%+.2f%%", delta * 100.0)


def accuracy_delta(per_question: DataFrame) -> DataFrame:
    """A-4 summary over J-2's rows: accuracy before, after, delta and its text.

    Accuracies and flips are those of the matched questions, so both runs are
    measured on one set; ``n_unmatched`` counts the others.
    """
    matched = F.col("flip") != "unmatched"

    def mean(c):
        return F.coalesce(F.avg(F.when(matched, F.coalesce(F.col(c), F.lit(0.0)))), F.lit(0.0))

    s = per_question.agg(mean("reward_before").alias("acc_before"), mean("reward_after").alias("acc_after"),
                         F.count_if(F.col("flip") == "gained").alias("n_gained"),
                         F.count_if(F.col("flip") == "lost").alias("n_lost"),
                         F.count_if(~matched).alias("n_unmatched"), F.count_if(matched).alias("n"))
    d = F.col("acc_after") - F.col("acc_before")
    return s.withColumn("delta", d).withColumn("delta_text", format_delta(d))


def reward_groups(df: DataFrame, prompt_col: str = "prompt_id", reward_col: str = "reward") -> DataFrame:
    """A-5: per prompt mean, sample sd and size of the completions' rewards, joined back.

    A group whose rewards are all equal carries no signal. The statistics come
    from a partial aggregation (a hot prompt is combined map-side) and are
    joined back on the prompt key (null-safe: completions without a prompt are
    one group); adaptive skew-join splitting covers a hot key on the
    completions side.
    """
    g = df.groupBy(prompt_col).agg(
        F.avg(reward_col).alias("group_mean"), F.stddev_samp(reward_col).alias("group_std"),
        F.count(F.lit(1)).alias("group_size"),
        (F.max(reward_col) == F.min(reward_col)).alias("no_signal"))
    key = g[prompt_col]
    return df.join(g, df[prompt_col].eqNullSafe(key), "inner").drop(key)


def masked_mean(df: DataFrame, loss: str, mask: str, group: list[str] | None = None) -> DataFrame:
    """A-6 / A-7: ``sum(loss * mask) / sum(mask)``; null (not NaN) when the mask is empty.

    ``loss`` and ``mask`` may be scalar columns (one token per row) or equal-size
    arrays per row.
    """
    dt = dict(df.dtypes)
    if dt[loss].startswith("array"):
        z = F.arrays_zip(F.col(loss).alias("l"), F.col(mask).alias("m"))
        num = F.aggregate(z, F.lit(0.0), lambda a, e: a + e.getField("l") * e.getField("m"))
        den = F.aggregate(F.col(mask), F.lit(0.0), lambda a, m: a + m)
    else:
        num, den = F.col(loss) * F.col(mask), F.col(mask).cast("double")
    aggs = [F.try_divide(F.sum(num), F.sum(den)).alias("masked_mean"), F.sum(den).alias("mask_sum")]
    return df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)


def count_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """A-8: one row per named table with its row count."""
    out = None
    for name, d in tables.items():
        one = d.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("name", "n_rows")
