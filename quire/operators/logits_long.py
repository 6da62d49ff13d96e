"""Logits as long tables: (row, token, logit) rows, and vocabulary shards (W-6, W-10, M-1, M-2).

The array forms in ``functions.logits`` hold a whole vocabulary in one value. Here a row's vocabulary is
spread over many table rows or shards, which are reduced where they are: a log-sum-exp is
mergeable as (maximum, sum of exp(x - maximum)), a top-k as the k-th largest value, a draw as running
sums over blocks of tokens and then inside the one block that the draw falls into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import logits as L

BLOCK = 4096


def explode_logits(df: DataFrame, keep: list[str], logits: str = "logits") -> DataFrame:
    """(keep..., token, logit) of an array column."""
    return df.select(*keep, F.posexplode(F.col(logits).cast("array<double>")).alias("token", "logit"))


def split_logits(df: DataFrame, keep: list[str], shards: int, logits: str = "logits") -> DataFrame:
    """(keep..., first_token, part): the array cut into ``shards`` parts of equal length (the last may be shorter)."""
    n = F.size(logits)
    width = F.greatest(F.ceil(n / shards).cast("int"), F.lit(1))
    firsts = F.when(n > 0, F.sequence(F.lit(0), n - 1, width)).otherwise(F.array().cast("array<int>"))
    return (df.select(*keep, logits, width.alias("_w"), F.explode(firsts).alias("first_token"))
            .select(*keep, "first_token", F.slice(logits, F.col("first_token") + 1, F.col("_w")).alias("part")))


def lse_state(part) -> Column:
    """The mergeable state of one shard: its maximum and the sum of exp(x - maximum)."""
    part = F.col(part) if isinstance(part, str) else part
    return F.struct(F.array_max(part).alias("m"),
                    F.aggregate(F.transform(part, lambda x: F.exp(x - F.array_max(part))), F.lit(0.0), lambda a, x: a + x).alias("s"))


def merge_lse(states: Column) -> Column:
    """log-sum-exp from the states of all shards (an array of them): sums are rescaled to the larger maximum."""
    def plus(a, b):
        m = F.greatest(a["m"], b["m"])
        grow = lambda x: F.when(x["m"] == float("-inf"), F.lit(0.0)).otherwise(x["s"] * F.exp(x["m"] - m))
        return F.struct(m.alias("m"), (grow(a) + grow(b)).alias("s"))

    zero = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s"))
    return F.aggregate(states, zero, plus, lambda a: a["m"] + F.log(a["s"]))


def sharded_cross_entropy(shards: DataFrame, row: list[str], target: str = "target", ignore: Column | None = None) -> DataFrame:
    """M-1 / M-2 over (row..., target, first_token, part): one row per row: ``logsumexp``, ``target_logit`` and ``xent``
    (0 where the target equals ``ignore``; null where no shard holds it).

    Each shard becomes two numbers and the target's logit before the shuffle; a row gathers one state
    per shard, never its logits.
    """
    at = F.col(target) - F.col("first_token")
    one = shards.select(*row, target, lse_state("part").alias("state"),
                        F.when((at >= 0) & (at < F.size("part")), F.get("part", at.cast("int"))).alias("hit"))
    out = (one.groupBy(*row, target).agg(merge_lse(F.collect_list("state")).alias("logsumexp"), F.max("hit").alias("target_logit")))
    loss = F.col("logsumexp") - F.col("target_logit")
    return out.withColumn("xent", loss if ignore is None else F.when(F.col(target) == ignore, F.lit(0.0)).otherwise(loss))


def long_to_shards(df: DataFrame, row: list[str], block: int = BLOCK) -> DataFrame:
    """(row..., first_token, part) from (row..., token, logit): blocks of ``block`` neighbouring token ids."""
    return (df.groupBy(*row, F.expr(f"token div {block}").alias("_b"))
            .agg(F.min("token").alias("first_token"), F.array_sort(F.collect_list(F.struct("token", "logit"))).alias("_p"))
            .select(*row, "first_token", F.transform("_p", lambda x: x["logit"]).alias("part")))


def topk_long(df: DataFrame, row: list[str], k: int, logit: str = "logit") -> DataFrame:
    """W-6: rows of (row..., token, logit) whose logit is at least the row's k-th largest, ties kept.

    ``rank() <= k`` is limited inside every task before the shuffle (a window group limit), so a row
    sends k values and their ties from each task, not its vocabulary.
    """
    at = Window.partitionBy(*row).orderBy(F.desc(logit))
    return df.withColumn("_rank", F.rank().over(at)).where(F.col("_rank") <= k).drop("_rank")


def sample_long(df: DataFrame, row: list[str], t: float, top_k: int | None, seed, row_id: str, step=0, block: int = BLOCK) -> DataFrame:
    """W-10: one seeded draw per row of (row..., token, logit): (row..., ``pick``), the same token as the array form draws.

    Temperature, top-k, then two levels of running sums: over the row's blocks of tokens, then inside the
    block where the sum passes u * total. Only that block is walked token by token.
    """
    df = df.withColumn("logit", F.col("logit") / F.lit(float(t)))
    if top_k is not None and top_k >= 1:
        df = topk_long(df, row, top_k)
    top = df.groupBy(*row).agg(F.max("logit").alias("_m"))
    w = df.join(top, row).select(*row, "token", F.exp(F.col("logit") - F.col("_m")).alias("_w"), F.expr(f"token div {block}").alias("_b"))
    over_blocks = Window.partitionBy(*row).orderBy("_b")
    # the total is the last running sum, so that the draw always falls into some block
    blocks = (w.groupBy(*row, "_b").agg(F.sum("_w").alias("_bw"))
              .withColumn("_before", F.coalesce(F.sum("_bw").over(over_blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
              .withColumn("_total", F.sum("_bw").over(Window.partitionBy(*row)))
              .withColumn("_cut", L.uniform_from_hash(seed, F.col(row_id), step) * F.col("_total")))
    chosen = (blocks.where((F.col("_before") <= F.col("_cut")) & (F.col("_bw") > 0))
              .groupBy(*row).agg(F.max_by(F.struct("_b", "_before", "_cut"), "_b").alias("_c")).select(*row, "_c.*"))
    inside = Window.partitionBy(*row).orderBy("token")
    walked = (w.join(chosen, [*row, "_b"])
              .withColumn("_sum", F.col("_before") + F.sum("_w").over(inside.rowsBetween(Window.unboundedPreceding, 0))))
    # rounding can leave the draw just past the block's last mass: then its last positive token
    return (walked.where("_w > 0").groupBy(*row)
            .agg(F.coalesce(F.min(F.when(F.col("_sum") > F.col("_cut"), F.col("token"))), F.max("token")).cast("int").alias("pick")))
