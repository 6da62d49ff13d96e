"""A-5 on a stream (ST-2): completions of one prompt arrive apart, a group's statistics leave once.

State per prompt is one reward per completion still awaited, at most ``group_size``, so a hot
prompt costs no more than another. Prompts share states, a fixed number of buckets of them, as a call of the
Python function and a frame for its result per prompt cost far more than the prompt's few rows. The sink writes one folder per micro-batch and replaces
it when a restarted query repeats the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "prompts array<{key}>, ids array<array<long>>, rewards array<array<double>>, latest array<long>, due array<long>, sent array<boolean>"
BUCKETS = 4096


def stream_reward_groups(stream: DataFrame, group_size: int, prompt: str = "prompt_id", completion: str = "completion_id",
                         reward: str = "reward", time: str | None = None, delay: str = "1 hour", delay_ms: int = 3_600_000,
                         buckets: int = BUCKETS) -> DataFrame:
    """(prompt, n, group_mean, group_std, no_signal, complete): one row per prompt, sent in the batch in which its
    ``group_size``-th distinct completion arrives.

    A completion sent again, and any beyond the group's size, changes nothing; of those that arrive in one batch
    the smallest ids (and, for one id, the smallest reward) come first, so the order of rows does not matter. Rows
    without prompt, completion or reward are left out; ``completion`` is an integer. With a ``time`` column,
    rows behind the watermark (``delay``) are dropped, a group whose last row is ``delay_ms`` behind it is sent as it is
    (``complete`` false), and its state is freed. Without one, groups wait for ever. An empty stream gives no rows.
    ``buckets``: how many states the prompts share; a query that goes on from its checkpoint must keep it.
    """
    import pandas as pd

    key_type = stream.schema[prompt].dataType.simpleString()
    at = F.col(time) if time else F.lit(None).cast("timestamp")
    rows = stream.select(F.col(prompt).alias("g"), F.col(completion).cast("long").alias("c"), F.col(reward).cast("double").alias("r"), at.alias("t"))
    rows = rows.where("g is not null and c is not null and r is not null")
    if time:
        rows = rows.where("t is not null").withWatermark("t", delay)
    rows = rows.withColumn("ms", F.unix_millis("t"))

    rows = rows.withColumn("b", F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int"))

    def result(prompt_id, rewards, complete):
        n = len(rewards)
        mean = sum(rewards) / n
        sd = (sum((x - mean) ** 2 for x in rewards) / (n - 1)) ** 0.5 if n > 1 else None
        return prompt_id, n, mean, sd, max(rewards) == min(rewards), complete

    def step(key, parts, state: GroupState):
        # prompt: [reward by completion, time of its last row, when it times out, sent]
        held = {p: [dict(zip(i, r)), *rest] for p, i, r, *rest in zip(*state.get)} if state.exists else {}
        now = state.getCurrentWatermarkMs() if time else None
        new: dict = {}  # of the prompts with rows in this batch
        out = []
        for part in () if state.hasTimedOut else parts:
            for g, c, r, ms in zip(part["g"], part["c"].tolist(), part["r"].tolist(), part["ms"].tolist()):
                group, fresh = held.setdefault(g, [{}, 0, 0, False]), new.setdefault(g, {})
                if time:
                    group[1] = max(group[1], int(ms))
                if not group[3] and c not in group[0]:
                    fresh[c] = min(r, fresh.get(c, r))
            # no more than the groups can still take is held
            for g in set(part["g"]):
                new[g] = dict(sorted(new[g].items())[:group_size - len(held[g][0])])
        for g, fresh in new.items():
            group = held[g]
            group[0] = {**group[0], **fresh}
            if time:
                group[2] = max(group[1] + delay_ms, now + 1)
            if not group[3] and len(group[0]) == group_size:
                out.append(result(g, list(group[0].values()), True))
                group[0], group[3] = {}, True
        if time:
            for g in [g for g, group in held.items() if g not in new and group[2] < now]:
                group = held.pop(g)
                if not group[3]:
                    out.append(result(g, list(group[0].values()), False))
        if held:
            state.update((list(held), [list(x[0]) for x in held.values()], [list(x[0].values()) for x in held.values()],
                          *([x[i] for x in held.values()] for i in (1, 2, 3))))
            if time:
                state.setTimeoutTimestamp(max(min(x[2] for x in held.values()), now + 1))
        else:
            state.remove()
        if out:
            frame = pd.DataFrame(out, columns=["g", "n", "mean", "std", "same", "complete"])
            yield frame.astype({"std": "float64"})

    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    out = rows.groupBy("b").applyInPandasWithState(
        step, f"g {key_type}, n long, mean double, std double, same boolean, complete boolean", STATE.format(key=key_type), "append", timeout)
    return out.toDF(prompt, "n", "group_mean", "group_std", "no_signal", "complete")


def run_once_each(stream: DataFrame, sink_dir: str, checkpoint_location: str, after_batch=None) -> DataFrame:
    """Process what is there (``availableNow``), one Parquet folder per micro-batch, and return all of them as a table.

    A batch repeated after a loss replaces its own folder, so every row is there once. ``after_batch(batch_id)``
    is called when a batch is written, before it counts as done.
    """
    spark: SparkSession = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_dir}/batch={batch_id}")
        if after_batch:
            after_batch(batch_id)

    q = (stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint_location)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{sink_dir}/batch=*")
