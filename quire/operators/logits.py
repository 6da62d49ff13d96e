"""Table-level logits operators (M-2's batch rule, M-4, A-6 over token losses)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import logits as L
from quire.functions.ids import PAD_ID

IGNORE_SWITCH = -100


def token_cross_entropy(df: DataFrame, logits: str = "logits", target: str = "target",
                        batch_col: str | None = "batch_id", pad_id: int | None = PAD_ID,
                        out: str = "xent") -> DataFrame:
    """M-2 per row: ignore index is the pad id (0 when there is none), or -100 for a
    whole batch when any of its targets is -100.

    A row's loss under either index is known before the switch, so it is computed
    first; the per-batch ``max`` then moves targets and losses, never the
    logits. Batches are bounded, so the window is too. Without a batch column
    the whole table is one batch and the flag is one aggregate. The logits
    column is dropped unless there is no batch column to shuffle by.
    """
    default = pad_id if pad_id is not None else 0
    t = F.col(target)
    if not batch_col:
        any_switch = df.agg(F.max((t == IGNORE_SWITCH).cast("int"))).first()[0] == 1
        return df.withColumn(out, L.cross_entropy(logits, t, F.lit(IGNORE_SWITCH if any_switch else default)))
    raw = df.withColumn("_raw", L.cross_entropy(logits, t, F.lit(None).cast("int"))).drop(logits)
    switched = F.max((t == IGNORE_SWITCH).cast("int")).over(Window.partitionBy(batch_col)) == 1
    ignore = F.when(switched, F.lit(IGNORE_SWITCH)).otherwise(F.lit(default))
    return raw.withColumn(out, F.when(t == ignore, F.lit(0.0)).otherwise(F.col("_raw"))).drop("_raw")


def mean_cross_entropy(df: DataFrame, xent: str = "xent", target: str = "target", ignore_index: int = -1,
                       group: list[str] | None = None) -> DataFrame:
    """M-4: mean loss over rows whose target is not ``ignore_index``."""
    v = F.when(F.col(target) != ignore_index, F.col(xent))
    agg = [F.avg(v).alias("mean_xent"), F.count(v).alias("n_targets")]
    return df.groupBy(*group).agg(*agg) if group else df.agg(*agg)
