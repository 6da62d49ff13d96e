"""B-ROW-13 with quantiles of any length column: one mergeable KLL sketch per group, stored and rolled up.

Rows are read once, into the finest groups; every coarser level, and every later run, merges sketches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 400  # sketch size: a quantile's rank is off by less than RANK_ERROR with 99 % certainty
RANK_ERROR = 0.01


def length_sketches(rows: DataFrame, group: list[str], length: str, k: int = K) -> DataFrame:
    """(group..., n_rows, sum_length, max_length, sketch) of each finest group; null lengths are left out,
    null group values are a group. Partial sketches are made before the shuffle. Empty table: no rows."""
    n = F.col(length).cast("long")
    return (rows.where(n.isNotNull()).groupBy(*group)
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(n).alias("sum_length"), F.max(n).alias("max_length"),
                 F.kll_sketch_agg_bigint(n, k).alias("sketch")))


def _totals(k: int):
    return [F.sum("n_rows").alias("n_rows"), F.sum("sum_length").alias("sum_length"), F.max("max_length").alias("max_length"),
            F.kll_merge_agg_bigint("sketch", k).alias("sketch")]


def merge_sketches(runs: DataFrame, group: list[str], k: int = K) -> DataFrame:
    """One row per group from the stored rows of several runs (or of parts of one)."""
    return runs.groupBy(*group).agg(*_totals(k))


def roll_up(sketches: DataFrame, group: list[str], k: int = K) -> DataFrame:
    """All levels of ``rollup(group...)`` from the finest: ``level`` is the number of group columns that count
    (0: everything), which tells a null value from a total. Empty table: no rows."""
    rolled = sketches.rollup(*group).agg(F.grouping_id().alias("_gid"), *_totals(k))
    # each column rolled away sets one bit
    level = (F.lit(len(group)) - F.bit_count("_gid")).cast("int")
    return rolled.where("n_rows is not null").withColumn("level", level).drop("_gid")


def quantiles(sketches: DataFrame, at: dict[str, float]) -> DataFrame:
    """The sketch read at the given ranks, one column per name, instead of the sketch."""
    got = [F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(q))).alias(name) for name, q in at.items()]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *got)
