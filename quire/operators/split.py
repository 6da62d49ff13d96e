"""Ordering, splitting, shuffling and batching (W-1..W-5, J-3, U-1, U-2).

Global positions are computed the distributed way: give every row an id,
range-partition (order key, id), sort inside partitions, count rows per
partition (a table with one row per partition), prefix-sum those counts and
add the local position. No window ever spans the whole data set.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_LOCAL_BITS = 33  # monotonically_increasing_id: partition index << 33 | row in partition

#: rows of one key range; a range holds only the order columns and a row id
INDEX_ROWS = 1 << 20
MAX_INDEX_PARTITIONS = 1 << 16


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def index_partitions(rows: int, least: int) -> int:
    """Key ranges for ``rows`` counted rows: one per ``INDEX_ROWS``, no fewer than ``least``
    nor than one, and never more than ``MAX_INDEX_PARTITIONS`` or one per row."""
    return max(1, min(max(least, -(-rows // INDEX_ROWS)), MAX_INDEX_PARTITIONS, rows))


def with_global_index(df: DataFrame, order: list[str], name: str = "idx",
                      num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order``: every row is returned once, whatever repeats.

    Nulls come first. Rows with equal keys take consecutive positions, in the order in which they
    are stored. ``df`` may be any table: in memory, joined, empty.

    ``df`` is written once to the cluster's shared checkpoint folder, which gives every row an id
    that later jobs and recomputed tasks see alike. Only the order columns and that id are then
    sorted: one range exchange on (order, id), so that a key held by a third of all rows is spread
    over many ranges, the number of ranges taken from the counted rows. The sorted keys are written
    too, each range is counted, the counts (one row per range) are summed up, and position = offset
    + place in the range. Positions go back to the rows over the id, which is unique.
    """
    from quire.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    rid = unused(df, "_rid")
    rows = df.withColumn(rid, F.monotonically_increasing_id()).checkpoint(eager=True)
    least = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    parts = num_partitions or index_partitions(rows.count(), least)
    by = [F.col(f"_o{k}") for k in range(len(order))] + [F.col("_id")]
    ranked = (rows.select(*[F.col(f"`{c}`").alias(f"_o{k}") for k, c in enumerate(order)], F.col(rid).alias("_id"))
              .repartitionByRange(parts, *by).sortWithinPartitions(*by)
              .select("_id", F.monotonically_increasing_id().alias("_mid"))
              .select("_id", F.shiftright("_mid", _LOCAL_BITS).alias("_part"),
                      F.col("_mid").bitwiseAND((1 << _LOCAL_BITS) - 1).alias("_local"))
              .checkpoint(eager=True))
    counts = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range: an unpartitioned window here is over the ranges, not the data
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    placed = (ranked.join(F.broadcast(offsets), "_part")
              .select(F.col("_id").alias(rid), (F.col("_off") + F.col("_local")).alias(name)))
    return rows.join(placed, rid).drop(rid)


def take_first(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """W-1: first ``min(n, rows)`` rows by position (a top-n, never a full sort)."""
    return df.orderBy(*order).limit(n)


def hash_key(seed, *cols) -> F.Column:
    """Seeded ranking key: md5 of ``seed:col1:col2...`` (same in DuckDB)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def eval_size(rows: int, fraction_div: int = 10, cap: int = 32) -> int:
    """W-2 size rule: ``min(cap, max(1, rows // 10))``."""
    return min(cap, max(1, rows // fraction_div))


def exact_split(df: DataFrame, id_col: str, seed: int = 42, cap: int = 32,
                split_col: str = "split") -> DataFrame:
    """W-2: an exact eval split of ``min(cap, max(1, ids//10))`` ids ranked by a seeded hash.

    Ids are ranked once each: rows sharing an id stay on one side and every
    row is returned once. The eval ids are a top-n of at most ``cap`` rows.
    Every row is kept and labelled; a null id is train.
    """
    ids = df.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    n_eval = eval_size(ids.count(), cap=cap)
    ev = (ids.withColumn("_rk", hash_key(seed, id_col)).orderBy("_rk", id_col).limit(n_eval)
          .select(id_col, F.lit(True).alias("_ev")))
    out = df.join(ev, id_col, "left")
    return out.withColumn(split_col, F.when(F.col("_ev"), F.lit("test")).otherwise(F.lit("train"))).drop("_ev")


def shuffle_key(df: DataFrame, id_col: str, seed: int = 42, epoch: int = 0,
                key_col: str = "shuffle_key") -> DataFrame:
    """W-3: md5 of ``seed:epoch:id``; ordering by it is the epoch's random order.

    The hash spreads rows evenly over key ranges however the ids are skewed;
    ``with_global_index`` on it numbers the rows in that order.
    """
    return df.withColumn(key_col, hash_key(f"{seed}:{epoch}", id_col))


def assign_batches(df: DataFrame, order: list[str], batch_size: int = 64,
                   batch_col: str = "batch_id", pos_col: str = "pos_in_batch",
                   num_partitions: int | None = None) -> DataFrame:
    """W-4: consecutive groups of ``batch_size`` in ``order``; the last short batch is kept."""
    at = unused(df, "_gidx")
    idx = with_global_index(df, order, at, num_partitions)
    return (idx.withColumn(batch_col, F.expr(f"`{at}` div {int(batch_size)}"))
            .withColumn(pos_col, (F.col(at) % batch_size).cast("int"))
            .drop(at))


def lr_at(it, total, base_lr: float, warmup: int = 0) -> F.Column:
    """W-5 rate: linear warmup, cosine to ``base_lr/10`` at ``total``, flat after."""
    it = F.col(it) if isinstance(it, str) else it
    total = F.col(total) if isinstance(total, str) else total
    min_lr = base_lr / 10.0
    ratio = (it - F.lit(warmup)) / (total - F.lit(warmup))
    cosine = F.lit(min_lr) + 0.5 * (1.0 + F.cos(F.lit(math.pi) * ratio)) * (base_lr - min_lr)
    out = F.when(it > total, F.lit(min_lr)).otherwise(cosine)
    if warmup > 0:
        out = F.when(it < warmup, F.lit(base_lr) * it / F.lit(warmup)).otherwise(out)
    return out


def batch_plan(batches: DataFrame, epochs: int = 1, accumulation: int = 8, base_lr: float = 2e-4,
               warmup: int = 0, log_interval: int = 100, save_interval: int = 1000,
               batch_col: str = "batch_id", tokens_col: str = "loss_tokens") -> DataFrame:
    """W-5: one row per (epoch, batch) with the step's schedule.

    ``batches`` has one row per batch (e.g. from ``assign_batches`` plus a
    ``groupBy``); ``epochs`` is a small literal exploded per batch.
    """
    iters = batches.agg(F.max(batch_col)).first()[0]
    iters = 0 if iters is None else int(iters) + 1
    total = epochs * iters
    step = F.col(batch_col)
    out = batches.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max(epochs - 1, 0)))))
    it = F.col("epoch") * iters + step
    return out.select(
        "epoch", step.alias("step"), it.cast("bigint").alias("it"), F.col(tokens_col),
        lr_at(it, F.lit(total), base_lr, warmup).alias("lr"),
        ((step + 1) % accumulation == 0).alias("optimizer_step"),
        (step % log_interval == 0).alias("log_step"),
        ((step + 1) % save_interval == 0).alias("save_step"))


def split_complement(all_df: DataFrame, eval_df: DataFrame, key: str) -> DataFrame:
    """J-3: train = every row whose key is not in the eval set."""
    return all_df.join(eval_df.select(key), key, "left_anti")


def append_corpus(a: DataFrame, b: DataFrame) -> DataFrame:
    """U-1: bag union by column name (duplicates kept, as append-mode output does)."""
    return a.unionByName(b)


def split_is_partition(all_df: DataFrame, train: DataFrame, eval_df: DataFrame, key: str) -> DataFrame:
    """U-2: violations of "train and eval are disjoint and together complete".

    One row per check with a count; all zero means the split is a partition.
    """
    a, t, e = all_df.select(key), train.select(key), eval_df.select(key)
    overlap = t.intersectAll(e).agg(F.count(F.lit(1)).alias("violations")).withColumn("check", F.lit("overlap"))
    missing = a.exceptAll(t.unionByName(e)).agg(F.count(F.lit(1)).alias("violations")) \
        .withColumn("check", F.lit("missing"))
    extra = t.unionByName(e).exceptAll(a).agg(F.count(F.lit(1)).alias("violations")) \
        .withColumn("check", F.lit("extra"))
    return overlap.unionByName(missing).unionByName(extra).select("check", "violations")
