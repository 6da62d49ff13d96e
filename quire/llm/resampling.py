"""Target-distribution importance resampling: documents drawn towards the words of a target table.

1. Word n-grams of both tables fall into hashed buckets; two grouped counts give every bucket a
   gain, floor(1000 * ln of the smoothed ratio of target share to source share).
2. A document's weight is the sum of its features' gains, read from one array of all gains.
3. Weight plus a Gumbel number drawn from its id is its score; the highest scores among the
   eligible are a weighted draw without replacement.
4. The exact cutoff key comes from selection by weighted medians of medians: every partition
   names the median of its remaining keys and their number, the weighted median of those lies
   between guaranteed quarters of all that remain, one count tells which side goes. Nothing is
   sorted but the winners.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, whole_text
from quire.operators.split import with_global_index

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: the last so many keys are sorted instead of halved on
LAST_KEYS = 4096
#: remaining keys are written anew whenever they have shrunk to this share of the last copy
REWRITE = 0.25


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased: runs without ASCII characters but a-z and 0-9."""
    return F.array_remove(F.split(F.translate(whole_text(text), UPPER, LOWER), SEPARATORS), "")


def features(w: Column, longest: int = 1) -> Column:
    """All runs of 1 to ``longest`` consecutive words, joined by one space, repeats included."""
    def runs(n):
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

    return w if longest == 1 else F.concat(w, *[runs(n) for n in range(2, longest + 1)])


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(df: DataFrame, text_col: str, buckets: int, longest: int) -> DataFrame:
    """(bucket, n): features in each bucket over all texts; at most ``buckets`` rows."""
    one = df.select(F.explode(features(words(df[text_col]), longest)).alias("f"))
    return one.groupBy(bucket(F.col("f"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(source: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = 10_000,
          longest: int = 1) -> DataFrame:
    """One row, ``gains``: array<bigint> with the gain of every bucket; ``buckets`` numbers."""
    both = (F.broadcast(source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")))
            .join(bucket_counts(source, text_col, buckets, longest).withColumnRenamed("n", "s"), "bucket", "left")
            .join(bucket_counts(target, text_col, buckets, longest).withColumnRenamed("n", "t"), "bucket", "left")
            .select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t")))
    rows = F.sort_array(F.collect_list(F.struct("bucket", "s", "t")))
    total = both.agg(rows.alias("rows"), F.sum("s").alias("S"), F.sum("t").alias("T"))
    ratio = lambda r: ((r.t + 1) * (F.col("S") + buckets)) / ((r.s + 1) * (F.col("T") + buckets))
    return total.select(F.transform("rows", lambda r: F.floor(1000 * F.log(ratio(r))).cast("bigint")).alias("gains"))


def gumbel(seed: int, id_col: Column) -> Column:
    """floor(-1000 * ln(-ln(u))) with u from the first 8 hex digits of sha256(``seed:id``)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    u = (h.cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("bigint")


def scores(source: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10_000,
           longest: int = 1, seed: int = 2024) -> DataFrame:
    """id, n_words, n_features, weight and score (long) of every row of ``source``."""
    gain = gains(source, target, text_col, buckets, longest).scalar()
    w = source.select(source[id_col].alias("id"), words(source[text_col]).alias("w"))
    at = F.transform(features(F.col("w"), longest), lambda f: bucket(f, buckets))
    b = w.select("id", F.size("w").cast("long").alias("n_words"), at.alias("b"), gain.alias("g"))
    weight = F.aggregate("b", F.lit(0).cast("bigint"), lambda a, i: a + F.get(F.col("g"), i))
    return (b.select("id", "n_words", F.size("b").cast("long").alias("n_features"), weight.alias("weight"))
            .withColumn("score", F.col("weight") + gumbel(seed, F.col("id"))))


class Key(NamedTuple):
    """Order of the draw: smaller is better."""
    low: int     # minus the score
    no_id: int   # null ids come last
    id: int
    row: int     # rows equal in score and id: as they are stored


def draw_key() -> list[Column]:
    return [(-F.col("score")).alias("low"), F.col("id").isNull().cast("long").alias("no_id"),
            F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), F.col("row").alias("row")]


def _beyond(key: Key, side: str) -> Column:
    """Rows whose key lies before (``<``) or after (``>``) ``key``."""
    out = F.lit(False)
    for name, value in reversed(list(zip(Key._fields, key))):
        c = F.col(name)
        out = ((c < value) if side == "<" else (c > value)) | ((c == value) & out)
    return out


def partition_medians(keys: DataFrame) -> DataFrame:
    """(low, no_id, id, row, n): the lower median of each partition's keys, and their number.

    A task holds the keys of one partition, four numbers a row, as arrays.
    """
    def median(batches):
        import numpy as np
        import pyarrow as pa
        parts = [[b.column(k).to_numpy(zero_copy_only=False) for k in range(4)] for b in batches if b.num_rows]
        if parts:
            cols = [np.concatenate(c) for c in zip(*parts)]
            at = np.lexsort(cols[::-1])[(len(cols[0]) - 1) // 2]
            yield pa.RecordBatch.from_pydict({k: [int(c[at])] for k, c in zip(Key._fields, cols)} | {"n": [len(cols[0])]},
                                             pa.schema([(k, pa.int64()) for k in (*Key._fields, "n")]))

    return keys.select(*Key._fields).mapInArrow(median, "low long, no_id long, id long, row long, n long")


def weighted_median(medians: list[tuple[Key, int]]) -> Key:
    """The first key at which half of all the weight is reached."""
    half, seen = sum(n for _, n in medians) / 2, 0
    for key, n in sorted(medians):
        seen += n
        if seen >= half:
            return key
    raise ValueError("no keys")


def cutoff_key(keys: DataFrame, k: int, last: int = LAST_KEYS, stats: dict | None = None) -> Key | None:
    """The ``k``-th smallest key (1-based) of ``keys`` (a written table of distinct keys); None for k < 1.

    Each round takes the weighted median M of the partitions' medians. At least half of the weight
    stands at medians up to M, and half of each such partition's keys lie up to its median: a
    quarter of all that remains, and alike for the other side, so a round discards a quarter or
    more. One job gives the number of keys before M. The driver sees one key and one number a
    partition. At most ``last`` remaining keys are read in order at the end.
    """
    left, written, rounds = keys.count(), None, 0
    if k < 1 or left < k:
        return None
    written = left
    while left > last:
        rounds += 1
        medians = [(Key(r.low, r.no_id, r.id, r.row), r.n) for r in partition_medians(keys).collect()]
        m = weighted_median(medians)
        before = keys.where(_beyond(m, "<")).count()
        if k == before + 1:
            break
        if k <= before:
            keys, now = keys.where(_beyond(m, "<")), before
        else:
            keys, k, now = keys.where(_beyond(m, ">")), k - before - 1, left - before - 1
        assert now <= left - left // 4 + len(medians), "a round keeps three quarters at most"
        left = now
        if left < REWRITE * written:
            keys, written = cut(keys), left
    else:
        m = Key(*keys.orderBy(*Key._fields).limit(k).collect()[-1])
    if stats is not None:
        stats["rounds"] = rounds
    return m


def resample(source: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 10,
             least_words: int = 20, buckets: int = 10_000, longest: int = 1, seed: int = 2024, last: int = LAST_KEYS) -> DataFrame:
    """Every row of ``source``: the id, n_features, weight, score and rank (long).

    Of the N rows with ``least_words`` words or more, floor(percent * N / 100) are drawn by
    highest score, ties to the smaller id (a null id last, then as stored); rank is 1, 2, ... in that
    order, null for the rest. A null or wordless text has no features and weight 0. Repeated rows
    are rows of their own with equal scores. Empty tables: an empty source gives an empty result,
    an empty target counts as no features. Other columns are ignored, whatever their names.
    """
    rows = cut(scores(source, target, id_col, text_col, buckets, longest, seed)
               .withColumn("row", F.monotonically_increasing_id()))
    keyed = rows.where(F.col("n_words") >= least_words).select(*draw_key())
    k = keyed.count() * percent // 100
    last_key = cutoff_key(keyed, k, last)
    out = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    if last_key is None:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    order = rows.select("*", *[c.alias(f"k_{n}") for c, n in zip(draw_key(), Key._fields)])
    past = F.lit(False)
    for name, value in reversed(list(zip(Key._fields, last_key))):
        past = (F.col(f"k_{name}") > value) | ((F.col(f"k_{name}") == value) & past)
    drawn = (F.col("n_words") >= least_words) & ~past
    winners = order.where(drawn).select("id", "n_features", "weight", "score", *[f"k_{n}" for n in Key._fields])
    ranked = with_global_index(winners, [f"k_{n}" for n in Key._fields], "place")
    return (ranked.select(*out, (F.col("place") + 1).alias("rank"))
            .unionByName(order.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank"))))
