"""Packing: optimal length buckets and token-budget batches.

The global histogram of sequence lengths (bounded by the context length) goes to the
driver, where dynamic programming chooses the bucket boundaries with the least padding.
Sequences then take places inside their bucket, and a batch is as many places as the token
budget holds at the bucket's length.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP_ROWS = 50_000


def optimal_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """The boundaries (at most ``buckets``, the longest length last) with the least total padding.

    Best padding of the first j lengths in k buckets = least over i of best(i, k - 1) plus the
    padding of lengths i..j at length j. For fixed k each i is a line in the length of j, so
    the lower envelope of lines gives each row in linear time. Exact integers; no
    lengths: no boundaries.
    """
    lengths = sorted(x for x, c in histogram.items() if c > 0)
    n = len(lengths)
    if not n:
        return []
    docs, tokens = [0], [0]
    for x in lengths:
        docs.append(docs[-1] + histogram[x])
        tokens.append(tokens[-1] + x * histogram[x])
    inf = float("inf")
    best = [0] + [inf] * n
    choice: list[list[int]] = []
    for _ in range(min(buckets, n)):
        new, picks = [inf] * (n + 1), [0] * (n + 1)
        new[0] = 0
        hull: list[tuple[int, int, int]] = []  # (slope, value, i), slopes falling
        head = 0
        for j in range(1, n + 1):
            i = j - 1
            if best[i] < inf:
                m, b = -docs[i], best[i] + tokens[i]
                while len(hull) - head >= 2:
                    (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                    if (b - b1) * (m1 - m2) <= (b2 - b1) * (m1 - m):
                        hull.pop()
                    else:
                        break
                hull.append((m, b, i))
            x = lengths[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            if len(hull) > head:
                m, b, i = hull[head]
                new[j] = x * docs[j] - tokens[j] + m * x + b
                picks[j] = i
        choice.append(picks)
        best = new
    out, j = [], n
    for picks in reversed(choice):
        if j == 0:
            break
        out.append(lengths[j - 1])
        j = picks[j]
    return sorted(out)


def cut_sequences(df: DataFrame, id_col: str, length_col: str, context: int) -> DataFrame:
    """(id, segment, start, length): every text cut into stretches of ``context`` tokens and a rest.

    No token is dropped; a text without tokens (also a null length) stays as one empty stretch.
    """
    n = F.coalesce(df[length_col], F.lit(0)).cast("long")
    last = F.greatest(F.ceil(n / context) - 1, F.lit(0)).cast("long")
    return (df.select(df[id_col].alias("id"), n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("segment"))
            .select("id", "segment", (F.col("segment") * context).alias("start"),
                    F.least(F.lit(context), F.col("n") - F.col("segment") * context).alias("length")))


def pack(df: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", context: int = 8192, buckets: int = 16,
         budget: int = 65536, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per sequence: id, segment, start, length, ``bucket`` (the padded length), ``batch`` (its
    number in the bucket) and ``slot`` (its place in the batch).

    Batches of a bucket hold ``max(1, budget // bucket)`` sequences; only the last may hold fewer.
    Places are given in groups of about ``group_rows`` rows dealt by a hash of the id, so a
    bucket with a third of all rows is many tasks' work; the groups' sizes shift the
    places. Repeated rows and null ids take places of their own. Empty table: no rows.
    """
    seq = cut_sequences(df, id_col, length_col, context)
    hist = {r["length"]: r["count"] for r in seq.groupBy("length").count().collect()}  # context + 1 rows at most
    bounds = optimal_boundaries(hist, buckets) or [0]
    rows = [0] * len(bounds)
    for x, c in hist.items():
        rows[bisect_left(bounds, x)] += c

    def per_bucket(values) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("b"))

    b = F.lit(0)
    for x in bounds[:-1]:
        b = b + (F.col("length") > x).cast("int")
    key = F.xxhash64(F.col("id").isNull(), "id", "segment", "length")
    dealt = (seq.withColumn("b", b)
             .withColumn("g", F.pmod(key, per_bucket([-(-max(1, r) // group_rows) for r in rows])).cast("long")))
    sizes = dealt.groupBy("b", "g").count()
    before = Window.partitionBy("b").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("b", "g", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("b", "g").orderBy("id", "segment", "length")
    size = per_bucket([max(1, budget // max(1, x)) for x in bounds]).cast("long")
    return (dealt.withColumn("nth", F.row_number().over(inside) - 1).join(shift, ["b", "g"])
            .withColumn("at", F.col("shift") + F.col("nth"))
            .select(F.col("id").alias(id_col), "segment", "start", "length",
                    per_bucket([int(x) for x in bounds]).cast("long").alias("bucket"),
                    F.col("at").cast("long").alias("at"), size.alias("size"))
            .select(id_col, "segment", "start", "length", "bucket", F.floor(F.col("at") / F.col("size")).alias("batch"),
                    F.pmod("at", "size").alias("slot")))
