"""Next-token tables and single beam steps (G-1, G-3, J-5, W-7).

A count-based next-token table derived from the corpus: ``(context array<int>,
next int, cnt, logprob)``. Extending and pruning beams are one join and one
bounded window. Token-by-token decoding loops (W-8, G-2) belong to a model's
runtime and are not replayed here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import let
from quire.functions import text as T

_ID_BITS = 21
ID_MAX = (1 << _ID_BITS) - 2  # ids are stored plus one, so that an empty slot differs from id 0


def _slot(x):
    """An id as a non-zero slot of a context key; an id out of range stops the job."""
    x = x.cast("bigint")
    bad = F.raise_error(F.concat(F.lit(f"token id outside 0..{ID_MAX}: "), x.cast("string"))).cast("bigint")
    return F.when((x < 0) | (x > ID_MAX), bad).otherwise(x + 1)


def context_key(tokens, order: int):
    """The last ``order`` tokens packed into one bigint (the table's join key).

    ``order`` up to 3 fits in 63 bits; grouping and joining on a long is far
    cheaper than on an ``array<int>``. A shorter sequence leaves its upper slots
    empty, so its key is no full context's key.
    """
    if order > 3:
        raise ValueError("context keys pack at most 3 ids")
    t = F.col(tokens) if isinstance(tokens, str) else tokens

    def body(v):
        ctx = F.slice(v, F.greatest(F.size(v) - (order - 1), F.lit(1)), F.lit(order))
        return F.aggregate(ctx, F.lit(0).cast("bigint"),
                           lambda acc, x: F.shiftleft(acc, _ID_BITS).bitwiseOR(_slot(x)))
    return let(t, body)


def unpack_context(key, order: int):
    """Inverse of ``context_key`` for full contexts: ``array<int>`` of ``order`` ids."""
    k = F.col(key) if isinstance(key, str) else key
    mask = (1 << _ID_BITS) - 1
    return F.array(*[(F.shiftright(k, (order - 1 - j) * _ID_BITS).bitwiseAND(mask) - 1).cast("int") for j in range(order)])


def next_token_table(df: DataFrame, ids: str = "ids", order: int = 1) -> DataFrame:
    """G-1: ``(context, ckey, next, cnt, logprob)`` with ``logprob = ln(cnt / count(context))``.

    Pairs are emitted per row (no self-join), counted with a partial
    aggregation on a packed bigint context, and the per-context totals (one
    row per context) are joined back; a hot context is combined map-side
    before any shuffle.
    """
    # order + 1 shifted views of the row's ids, zipped: one struct per position
    n = F.size(ids)
    views = [F.slice(ids, j + 1, F.greatest(n - order, F.lit(0))).alias(f"c{j}") for j in range(order + 1)]
    z = df.select(F.explode(F.arrays_zip(*views)).alias("p"))
    key = F.lit(0).cast("bigint")
    for j in range(order):
        key = F.shiftleft(key, _ID_BITS).bitwiseOR(_slot(F.col(f"p.c{j}")))
    p = z.select(key.alias("ckey"), F.col(f"p.c{order}").alias("next"))
    counts = p.groupBy("ckey", "next").agg(F.count(F.lit(1)).alias("cnt"))
    totals = counts.groupBy("ckey").agg(F.sum("cnt").alias("_tot"))
    return counts.join(totals, "ckey").select(
        unpack_context("ckey", order).alias("context"), "ckey", "next", "cnt",
        F.log(F.col("cnt") / F.col("_tot")).alias("logprob"))


def greedy_table(table: DataFrame) -> DataFrame:
    """Per context the most likely next token (first of ties = smallest id), one row per context."""
    best = F.max_by("next", F.struct(F.col("cnt"), -F.col("next")))
    return table.groupBy("ckey").agg(best.alias("next"))


def top_next(table: DataFrame, k: int) -> DataFrame:
    """Per context the ``k`` most likely next tokens, ranked 0..k-1 (ties by id).

    The window's partition is one context, bounded by the vocabulary size.
    """
    w = Window.partitionBy("ckey").orderBy(F.desc("logprob"), F.asc("next"))
    return table.withColumn("k", F.row_number().over(w) - 1).filter(F.col("k") < k)


def beam_extend(beams: DataFrame, cands: DataFrame, order: int = 1) -> DataFrame:
    """J-5: every live beam joined with its context's candidates; score += logprob."""
    keyed = beams.withColumn("ckey", context_key("tokens", order))
    j = keyed.join(cands.select("ckey", "next", "logprob", "k"), "ckey")
    return j.select("prompt_id", F.col("beam_id").alias("parent"), "k",
                    F.concat("tokens", F.array(F.col("next"))).alias("tokens"),
                    (F.col("score") + F.col("logprob")).alias("score"),
                    *[c for c in beams.columns if c not in ("prompt_id", "beam_id", "tokens", "score")])


def beam_prune(cands: DataFrame, num_beams: int) -> DataFrame:
    """W-7: best ``num_beams`` per prompt by score; ties by (parent beam, candidate rank).

    A prompt has at most ``num_beams**2`` candidates, so the window is bounded.
    """
    w = Window.partitionBy("prompt_id").orderBy(F.desc("score"), F.asc("parent"), F.asc("k"))
    return (cands.withColumn("beam_id", F.row_number().over(w) - 1)
            .filter(F.col("beam_id") < num_beams).drop("parent", "k"))


def qa_report(questions: DataFrame, answers: DataFrame, key: str, question: str = "question",
              answer: str = "answer", max_chars: int | None = None) -> DataFrame:
    """G-3: numbered input/output pairs (P-13 numbering in key order, then a join)."""
    from quire.operators.reshape import number_rows
    numbered = number_rows(questions, [key], "number")
    q = T.shorten(question, max_chars) if max_chars else F.col(question)
    return numbered.join(answers, key, "left").select("number", key, q.alias("question"), F.col(answer).alias("answer"))
