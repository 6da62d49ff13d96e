"""Array math over logits rows (M-1..M-5, W-6, W-9, W-10).

A logits row is ``array<double>`` (one position's scores over the vocabulary).
Row-level reductions (max, log-sum-exp, k-th largest) are bound once with
``let`` so that element lambdas read a value instead of recomputing it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import col_of, let

NEG_INF = float("-inf")


def _dbl(c) -> Column:
    return col_of(c).cast("array<double>")


def array_sum(c) -> Column:
    return F.aggregate(col_of(c), F.lit(0.0).cast("double"), lambda a, x: a + x)


def logsumexp(logits) -> Column:
    """Stable ``log(sum(exp(l)))``."""
    def body(v):
        return let(F.array_max(v), lambda m: m + F.log(array_sum(F.transform(v, lambda x: F.exp(x - m)))))
    return let(_dbl(logits), body)


def softmax(logits) -> Column:
    """M-1: stable softmax."""
    def body(v):
        e = let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))
        return let(e, lambda ev: let(array_sum(ev), lambda s: F.transform(ev, lambda x: x / s)))
    return let(_dbl(logits), body)


def log_softmax(logits) -> Column:
    """M-1: ``l - logsumexp(l)``."""
    return let(_dbl(logits), lambda v: let(logsumexp(v), lambda z: F.transform(v, lambda x: x - z)))


def cross_entropy(logits, target, ignore_index) -> Column:
    """M-2 (no reduction): ``logsumexp(l) - l[target]``; 0.0 where ``target == ignore_index``."""
    t = col_of(target)
    ig = F.lit(ignore_index) if isinstance(ignore_index, int) else col_of(ignore_index)
    xent = let(_dbl(logits), lambda v: logsumexp(v) - F.get(v, t))
    return F.when(t == ig, F.lit(0.0)).otherwise(xent)


def temperature(logits, t: float) -> Column:
    """M-3: divide by the temperature (callers choose the greedy switch, see ``decode_mode``)."""
    return F.transform(_dbl(logits), lambda x: x / F.lit(float(t)))


def decode_mode(t: float, entry: str = "generate") -> tuple[str, float]:
    """M-3's two rules: ``generate``: t == 0 is greedy. ``generate_super``: t <= 0 -> 0.001, then t < 0.1 is greedy."""
    if entry == "generate":
        return ("greedy", t) if t == 0.0 else ("sample", t)
    t = 0.001 if t <= 0 else t
    return ("greedy", t) if t < 0.1 else ("sample", t)


def kth_largest(logits, k: int) -> Column:
    """Value of the k-th largest element (k capped at the array size)."""
    return let(_dbl(logits), lambda v: F.get(F.sort_array(v, asc=False), F.least(F.lit(k), F.size(v)) - 1))


def topk_filter(logits, k: int) -> Column:
    """W-6: values below the k-th largest become -inf (ties with it are kept)."""
    def body(v):
        return let(F.get(F.sort_array(v, asc=False), F.least(F.lit(k), F.size(v)) - 1),
                   lambda thr: F.transform(v, lambda x: F.when(x < thr, F.lit(NEG_INF)).otherwise(x)))
    return let(_dbl(logits), body)


def greedy_next(logits) -> Column:
    """W-9: index of the maximum (first of ties)."""
    return let(_dbl(logits), lambda v: F.array_position(v, F.array_max(v)) - 1).cast("int")


def uniform_from_hash(*parts) -> Column:
    """A reproducible uniform in [0, 1) from md5 of the parts joined by ':' (52 bits)."""
    key = F.concat_ws(":", *[col_of(p).cast("string") if not isinstance(p, (int, str)) else F.lit(str(p))
                             for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint").cast("double") / float(16 ** 13)


def sample_index(probs, u) -> Column:
    """W-10 draw: first index whose running sum exceeds ``u * total`` (a multinomial draw of one).

    One left fold, O(vocab) per row. A zero-probability tail is never picked.
    """
    uu = col_of(u)

    def body(v):
        total = array_sum(v)
        init = F.struct(F.lit(0.0).alias("acc"), F.lit(-1).alias("pick"), F.lit(0).alias("i"))

        def step(s, x):
            acc = s.getField("acc") + x
            pick = F.when((s.getField("pick") < 0) & (acc > uu * total) & (x > 0), s.getField("i")) \
                .otherwise(s.getField("pick"))
            return F.struct(acc.alias("acc"), pick.alias("pick"), (s.getField("i") + 1).alias("i"))
        res = F.aggregate(v, init, step)
        # rounding can leave the draw just past the last mass: take the last positive entry
        last_pos = F.size(v) - 1 - F.array_position(F.reverse(F.transform(v, lambda x: x > 0)), True) + 1
        return F.when(res.getField("pick") >= 0, res.getField("pick")).otherwise(last_pos)
    return let(_dbl(probs), body).cast("int")


def seeded_sample(logits, t: float, top_k: int | None, seed, row_id, step=0) -> Column:
    """W-10: temperature, W-6 filter, softmax, one draw from a hash of (seed, row, step)."""
    l = temperature(logits, t)
    if top_k is not None and top_k >= 1:
        l = topk_filter(l, top_k)
    return sample_index(softmax(l), uniform_from_hash(seed, row_id, step))
