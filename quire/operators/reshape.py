"""Row reshaping (P-1, P-3, P-7, P-9, P-10, P-11, P-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import chat as C
from quire.functions import text as T


def chunk_text(df: DataFrame, text: str = "text", size: int = 512,
               index_col: str = "chunk_id") -> DataFrame:
    """P-1: non-overlapping slices of ``size`` code points; the last may be short.

    Empty (and null) text gives no row. One regex pass per text (Java's ``.``
    is a code point, ``(?s)`` lets it cross newlines); no shuffle.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{int(size)}}}"), 0)
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(pieces).alias(index_col, text))


def mapped_sender(sender: str, sender_map: dict[str, str] | None) -> Column:
    """The sender's name after ``sender_map`` (names it does not hold stay)."""
    s = F.col(sender)
    for k, v in reversed((sender_map or {}).items()):
        s = F.when(F.col(sender) == k, F.lit(v)).otherwise(s)
    return s


def collect_turns(long_df: DataFrame, key: str = "conv_id", order: str = "turn",
                  sender: str = "role", text: str = "text",
                  sender_map: dict[str, str] | None = None) -> DataFrame:
    """P-3 input side: turn-per-row -> ``array<struct<from, value>>`` per ``key`` in ``order``.

    ``sender_map`` rewrites sender names first (e.g. ``user`` -> ``human``).
    The array is the output row itself; it is built by one hash aggregation
    with map-side partial lists.
    """
    s = mapped_sender(sender, sender_map)
    turns = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), s.alias("from"),
                                                 F.col(text).alias("value"))))
    return (long_df.groupBy(key)
            .agg(turns.alias("_t"))
            .select(key, F.transform("_t", lambda t: F.struct(t.getField("from").alias("from"),
                                                              t.getField("value").alias("value")))
                    .alias("conversations")))


def first_turns(long_df: DataFrame, n: int, key: str = "conv_id", order: str = "turn",
                bucket: int = 1024) -> DataFrame:
    """The first ``n`` rows of every ``key`` in ``order``, without gathering a whole group.

    Rows are counted per (key, order bucket) with a partial aggregation; a
    small table (one row per key and bucket) finds, per key, the bucket that
    holds the n-th row; rows past it are dropped before any shuffle of the
    turns. At most ``n + bucket`` rows per key remain; the exact cut to ``n``
    is left to the consumer (``first_messages`` slices). ``order`` must be
    an integer position. The bucket table of a hot key is ``bucket`` times
    smaller than the key's rows.
    """
    b = F.floor(F.col(order) / bucket).cast("bigint")
    counts = long_df.groupBy(key, b.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    keep = before.filter(F.col("_before") < n).select(key, "_b")
    turns = long_df.withColumn("_b", b)
    same = turns[key].eqNullSafe(keep[key]) & (turns["_b"] == keep["_b"])
    return turns.join(keep, same, "left_semi").drop("_b")


def collect_messages(long_df: DataFrame, key: str = "conv_id", order: str = "turn",
                     sender: str = "role", text: str = "text", system: str = C.DEFAULT_SYSTEM,
                     sender_map: dict[str, str] | None = None) -> DataFrame:
    """P-3: the same messages P-2 would give, from turn-per-row input.

    The message list is the output row, so a conversation is gathered whole;
    where a row only needs its first turns, use ``first_messages``.
    """
    turns = collect_turns(long_df, key, order, sender, text, sender_map)
    return turns.select(key, C.to_messages("conversations", system).alias("messages"),
                        C.dropped_turns("conversations").alias("dropped_turns"))


def first_messages(long_df: DataFrame, max_turns: int, key: str = "conv_id", order: str = "turn",
                   sender: str = "role", text: str = "text", system: str = C.DEFAULT_SYSTEM,
                   sender_map: dict[str, str] | None = None) -> DataFrame:
    """The system message and the first ``max_turns`` known turns per key, never gathering a long
    conversation; a key without known turns gives no row."""
    known = long_df.filter(C.rename_role(mapped_sender(sender, sender_map)).isNotNull())
    turns = collect_turns(first_turns(known, max_turns, key, order), key, order, sender, text, sender_map)
    cut = F.slice("conversations", 1, max_turns)
    return turns.select(key, C.to_messages(cut, system).alias("messages"))


def drop_columns(df: DataFrame, *cols: str) -> DataFrame:
    """P-7: remove columns after mapping (Catalyst prunes them from the scan)."""
    return df.drop(*cols)


def preference_pairs(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected",
                     keep: tuple[str, ...] = (), max_chars: int | None = None) -> DataFrame:
    """P-9: first user turn of ``chosen``, first assistant turn of ``chosen`` and ``rejected``.

    A missing turn is null (the reference stops with an error) and ``complete``
    is false so the caller can count such rows. ``max_chars`` applies P-12.
    """
    user = C.first_of_role(chosen, "user")
    ch = C.first_of_role(chosen, "assistant")
    rj = C.first_of_role(rejected, "assistant")
    if max_chars is not None:
        ch, rj = T.truncate_text(ch, max_chars), T.truncate_text(rj, max_chars)
    return df.select(*keep, user.alias("user"), ch.alias("chosen"), rj.alias("rejected"),
                     (user.isNotNull() & ch.isNotNull() & rj.isNotNull()).alias("complete"))


def first_turn(long_df: DataFrame, role: str, key: str = "conv_id", order: str = "turn",
               role_col: str = "role", text: str = "text", out: str | None = None) -> DataFrame:
    """P-10 on turn-per-row data: the earliest message of ``role`` per ``key``.

    ``min_by`` is a partial aggregate, so a very long conversation does not
    pile up in one task.
    """
    out = out or f"first_{role}"
    return (long_df.filter(F.col(role_col) == role)
            .groupBy(key).agg(F.min_by(text, order).alias(out)))


def preview(df: DataFrame, cols: dict[str, object], n: int = 3, max_chars: int = 80,
            order: list[str] | None = None) -> DataFrame:
    """P-11: first ``min(n, rows)`` rows in ``order``, each cell shortened.

    The limit is the feature; ``orderBy().limit()`` plans as a top-n per
    partition plus one merge of ``n`` rows.
    """
    base = df.orderBy(*order) if order else df
    head = base.limit(n)
    return head.select(*(order or []), *[T.shorten(v if not isinstance(v, str) else F.col(v), max_chars).alias(k)
                                         for k, v in cols.items()])


def number_rows(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """P-13: 1-based numbering in ``order`` without a single-partition window; equal keys get
    consecutive numbers."""
    from quire.operators.split import unused, with_global_index
    at = unused(df, "_idx")
    return with_global_index(df, order, at).withColumn(name, F.col(at) + 1).drop(at)


def sft_max_turns(max_length: int = 512) -> int:
    """Known turns that can reach a training row of ``max_length`` tokens.

    Every rendered message costs at least four tokens (bos, its role, eos and
    the closing newline, which special tokens keep apart from its neighbours),
    so no message past position ``max_length // 4`` can appear in the row.
    """
    return max_length // 4
