"""Training rows (B-ROW-7, B-ROW-8, B-ROW-9, B-ROW-11, B-ROW-13).

Both row builders are one narrow stage: render, encode, cut, pad, mask and
shift run per row with no shuffle. The encoder is a parameter: any function
``Column(text) -> Column(array<int>)`` (the code-point encoder, or a trained
BPE tokenizer's ``encoder()``).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import chat as C
from quire.functions import ids as I

Encoder = Callable[[Column], Column]


def _keep(df: DataFrame, keep) -> list[str]:
    return list(keep) if keep is not None else []


def pretrain_rows(df: DataFrame, text: str = "text", encoder: Encoder = I.codepoint_ids,
                  max_length: int = 512, pad_id: int = I.PAD_ID, keep=None) -> DataFrame:
    """B-ROW-7: R-3 -> encode -> B-ROW-1..4.

    Output: ``X, Y, loss_mask`` (``array<bigint>``, ``max_length-1`` long) plus
    ``n_tokens`` (before the cut) and ``text_len`` (after it).
    """
    keep = _keep(df, keep)
    enc = df.select(*keep, encoder(C.render_pretrain(F.col(text))).alias("_full"))
    # wide numbers before the padding, not after it
    cut = enc.select(*keep, F.size("_full").alias("n_tokens"), I.truncate_ids("_full", max_length).cast("array<bigint>").alias("_ids"))
    padded = cut.select(*keep, "n_tokens", F.size("_ids").alias("text_len"), I.pad_ids("_ids", max_length, pad_id, "bigint").alias("_pad"),
                        I.length_mask("_ids", max_length, "bigint").alias("_mask"))
    x, y, m = I.shift("_pad", "_mask")
    return padded.select(*keep, "n_tokens", "text_len", x.alias("X"), y.alias("Y"), m.alias("loss_mask"))


def sft_rows(df: DataFrame, messages: str = "messages", encoder: Encoder = I.codepoint_ids,
             header_ids: list[int] | None = None, max_length: int = 512, pad_id: int = I.PAD_ID,
             eos_id: int = I.EOS_ID, keep=None) -> DataFrame:
    """B-ROW-8: R-1 -> encode -> B-ROW-1, 2, 5, 4.

    ``header_ids`` is the encoding of ``<|im_start|>assistant\\n`` under the
    same encoder, computed once (not per row).
    """
    keep = _keep(df, keep)
    header = header_ids if header_ids is not None else I.codepoint_header(C.ASSISTANT_HEADER)
    enc = df.select(*keep, encoder(C.render_chatml(F.col(messages))).alias("_full"))
    cut = enc.select(*keep, F.size("_full").alias("n_tokens"), I.truncate_ids("_full", max_length).alias("_ids"))
    padded = cut.select(*keep, "n_tokens", F.size("_ids").alias("text_len"),
                        I.pad_ids("_ids", max_length, pad_id).alias("_pad"))
    x, y, m = I.shift("_pad", I.assistant_mask("_pad", header, eos_id))
    return padded.select(*keep, "n_tokens", "text_len", x.alias("X"), y.alias("Y"), m.alias("loss_mask"))


def sft_rows_from_turns(long_df: DataFrame, key: str = "conv_id", order: str = "turn", sender: str = "role",
                        text: str = "text", system: str = C.DEFAULT_SYSTEM, sender_map: dict[str, str] | None = None,
                        encoder: Encoder = I.codepoint_ids, header_ids: list[int] | None = None,
                        max_length: int = 512, pad_id: int = I.PAD_ID, eos_id: int = I.EOS_ID) -> DataFrame:
    """B-ROW-8 from turn-per-row input, without gathering long conversations.

    The row itself needs only the first turns (each costs at least four
    tokens). ``n_tokens`` of the whole conversation is a partial sum of its
    turns' own token counts: special tokens part them, so counts add up.
    Equal to ``sft_rows(collect_messages(...))`` in every column.
    """
    from quire.operators import reshape as R
    role = C.rename_role(R.mapped_sender(sender, sender_map))

    def size_of(r, content):
        one = F.array(F.struct(r.alias("role"), content.alias("content")))
        return F.size(encoder(C.render_chatml(one)))

    turns = long_df.select(key, role.alias("_role"), F.col(text).alias("_text"))
    sizes = turns.select(key, "_role", size_of(F.coalesce("_role", F.lit("tool")), F.col("_text")).alias("_n"))
    totals = sizes.groupBy(key).agg(F.sum(F.when(F.col("_role").isNotNull(), F.col("_n")).otherwise(0)).alias("_turns"),
                                    F.count_if(F.col("_role").isNull()).cast("int").alias("dropped_turns"))
    # the system message's own count is one value: encoded once, not per conversation
    alone_size = long_df.sparkSession.range(1).select(size_of(F.lit("system"), F.lit(system)).alias("_system"))
    totals = totals.crossJoin(F.broadcast(alone_size)).withColumn("_n", F.col("_turns") + F.col("_system")).drop("_system")
    known = R.first_messages(long_df, R.sft_max_turns(max_length), key, order, sender, text, system, sender_map)
    alone = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    joined = (totals.join(known.select(F.col(key).alias("_key"), "messages"), F.col(key).eqNullSafe(F.col("_key")), "left")
              .withColumn("messages", F.coalesce("messages", alone)))
    rows = sft_rows(joined, "messages", encoder, header_ids, max_length, pad_id, eos_id, keep=[key, "dropped_turns", "_n"])
    return rows.withColumn("n_tokens", F.col("_n").cast("int")).drop("_n")


def segment_rows(df: DataFrame, messages: str = "messages", encoder: Encoder = I.codepoint_ids,
                 eos: str = C.EOS, max_length: int = 512, pad_id: int = I.PAD_ID, keep=None,
                 array_encoder: Encoder | None = None) -> DataFrame:
    """B-ROW-6 rows: R-5 segments encoded one by one, mask from the trainable flags.

    The robust variant of B-ROW-5: no header search, so no merge across a
    segment boundary can hide an answer. ``array_encoder`` takes all of a row's
    segments at once (``array<string>`` to ``array<array<int>>``), as a trained
    tokenizer's ``array_encoder()`` does; by default ``encoder`` maps over them.
    """
    keep = _keep(df, keep)
    array_encoder = array_encoder or (lambda texts: F.transform(texts, encoder))
    segs = df.select(*keep, C.render_segments(F.col(messages), eos).alias("_segs"))
    enc = segs.select(*keep, "_segs", array_encoder(F.transform("_segs", lambda s: s.getField("text"))).alias("_ids"))
    enc = enc.select(*keep, F.zip_with("_segs", "_ids", lambda s, i: F.struct(
        i.alias("ids"), s.getField("trainable").alias("trainable"))).alias("_enc"))
    flat = enc.select(*keep, F.flatten(F.transform("_enc", lambda s: s.getField("ids"))).alias("_full"),
                      I.segment_mask("_enc").alias("_flag"))
    cut = flat.select(*keep, F.size("_full").alias("n_tokens"),
                      I.truncate_ids("_full", max_length).alias("_ids"),
                      I.truncate_ids("_flag", max_length).alias("_m"))
    x, y, m = I.shift(I.pad_ids("_ids", max_length, pad_id), I.pad_ids("_m", max_length, 0))
    return cut.select(*keep, "n_tokens", F.size("_ids").alias("text_len"),
                      x.alias("X"), y.alias("Y"), m.alias("loss_mask"))


def bert_style_inputs(df: DataFrame, ids: str = "ids", max_len: int = 512, pad_id: int = 0,
                      keep=None) -> DataFrame:
    """B-ROW-9: truncate, pad (0 by default) and a 1/0 attention mask."""
    keep = _keep(df, keep)
    cut = df.select(*keep, I.truncate_ids(ids, max_len).alias("_ids"))
    return cut.select(*keep, I.pad_ids("_ids", max_len, pad_id).alias("input_ids"),
                      I.length_mask("_ids", max_len).alias("attention_mask"))


def left_pad_pack(df: DataFrame, ids: str = "ids", mask: str = "mask", batch_col: str = "batch_id",
                  pad_id: int = I.PAD_ID) -> DataFrame:
    """B-ROW-11: per batch, drop masked tokens and right-align to the longest valid length (min 1).

    A batch whose masks are all true is returned unchanged; an absent (null)
    mask counts as all true. Batches are bounded (the batch size), so the
    per-batch window is bounded too.
    """
    w = Window.partitionBy(batch_col)
    df = df.withColumn(mask, F.coalesce(mask, F.transform(ids, lambda x: F.lit(True))))
    valid = I.valid_ids(ids, mask)
    n_valid = F.size(F.filter(F.col(mask), lambda x: x))
    all_true = F.forall(F.col(mask), lambda x: x)
    staged = (df.withColumn("_valid", valid)
              .withColumn("_nv", n_valid)
              .withColumn("_batch_all", F.min(all_true.cast("int")).over(w) == 1)
              .withColumn("_len", F.greatest(F.max("_nv").over(w), F.lit(1))))
    packed = I.left_pad_to("_valid", F.col("_len"), pad_id)
    packed_mask = F.concat(F.array_repeat(F.lit(False), F.col("_len") - F.col("_nv")),
                           F.array_repeat(F.lit(True), F.col("_nv")))
    return (staged.withColumn(ids, F.when(F.col("_batch_all"), F.col(ids)).otherwise(packed))
            .withColumn(mask, F.when(F.col("_batch_all"), F.col(mask)).otherwise(packed_mask))
            .drop("_valid", "_nv", "_batch_all", "_len"))


def length_report(rows: DataFrame, group: list[str], max_length: int = 512) -> DataFrame:
    """B-ROW-13: per group row count, token sums, mean, max, median and share truncated.

    The median is exact; its state is a count per distinct length, which is
    bounded by ``max_length``.
    """
    text_len = F.col("text_len")
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(text_len).alias("sum_text_len"),
        F.sum(F.lit(max_length) - text_len).alias("sum_padding_len"),
        F.round(F.avg(text_len), 6).alias("avg_text_len"),
        F.max(text_len).alias("max_text_len"),
        F.percentile(text_len, 0.5).alias("median_text_len"),
        F.round(F.avg((F.col("n_tokens") > max_length).cast("double")), 6).alias("share_truncated"))
