"""Token-id array expressions: the training-row builders (B-ROW-*, P-14).

Everything here is ``array<int>`` in, array out, evaluated per row inside
whole-stage codegen. Arrays that a lambda reads more than once are bound with
``let`` so that Catalyst's project collapsing cannot re-run the producer for
every element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import col_of, int_array, let
from quire.functions.chat import BOS, EOS

# Fixed special-token contract (id order is part of it).
SPECIAL_TOKENS = ("<unk>", "<s>", "</s>", "<|im_start|>", "<|im_end|>")
UNK_ID, BOS_ID, EOS_ID = 0, 3, 4
PAD_ID = EOS_ID  # pad is eos

_EMPTY_INT = "array<int>"


# ---------------------------------------------------------------- code-point encoder
_CP_PATTERN = r"<\|im_start\|>|<\|im_end\|>|(?s)."


def codepoint_ids(text) -> Column:
    """Encoder used where a SQL oracle must agree: one id per code point.

    ``<|im_start|>`` and ``<|im_end|>`` spelled in the text become ids 3 and 4,
    as a trained tokenizer would do with its special tokens.
    """
    t = col_of(text)
    pieces = F.regexp_extract_all(t, F.lit(_CP_PATTERN), 0)
    special = F.transform(pieces, lambda p: F.when(p == BOS, F.lit(BOS_ID))
                          .when(p == EOS, F.lit(EOS_ID)).otherwise(F.ascii(p)))
    # fast path: most texts spell no special token; split('') yields code points
    plain = F.transform(F.split(t, ""), lambda c: F.ascii(c))
    return (F.when(t.contains("<|im_"), special)
            .when(F.length(t) == 0, F.array().cast(_EMPTY_INT))
            .otherwise(plain))


def codepoint_header(text: str = "<|im_start|>assistant\n") -> list[int]:
    """The code-point encoding of a header string, computed in Python."""
    out, i = [], 0
    while i < len(text):
        if text.startswith(BOS, i):
            out.append(BOS_ID); i += len(BOS)
        elif text.startswith(EOS, i):
            out.append(EOS_ID); i += len(EOS)
        else:
            out.append(ord(text[i])); i += 1
    return out


# ---------------------------------------------------------------- row builders
def truncate_ids(ids, max_length: int = 512) -> Column:
    """B-ROW-1: first ``max_length`` ids."""
    return F.slice(col_of(ids), 1, max_length)


def _once(c, body) -> Column:
    """``body`` of a column that is named as it is, compiled; of any other bound by ``let``, which is interpreted."""
    return body(F.col(c)) if isinstance(c, str) else let(c, body)


def pad_ids(ids, max_length: int = 512, pad_id: int = PAD_ID, kind: str = "int") -> Column:
    """B-ROW-2: right padding to ``max_length`` (longer input is left as is); ``kind`` is the ids' type."""
    return _once(ids, lambda v: F.concat(v, F.array_repeat(F.lit(pad_id).cast(kind), F.lit(max_length) - F.size(v))))


def length_mask(ids, max_length: int = 512, kind: str = "int") -> Column:
    """B-ROW-3: 1 per real token, 0 per padding position, by length only."""
    n = F.size(col_of(ids))
    return F.concat(F.array_repeat(F.lit(1).cast(kind), n), F.array_repeat(F.lit(0).cast(kind), F.lit(max_length) - n))


def shift(ids, mask) -> tuple[Column, Column, Column]:
    """B-ROW-4: ``X = ids[:-1]``, ``Y = ids[1:]``, ``loss_mask = mask[1:]`` as bigint arrays."""
    def head(v):
        return F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0)))

    def tail(v):
        return F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0)))
    x = _once(ids, head).cast("array<bigint>")
    y = _once(ids, tail).cast("array<bigint>")
    m = _once(mask, tail).cast("array<bigint>")
    return x, y, m


def header_starts(v: Column, header: list[int]) -> Column:
    """0-based positions where ``header`` occurs in the bound array ``v``."""
    L = len(header)
    hdr = int_array(header)
    n = F.size(v)
    idx = F.when(n >= L, F.sequence(F.lit(0), n - L)).otherwise(F.array().cast(_EMPTY_INT))
    return F.filter(idx, lambda i: (F.get(v, i) == header[0]) & (F.slice(v, i + 1, L) == hdr))


def assistant_mask(ids, header: list[int], eos_id: int = EOS_ID) -> Column:
    """B-ROW-5: 1 from the end of each assistant header through the first eos (inclusive).

    Every header occurrence opens a span (the scan resumes right after the
    header, so a header inside a span opens its own); a header with no eos
    after it marks nothing. Runs on the padded ids, so padding (= eos) can
    close a span. The header begins with bos, which it does not contain again,
    so occurrences never overlap and "all occurrences" is the scan's result.
    """
    L = len(header)

    def spans_of(v):
        n = F.size(v)

        def span(s):
            rest = F.slice(v, s + L + 1, F.greatest(n - s - L, F.lit(1)))
            pos = F.array_position(rest, eos_id)
            return F.struct((s + L).alias("lo"), F.when(pos > 0, s + L + pos - 1).alias("hi"))
        sp = F.filter(F.transform(header_starts(v, header), span), lambda x: x.getField("hi").isNotNull())
        return F.struct(n.alias("n"), sp.alias("spans"))

    def mark(b):
        n, spans = b.getField("n"), b.getField("spans")
        return F.aggregate(spans, F.array_repeat(F.lit(0), n),
                           lambda acc, sp: F.transform(acc, lambda x, i: F.when(
                               (i >= sp.getField("lo")) & (i <= sp.getField("hi")), F.lit(1)).otherwise(x)))
    return let(let(col_of(ids), spans_of), mark)


def segment_mask(segment_ids) -> Column:
    """B-ROW-6: per-token flag from segments ``array<struct<ids:array<int>, trainable:boolean>>``."""
    return F.flatten(F.transform(col_of(segment_ids), lambda s: F.array_repeat(
        s.getField("trainable").cast("int"), F.size(s.getField("ids")))))


def attention_mask(ids, max_len: int) -> Column:
    """B-ROW-9 mask: 1 for the (truncated) real tokens, 0 for padding."""
    return length_mask(truncate_ids(ids, max_len), max_len)


def normalise_mask(mask, ids) -> Column:
    """B-ROW-10: ``> 0`` to boolean; a size that differs from the ids' size raises."""
    m = col_of(mask)
    ok = F.size(m) == F.size(col_of(ids))
    return F.when(ok, F.transform(m, lambda x: x > 0)).otherwise(
        F.raise_error(F.lit("attention mask size must match the ids' size")))


def valid_ids(ids, mask) -> Column:
    """B-ROW-11 step: ids whose mask is true, in order."""
    return let(F.struct(col_of(ids).alias("v"), col_of(mask).alias("m")),
               lambda b: F.filter(b.getField("v"), lambda x, i: F.get(b.getField("m"), i)))


def left_pad_to(ids, length, pad_id: int = PAD_ID) -> Column:
    """Right-align ``ids`` in ``length`` slots with ``pad_id`` in front."""
    return let(col_of(ids), lambda v: F.concat(F.array_repeat(F.lit(pad_id), length - F.size(v)), v))


def last_valid_position(mask, side: str = "right") -> Column:
    """B-ROW-12: index read as the last real token.

    ``right`` (as the reference computes it): ``max(sum(mask), 1) - 1``.
    ``left``: the last index, which is right for left-padded rows.
    """
    m = col_of(mask)
    if side == "left":
        return F.greatest(F.size(m) - 1, F.lit(0))
    s = F.aggregate(m, F.lit(0), lambda acc, x: acc + F.when(x.cast("boolean"), 1).otherwise(0))
    return F.greatest(s, F.lit(1)) - 1


def context_tail(ids, max_seq_len: int = 512) -> Column:
    """B-ROW-14: the last ``max_seq_len`` ids when longer."""
    return let(col_of(ids), lambda v: F.slice(v, F.greatest(F.lit(1), F.size(v) - (max_seq_len - 1)),
                                              F.lit(max_seq_len)))


def strip_prompt(output_ids, input_ids) -> Column:
    """P-14: the generated part, i.e. ids after the input's length."""
    n = F.size(col_of(input_ids))
    return let(col_of(output_ids), lambda v: F.slice(v, n + 1, F.greatest(F.size(v) - n, F.lit(0))))


def stop_fill(ids, stop_id: int, pad_id: int = PAD_ID) -> Column:
    """M-5: every id after the first ``stop_id`` becomes ``pad_id``; the stop stays."""
    def body(b):
        v, p = b.getField("v"), b.getField("p")
        return F.transform(v, lambda x, i: F.when((p > 0) & (i >= p), F.lit(pad_id)).otherwise(x))
    return let(col_of(ids), lambda v: let(F.struct(v.alias("v"), F.array_position(v, stop_id).alias("p")), body))
