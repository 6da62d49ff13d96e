"""Text scalars: previews, answer extraction, cuts (P-8, P-11, P-12, A-1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import col_of

# Python's str.split()/str.strip() whitespace: Unicode White_Space plus the four
# information separators U+001C..U+001F. Java needs (?U) for Unicode \s.
WS = r"[\s\x{1c}-\x{1f}]"


def squash_whitespace(c) -> Column:
    """Whitespace runs -> one space, stripped at both ends (``' '.join(s.split())``)."""
    c = col_of(c)
    one = F.regexp_replace(c, F.lit(f"(?U){WS}+"), F.lit(" "))
    return F.regexp_replace(one, F.lit(f"(?U)^{WS}+|{WS}+$"), F.lit(""))


def strip_ws(c) -> Column:
    """``str.strip()`` with Python's whitespace set (Spark ``trim`` cuts spaces only)."""
    return F.regexp_replace(col_of(c), F.lit(f"(?U)^{WS}+|{WS}+$"), F.lit(""))


def shorten(c, max_chars: int = 80) -> Column:
    """P-11 cell: squash whitespace; longer than ``max_chars`` -> first ``max_chars-3`` + '...'."""
    s = squash_whitespace(c)
    return F.when(F.length(s) <= max_chars, s).otherwise(
        F.concat(F.substring(s, 1, max_chars - 3), F.lit("...")))


def truncate_text(c, n: int = 120) -> Column:
    """P-12: plain cut to ``n`` code points, no ellipsis."""
    return F.substring(col_of(c), 1, n)


def extract_ground_truth(c, pattern: str = r"####\s*(-?\d+)") -> Column:
    """P-8: first match of ``pattern`` group 1; no match -> null.

    Python's ``\\d``/``\\s`` are Unicode-aware on str patterns, hence ``(?U)``.
    """
    return F.nullif(F.regexp_extract(col_of(c), "(?U)" + pattern, 1), F.lit(""))


def boxed_answer(c) -> Column:
    """A-1: first non-greedy ``\\boxed{...}`` content, stripped; none -> ''.

    ``(?d)``: like Python, ``.`` stops only at ``\\n`` (Java also stops at ``\\r``
    and U+2028 without it).
    """
    inner = F.regexp_extract(col_of(c), r"(?d)\\boxed\{(.*?)\}", 1)
    return strip_ws(inner)


def first_content(c) -> Column:
    """Completion given as a message list: the first item's ``content``."""
    return F.get(col_of(c), 0).getField("content")
