"""Quality rules as a bitmask ledger (DataFrame functions only).

``ledger`` evaluates every rule once per document and stores its measurements and one
bit per failed rule. ``apply_policy`` turns the bits into a verdict with a versioned policy
(a set of rules), so a new policy never reads the texts again. ``ablation`` counts, from
the bits alone, what each rule of each policy does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import let, whole_text, words

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs", "n_lines")

# Rule -> failed when true, over the measurements. The bit of a rule is its place here; append only.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "shouting": "2 * n_upper > word_chars",
    "exclamations": "4 * n_bangs > n_words",
}

BASE = ("few_words", "repeated_windows")
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE,
    "symbols-1": (*BASE, "symbols"),
    "default-1": tuple(RULES),
}


def mask(rules) -> int:
    """The bits of the named rules."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def repeated_window_words(w: Column, size: int = WINDOW) -> Column:
    """How many words of the array ``w`` stand in a ``size``-word window that occurs twice or more.

    Windows are compared by a 64-bit hash of their words; the positions of equal hashes
    are found by sorting, only in texts that repeat a window at all.
    """
    n = F.size(w)

    def windows(x):
        at = F.sequence(F.lit(1), F.size(x) - (size - 1))
        return F.transform(at, lambda i: F.xxhash64(*[F.element_at(x, i + k) for k in range(size)]))

    def covered(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def starts(p):
            seen = F.filter(F.sequence(F.lit(1), F.size(p)), lambda j:
                            ((j > 1) & (F.get(p, j - 2)["x"] == F.get(p, j - 1)["x"]))
                            | (F.get(p, j - 1)["x"] == F.get(p, j)["x"]))
            return F.sort_array(F.transform(seen, lambda j: F.get(p, j - 1)["i"]))

        def total(s):
            return F.aggregate(s, F.struct(F.lit(0).alias("sum"), F.lit(-size).alias("last")), lambda a, i: F.struct(
                (a["sum"] + F.least(F.lit(size), i - a["last"])).alias("sum"), i.alias("last")), lambda a: a["sum"])

        return let(pairs, lambda p: let(starts(p), total))

    def body(x):
        return let(windows(x), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))

    return F.when(n < size + 1, 0).otherwise(let(w, body)).cast("long")


def _only(text: Column, kept: str) -> Column:
    """The number of characters of a class."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the measurements of every whole text; one row per row, in one narrow stage.

    Null texts count as empty: no words, one empty line. Repeated rows and null ids are kept;
    extra columns, whatever their names, are left out.
    """
    text = whole_text(df[text_col])
    # one row per document in between, so that the words are made once
    one = df.select(df[id_col].alias("id"), text.alias("t"), F.explode(F.array(words(text))).alias("w"))
    lines = F.split("t", "\n")
    spoken = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return one.select(
        F.col("id").alias(id_col), F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _only(F.col("t"), "#*$%&|<>").alias("n_symbols"),
        let(spoken, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("w")).alias("n_repeat_words"),
        _only(F.col("t"), "A-Z").alias("n_upper"), _only(F.col("t"), "!").alias("n_bangs"),
        F.size(lines).cast("long").alias("n_lines"))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measure`` with ``bits``: bit r is set if the r-th rule of ``RULES`` failed."""
    bits = F.lit(0).cast("long")
    for r, failed in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(1 << r).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(df, id_col, text_col).withColumn("bits", bits)


def apply_policy(bits: Column | str, version: str) -> Column:
    """True if no rule of the policy failed."""
    b = F.col(bits) if isinstance(bits, str) else bits
    return b.bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0


def ablation(rows: DataFrame, versions=tuple(POLICIES)) -> DataFrame:
    """Per policy and rule over a ledger: documents rejected by the policy, failing the rule, and
    rejected by that rule alone (kept if it were left out).

    One partial aggregation to at most 2 ** rules bit patterns, then bit operations on those.
    """
    patterns = rows.groupBy("bits").count()
    names = list(RULES)
    each = F.explode(F.array(*[
        F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit"),
                 F.lit(mask(POLICIES[v])).cast("long").alias("mask"))
        for v in versions for r in POLICIES[v]])).alias("p")
    hit = F.col("bits").bitwiseAND(F.col("p.mask"))
    count = lambda cond: F.sum(F.when(cond, F.col("count")).otherwise(0)).cast("long")
    return (patterns.select("bits", "count", each)
            .groupBy("p.policy", "p.rule")
            .agg(count(hit != 0).alias("n_rejected"), count(hit.bitwiseAND(F.col("p.bit")) != 0).alias("n_failed"),
                 count(hit == F.col("p.bit")).alias("n_only")))


def keep_documents(df: DataFrame, version: str = "default-1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the policy keeps, with their columns as they came; no shuffle."""
    raw = "__quality_row"
    packed = df.select(F.struct(*[df[c] for c in df.columns]).alias(raw), df[text_col].alias("__quality_text"))
    rows = ledger(packed, raw, "__quality_text")
    return rows.where(apply_policy("bits", version)).select(f"{raw}.*")


