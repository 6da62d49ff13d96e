"""Secret scans (DataFrame functions only): fixed patterns, and sliding-window entropy.

Positions come from cutting a text at a pattern: running sums of the lengths of the pieces between
matches and of the matches give every start. Candidate strings (long runs of a character
class) go through a window of ``WINDOW`` characters whose character counts, and the sum of
c * log2(c), change by the one character that enters and the one that leaves. A window counts if
its entropy reaches the class's threshold and its letters do not read like words (a share of
common letter pairs, counted in the same walk). Such windows merge into spans; spans inside
another's are left out.

Nothing is quadratic in a text: running values are folded in blocks (``scan``), characters are read
from one array, overlaps are found in one sorted sweep.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import let, whole_text

# Kind, pattern, group whose length counts, least length.
BASE_KINDS = (
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
               r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
WINDOW = 20
# Kind, alphabet, what a candidate is, what it must hold, bits per character of a window.
CLASSES = (
    ("entropy-hex", "0123456789abcdef", r"(?<![0-9A-Za-z])[0-9a-fA-F]{20,}(?![0-9A-Za-z])",
     r"^(?=.*[0-9])(?=.*[A-Fa-f])", 3.0),
    ("entropy-base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-",
     r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])", 3.8),
    # runs of one case (base32 among them) and runs without digits, also inside longer ones
    ("entropy-upper-digit", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", r"[A-Z0-9]{20,}", r"^(?=.*[0-9])(?=.*[A-Z])", 3.5),
    ("entropy-lower-digit", "abcdefghijklmnopqrstuvwxyz0123456789", r"[a-z0-9]{20,}", r"^(?=.*[0-9])(?=.*[a-z])", 3.5),
    ("entropy-upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[A-Z]{20,}", r"^", 3.5),
    ("entropy-lower", "abcdefghijklmnopqrstuvwxyz", r"[a-z]{20,}", r"^", 3.5),
    ("entropy-letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", r"[A-Za-z]{20,}", r"^(?=.*[A-Z])(?=.*[a-z])", 3.8),
)
# Candidates that are no secrets: example values, counting runs, UUIDs, one repeated character.
ALLOW = (
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]?(?:key|token|secret)",
    r"(?i)0123456789|abcdefghij|(.)\1{7,}",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
)
# What parts a candidate into stretches that are scanned apart; of the allow-list above, only a UUID
# clears a whole candidate, and a repeated character lowers the entropy by itself.
CUTS = ALLOW[0] + "|0123456789|abcdefghij"
CLEARED = ALLOW[2:]
# The letter pairs that words of European languages are mostly made of.
WORD_PAIRS = (
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra "
    "ce li ch ll be ma si om ur ca el ta la ns di fo ho pe ec pr no ct us ac ot il tr nc et ss un lo ge ie ei sc fr au ie ig gs "
    "hr ts af ft ap pi ff ah am da do sp nk rt em ut so rs ol mp ul na ai su sa pa po"
)
WORDY_PAIRS, WORDY_SHARE = 8, 45  # so many letter pairs in a window, so many per cent of them common: words
_SPAN = "array<struct<start:int,rank:int,stop:int,kind:string>>"


def _span(start, rank: int, stop, kind: str) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"),
                    stop.cast("int").alias("stop"), F.lit(kind).alias("kind"))


def scan(values: Column, zero: Column, kind: str, add, merge) -> Column:
    """The running value before each element: zero, add(zero, x0), ... Folded in blocks of about the square root of
    the length, whose totals are folded in turn (merge), so that a long array is not copied at every step."""
    def fold(items, plus):
        start = F.struct(zero.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(items, start, lambda a, x: F.struct(plus(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def blocks(v):
        width = F.greatest(F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int"), F.lit(1))
        return let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / w).cast("int")),
                                                lambda k: fold(F.slice(v, k * w + 1, w), add)))

    def join(parts):
        before = fold(F.transform(parts, lambda p: p["at"]), merge)["out"]
        return F.flatten(F.zip_with(parts, before, lambda p, base: F.transform(p["out"], lambda x: merge(base, x))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(blocks(v), join)).otherwise(F.array().cast(f"array<{kind}>")))


def _located(text: Column, pattern: str) -> Column:
    """Array of (start, match) of the non-overlapping matches, left to right."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))

    def place(m, g):
        steps = F.transform(m, lambda x, i: F.length(x) + F.get(g, i + 1))
        return F.zip_with(m, scan(steps, F.lit(0), "int", lambda a, x: a + x, lambda a, b: a + b),
                          lambda x, at: F.struct((F.get(g, 0) + at).alias("start"), x.alias("match")))

    return let(matches, lambda m: let(gaps, lambda g: place(m, g)))


def base_spans(text: Column) -> Column:
    """Sorted spans of the fixed patterns."""
    none = F.array().cast(_SPAN)
    parts = []

    def of(rank, kind, pattern, group, least):
        kept = F.filter(_located(text, pattern), lambda x: F.length(F.regexp_extract(x["match"], pattern, group)) >= least)
        spans = F.transform(kept, lambda x: _span(x["start"], rank, x["start"] + F.length(x["match"]), kind))
        return F.when(text.rlike(pattern), spans).otherwise(none)

    for rank, fixed in enumerate(BASE_KINDS):
        parts.append(of(rank, *fixed))
    return F.sort_array(F.concat(*parts))


CHUNK = 128  # windows of one fold
_PACKED = 10  # counts in one long, six bits each


def window_segments(candidate: Column, alphabet: Column, threshold: Column, window: int = WINDOW) -> Column:
    """Array of (start, stop) in ``candidate``: unions of windows whose entropy per character, over
    the characters of ``alphabet``, reaches ``threshold`` bits and which do not read like words; counts change
    incrementally. Windows are walked in chunks, each begun with the characters before it."""
    clog = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    longs = -(-max(len(c[1]) for c in CLASSES) // _PACKED)
    shift = lambda x: (x % _PACKED) * 6
    far = 1 << 30

    def walk(ids, pairs):
        def chunk(k):
            first = F.greatest(k * CHUNK - (window - 1), F.lit(0))
            last = F.least(k * CHUNK + CHUNK, F.size(ids)) - 1
            zero = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("letters"),
                            F.lit(0).alias("common"), F.array().cast("array<int>").alias("out"))

            def step(a, i):
                enter = F.get(ids, i) - 1
                leave = F.when(i - window >= first, F.get(ids, i - window) - 1).otherwise(F.lit(-1))
                count = lambda x: F.call_function("shiftright", F.get(a["counts"], F.floor(x / _PACKED).cast("int")), shift(x)).bitwiseAND(F.lit(63)).cast("int")
                one = lambda x, j: F.when(F.floor(x / _PACKED).cast("int") == j, F.call_function("shiftleft", F.lit(1).cast("long"), shift(x))).otherwise(F.lit(0).cast("long"))
                changed = F.when(enter == leave, F.lit(0.0)).otherwise(
                    let(count(enter), lambda c: F.get(clog, c + 1) - F.get(clog, c))
                    + F.when(leave >= 0, let(count(leave), lambda c: F.get(clog, c - 1) - F.get(clog, c))).otherwise(0.0))
                counts = F.transform(a["counts"], lambda c, j: c + one(enter, j) - F.when(leave >= 0, one(leave, j)).otherwise(F.lit(0).cast("long")))
                # the pair that ends at i comes in, the one whose first character leaves goes
                new = F.when(i > first, F.get(pairs, i - 1)).otherwise(F.lit(0))
                gone = F.when(i - window >= first, F.get(pairs, i - window)).otherwise(F.lit(0))
                flag = lambda x, least: (x >= least).cast("int")
                letters = a["letters"] + flag(new, 1) - flag(gone, 1)
                common = a["common"] + flag(new, 2) - flag(gone, 2)

                def settle(total):
                    wordy = (letters >= WORDY_PAIRS) & (common * 100 >= letters * WORDY_SHARE)
                    hot = (i - first >= window - 1) & (F.lit(math.log2(window)) - total / window >= threshold - 1e-9) & ~wordy
                    return F.struct(counts.alias("counts"), total.alias("sum"), letters.alias("letters"), common.alias("common"),
                                    F.when(hot, F.concat(a["out"], F.array(i))).otherwise(a["out"]).alias("out"))

                return let(a["sum"] + changed, settle)

            return F.aggregate(F.sequence(first, last), zero, step, lambda a: a["out"])

        hot = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(ids) - 1) / CHUNK).cast("int")), chunk))
        return let(hot, merged)

    def merged(hot):
        n = F.size(hot)
        before = F.concat(F.array(F.lit(-far)), F.slice(hot, F.lit(1), F.greatest(n - 1, F.lit(0))))
        after = F.concat(F.slice(hot, F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(F.lit(far)))
        begin = F.array_compact(F.zip_with(hot, before, lambda p, q: F.when(p - q > window, p + 1 - window)))
        end = F.array_compact(F.zip_with(hot, after, lambda p, q: F.when(q - p > window, p + 1)))
        return F.when(n > 0, F.zip_with(begin, end, lambda x, y: F.struct(x.alias("start"), y.alias("stop")))).otherwise(
            F.array().cast("array<struct<start:int,stop:int>>"))

    def pairs_of(chars):
        """For each neighbouring pair: 0 not two letters, 1 two letters, 2 a common pair."""
        letter = lambda c: F.lower(c) != F.upper(c)
        common = lambda a, b: F.call_function("instr", F.lit(f" {WORD_PAIRS} "), F.concat(F.lit(" "), F.lower(a), F.lower(b), F.lit(" "))) > 0
        return F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars) - 1),
                          lambda a, b: F.when(letter(a) & letter(b), F.when(common(a, b), 2).otherwise(1)).otherwise(0))

    return let(F.split(candidate, ""), lambda chars: let(
        F.transform(chars, lambda c: F.call_function("instr", alphabet, c)),
        lambda ids: let(pairs_of(chars), lambda pairs: walk(ids, pairs))))


def _between(candidate: Column, cuts: str) -> Column:
    """The stretches of a candidate between the matches of ``cuts``, as candidates."""
    text = candidate["match"]

    def part(found):
        starts = F.concat(F.array(F.lit(0)), F.transform(found, lambda c: c["start"] + F.length(c["match"])))
        stops = F.concat(F.transform(found, lambda c: c["start"]), F.array(F.length(text)))
        parts = F.zip_with(starts, stops, lambda a, b: F.struct(
            (candidate["start"] + a).alias("start"), F.substring(text, a + 1, b - a).alias("match"), candidate["class"].alias("class")))
        return F.filter(parts, lambda x: F.length(x["match"]) >= WINDOW)

    return F.when(text.rlike(cuts), let(_located(text, cuts), part)).otherwise(F.array(candidate))


def entropy_spans(text: Column, allow=CLEARED, cuts: str = CUTS) -> Column:
    """Spans of high-entropy windows in candidate strings, without allowed candidates; ``cuts`` are
    taken out of a candidate and what stands between them is scanned. The candidates of all classes
    go through one walk, which takes alphabet and threshold from the class."""
    none = F.array().cast("array<struct<start:int,match:string,class:int>>")

    def of_class(k, pattern, needs):
        def wanted(x):
            ok = x["match"].rlike(needs)
            for rule in allow:
                ok = ok & ~x["match"].rlike(rule)
            return ok

        own = F.transform(F.filter(_located(text, pattern), wanted),
                          lambda x: F.struct(x["start"].alias("start"), x["match"].alias("match"), F.lit(k).alias("class")))
        return F.when(text.rlike(pattern), own).otherwise(none)

    found = [of_class(k, c[2], c[3]) for k, c in enumerate(CLASSES)]
    kinds, alphabets = F.array(*[F.lit(c[0]) for c in CLASSES]), F.array(*[F.lit(c[1]) for c in CLASSES])
    bits, one_case = F.array(*[F.lit(c[4]) for c in CLASSES]), F.array(*[F.lit(c[1].islower()) for c in CLASSES])

    def hot(x):
        of = lambda values: F.get(values, x["class"])
        folded = F.when(of(one_case), F.lower(x["match"])).otherwise(x["match"])
        return F.transform(window_segments(folded, of(alphabets), of(bits)), lambda s: F.struct(
            (x["start"] + s["start"]).cast("int").alias("start"), (x["class"] + len(BASE_KINDS)).cast("int").alias("rank"),
            (x["start"] + s["stop"]).cast("int").alias("stop"), of(kinds).alias("kind")))

    def spans(all_found):
        return F.flatten(F.transform(F.flatten(F.transform(all_found, lambda x: _between(x, cuts))), hot))

    return let(F.concat(*found), lambda c: F.when(F.size(c) > 0, spans(c)).otherwise(F.array().cast(_SPAN)))


def _uncovered(base: Column, more: Column) -> Column:
    """The spans of ``more`` that do not lie wholly inside a span of a lower rank: one sweep over all spans in
    order, with the farthest stop so far of every rank (spans of one rank do not overlap)."""
    ranks = len(BASE_KINDS) + len(CLASSES)

    def sweep(spans):
        far = scan(spans, F.array_repeat(F.lit(-1), ranks), "array<int>",
                   lambda a, x: F.transform(a, lambda v, j: F.when(j == x["rank"], F.greatest(v, x["stop"])).otherwise(v)),
                   lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
        kept = F.zip_with(spans, far, lambda x, seen: F.when(
            (x["rank"] >= len(BASE_KINDS)) & ~F.exists(F.slice(seen, F.lit(1), F.greatest(x["rank"], F.lit(1))), lambda stop: stop >= x["stop"]), x))
        return F.array_compact(kept)

    return F.when(F.size(more) > 0, let(F.sort_array(F.concat(base, more)), sweep)).otherwise(F.array().cast(_SPAN))


def find_all(df: DataFrame, carried: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(carried, text, base, spans): spans sorted by start, then kind; ``base`` those of the
    fixed patterns alone. Starts and stops count code points.

    No part of a secret goes because another span touches it or an allowed word stands beside it: of
    the entropy spans only those go that lie wholly inside a span of a fixed pattern or of an earlier
    class, and allowed words only part a candidate. One narrow stage, no shuffle. Null and empty texts
    have no spans; every row is returned once; extra columns, whatever their names, are left out.
    """
    # one row per row in between, so that a text and its spans are made once
    one = df.select(df[carried].alias("c"), F.explode(F.array(whole_text(df[text_col]))).alias("t"))
    one = one.select("c", "t", F.explode(F.array(F.struct(
        base_spans(F.col("t")).alias("base"), entropy_spans(F.col("t")).alias("more")))).alias("s"))
    return one.select(F.col("c").alias(carried), F.col("t").alias(text_col), F.col("s.base").alias("base"),
                      F.sort_array(F.concat(F.col("s.base"), _uncovered(F.col("s.base"), F.col("s.more")))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


FEW_SPANS = 32  # up to so many, pieces are cut from the text itself; beyond, from an array of its characters


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (sorted by start; overlapping ones together) replaced by ``mark``."""
    def build(cut, length):
        def pieces(reach):
            parts = F.array_compact(F.zip_with(spans, reach, lambda s, at: F.when(
                s["start"] >= at, F.concat(cut(at, s["start"] - at), F.lit(mark)))))
            end = F.greatest(F.element_at(reach, -1), F.element_at(spans, -1)["stop"])
            return F.concat(F.array_join(parts, ""), cut(end, length - end))

        return let(scan(spans, F.lit(0), "int", lambda a, s: F.greatest(a, s["stop"]), lambda a, b: F.greatest(a, b)), pieces)

    few = build(lambda at, n: F.substring(text, at + 1, n), F.length(text))
    many = let(F.split(text, ""), lambda c: build(lambda at, n: F.array_join(F.slice(c, at + 1, F.greatest(n, F.lit(0))), ""), F.size(c)))
    return F.when(F.size(spans) == 0, text).when(F.size(spans) <= FEW_SPANS, few).otherwise(many)


def scrub(df: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``df`` with secrets in its texts replaced; its columns as they came, the length column (if
    it has one) brought up to date in changed rows. Null texts stay null."""
    row = "__secrets_row"  # the only columns from here on are ours
    found = find_all(df.select(F.struct(*[df[c] for c in df.columns]).alias(row), df[text_col].alias("__t")), row, "__t")
    hit = F.size("spans") > 0
    one = found.select(row, hit.alias("hit"), F.explode(F.array(redact(F.col("__t"), F.col("spans")))).alias("clean"))
    out = []
    for c in df.columns:
        own = F.col(f"{row}.`{c}`")
        if c == text_col:
            own = F.when(F.col("hit"), F.col("clean")).otherwise(own)
        elif c == length_col:
            own = F.when(F.col("hit"), F.length("clean").cast(df.schema[c].dataType)).otherwise(own)
        out.append(own.alias(c))
    return one.select(*out)
