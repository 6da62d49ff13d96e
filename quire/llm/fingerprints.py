"""Document fingerprints: I-Match over randomised lexicon subsets (DataFrame functions only).

The lexicon holds the terms whose inverse document frequency lies in a band. Each of
``SUBSETS`` random subsets of it, from the whole lexicon down to one term in 512, gives one
signature: the hash of the document's distinct terms in the subset, sorted. A document's
fingerprint is all its signatures. Texts that differ in a few terms still agree in the
subsets none of those terms fell into. A text without lexicon terms is told by the hash of all
its terms instead. The likeness of two fingerprints is the share of
agreeing signatures among those either document has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut, let, whole_text, words

# The halvings of each random subset.
HALVINGS = (0, 2, 4, 5, 5, 5, 6, 6, 6, 6, 7, 7, 7, 7, 8, 8, 8, 8, 9, 9)
SUBSETS = len(HALVINGS)
IDF_LOW = math.log(1 / 0.5)  # terms in over half the documents tell nothing
IDF_HIGH = math.log(1 / 0.0005)  # terms in under one document in 2000 come and go with typing errors
BROADCAST_TERMS = 300_000  # a lexicon of counted size up to this, and of up to
BROADCAST_CHARS = 16 << 20  # so many characters, is broadcast; a larger one is joined by a shuffle, with the same result
EMPTY = "-" * 8


def subset_mask(term: Column) -> Column:
    """One bit per subset the term belongs to, from its MD5."""
    out = F.lit(0)
    for k, halvings in enumerate(HALVINGS):
        code = F.conv(F.substring(F.md5(F.concat(F.lit(f"{k}:"), term)), 1, 4), 16, 10).cast("int")
        out = out + F.when(code % (1 << halvings) == 0, 1 << k).otherwise(0)
    return out.cast("int")


def term_code(term: Column) -> Column:
    """A 60-bit number of the term, in whose order terms are sorted."""
    return F.conv(F.substring(F.md5(term), 1, 15), 16, 10).cast("long")


def build_lexicon(df: DataFrame, text_col: str = "text", low: float = IDF_LOW, high: float = IDF_HIGH) -> DataFrame:
    """(term, code, mask) of the terms whose idf = ln(rows / df) lies in [low, high]; ``df`` counts the rows that
    hold the term, summed before the shuffle. Terms of a single row are in no band. No other term is left out."""
    n_docs = df.count()
    terms = (df.select(F.explode(F.array_distinct(words(whole_text(df[text_col])))).alias("term"))
             .groupBy("term").agg(F.count("*").alias("df"))
             .where((F.col("df") >= max(2, n_docs * math.exp(-high) - 1e-9)) & (F.col("df") <= n_docs * math.exp(-low) + 1e-9)))
    return cut(terms.select("term", term_code(F.col("term")).alias("code"), subset_mask(F.col("term")).alias("mask")))


def may_broadcast(lex: DataFrame, max_terms: int = BROADCAST_TERMS, max_chars: int = BROADCAST_CHARS) -> bool:
    """Whether the lexicon, counted, is small enough to be sent to every executor."""
    n, chars = lex.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    return n <= max_terms and chars <= max_chars


def own_signature(terms: Column) -> Column:
    """8 hex digits of an array of distinct terms, all of them, sorted; dashes if there is none."""
    return F.when(F.size(terms) == 0, EMPTY).otherwise(F.substring(F.sha2(F.array_join(F.sort_array(terms), " "), 256), 1, 8))


def signatures(pairs: Column, own: Column) -> Column:
    """The fingerprint of a sorted array of (code, mask): 8 hex digits per subset, dashes where the
    document has no term of the subset. Without any pair the first is ``own``, the rest dashes."""
    lone = F.concat_ws(".", own, *[F.lit(EMPTY)] * (SUBSETS - 1))
    return F.when(F.size(pairs) == 0, lone).otherwise(F.concat_ws(".", *[_signature(pairs, k) for k in range(SUBSETS)]))


def _signature(pairs: Column, k: int) -> Column:
    own = pairs if HALVINGS[k] == 0 else F.filter(pairs, lambda p: p["mask"].bitwiseAND(F.lit(1 << k)) != 0)
    joined = F.array_join(F.transform(own, lambda p: p["code"].cast("string")), " ")
    return let(joined, lambda x: F.when(x == "", EMPTY).otherwise(F.substring(F.sha2(x, 256), 1, 8)))


def likeness(a: Column, b: Column) -> Column:
    """The share of agreeing signatures among those that at least one side has; two fingerprints
    without any signature are alike (1)."""
    both = F.zip_with(F.split(a, r"\."), F.split(b, r"\."), lambda x, y: F.when((x != EMPTY) | (y != EMPTY), (x == y).cast("int")))
    return let(F.array_compact(both), lambda s: F.when(F.size(s) == 0, F.lit(1.0)).otherwise(
        F.aggregate(s, F.lit(0), lambda n, x: n + x) / F.size(s)))


def fingerprint_texts(texts: DataFrame, lex: DataFrame, row: list[str], text_cols: dict[str, str], info: Column,
                      small: bool | None = None) -> DataFrame:
    """(row..., info, one fingerprint per text): ``text_cols`` names output -> column, ``info`` is a
    string to carry; ``row`` names a row of ``texts``.

    Terms outside the band end at the join. A small lexicon (``may_broadcast``; ``small`` forces either way)
    is broadcast, and nothing is shuffled if ``texts`` is already dealt by (part of) ``row``. A larger one is
    joined by term: a frequent term's rows are split by AQE, and the rows' heads pass around the join.
    """
    small = may_broadcast(lex) if small is None else small

    # each list starts with an entry that no word equals: its text's own signature, and for the first text the info
    def entries(i, c):
        head = lambda w: F.concat(F.lit(" "), own_signature(w), info) if i == 0 else F.concat(F.lit(" "), own_signature(w))
        return let(F.array_distinct(words(F.col(c))), lambda w: F.concat(F.array(head(w)), w))

    sides = F.array(*[entries(i, c) for i, c in enumerate(text_cols.values())])
    flat = (texts.select(*row, F.posexplode(sides).alias("side", "entries"))
            .select(*row, "side", F.explode("entries").alias("entry")))
    is_head = F.col("entry").startswith(" ")
    if small:
        known = lex.union(lex.sparkSession.createDataFrame([("", None, None)], "term string, code long, mask int"))
        found = (flat.select(*row, "side", F.when(is_head, "").otherwise(F.col("entry")).alias("term"), F.when(is_head, F.col("entry")).alias("head"))
                 .join(F.broadcast(known), "term").select(*row, "side", "code", "mask", "head"))
    else:
        found = (flat.where(~is_head).withColumnRenamed("entry", "term").join(lex.hint("merge"), "term")
                 .select(*row, "side", "code", "mask", F.lit(None).cast("string").alias("head"))
                 .union(flat.where(is_head).select(*row, "side", F.lit(None).cast("long"), F.lit(None).cast("int"), "entry")))
    pair = F.when(F.col("code").isNotNull(), F.struct("code", "mask"))
    lists = [F.sort_array(F.collect_list(F.when(F.col("side") == i, pair))).alias(f"p{i}") for i in range(len(text_cols))]
    heads = [F.max(F.when(F.col("side") == i, F.col("head"))).alias(f"h{i}") for i in range(len(text_cols))]
    return (found.groupBy(*row).agg(*heads, *lists)
            .select(*row, F.substring("h0", 10, 1 << 20).alias("info"),
                    *[signatures(F.col(f"p{i}"), F.substring(f"h{i}", 2, 8)).alias(n) for i, n in enumerate(text_cols)]))


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lex: DataFrame | None = None) -> DataFrame:
    """(id, fingerprint) of every row, against the table's own lexicon or a given one.

    Equal texts have equal fingerprints; null counts as empty; a text without lexicon terms has the
    hash of all its terms alone, one without words only dashes. Rows with the same id and text are each returned; null ids are kept;
    extra columns are left out. Empty table: no rows.
    """
    lex = build_lexicon(df, text_col) if lex is None else lex
    rows = (df.select(df[id_col].alias("id"), whole_text(df[text_col]).alias("t")).withColumn("h", F.xxhash64("t"))
            .groupBy("id", "h").agg(F.first("t").alias("t"), F.count("*").alias("n")))
    done = fingerprint_texts(rows, lex, ["id", "h"], {"fingerprint": "t"}, F.col("n").cast("string"))
    return (done.select("id", "fingerprint", F.explode(F.array_repeat(F.lit(0), F.col("info").cast("int"))))
            .select(F.col("id").alias(id_col), "fingerprint"))


def deal_by_order(df: DataFrame, id_col: str, per_partition: int = 8) -> DataFrame:
    """``df`` with ``bucket`` and ``late``: ranges of the id, cut at its quantiles, each also holding the
    rows with the smallest id of the following range (``late`` = 1; the first follows the last).

    So every row's successor in ascending order (nulls first) is in its bucket. The driver gets
    two numbers per bucket.
    """
    spark = df.sparkSession
    n = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(id_col, [k / n for k in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    step = max(1, int(math.sqrt(len(cuts))))
    coarse = cuts[step - 1::step]
    value = F.col(id_col)

    def bucket_of(v):
        if not cuts:
            return F.lit(0)
        lots = F.size(F.filter(F.lit(coarse), lambda c: c <= v)) * step if coarse else F.lit(0)
        return F.coalesce(let(lots, lambda at: at + F.size(F.filter(F.slice(F.lit(cuts), at + 1, step), lambda c: c <= v))), F.lit(0))

    own = df.withColumn("bucket", F.when(value.isNull(), 0).otherwise(bucket_of(value)).cast("int"))
    firsts = sorted((r["bucket"], r["least"] if not r["nulls"] else None) for r in
                    own.groupBy("bucket").agg(F.min(id_col).alias("least"), F.max(value.isNull()).alias("nulls")).collect())
    before = {b: firsts[k - 1][0] for k, (b, _) in enumerate(firsts)}
    size = max(before, default=0) + 1
    least, prior = [None] * size, [0] * size
    for b, x in firsts:
        least[b], prior[b] = x, before[b]
    pick = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("bucket"))
    copies = F.when(value.eqNullSafe(pick(least, df.schema[id_col].dataType)),
                    F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("late")),
                            F.struct(pick(prior, "int").alias("bucket"), F.lit(1).alias("late")))
                    ).otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("late"))))
    return own.select(*df.columns, F.explode(copies).alias("d")).select(*df.columns, "d.bucket", "d.late")


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter replaced by as much of the start of the next document
    (ascending id, ties by a hash of the text, nulls first; after the last comes the first).
    Texts are shuffled once, to the bucket of their id; all that follows stays there.
    Null texts count as empty; repeated rows are each returned; extra columns are left out;
    an empty table gives no rows.
    """
    lex = build_lexicon(df, text_col)
    rows = df.select(df[id_col].alias("id"), whole_text(df[text_col]).alias("t"))
    dealt = deal_by_order(rows, "id")
    order = Window.partitionBy("bucket").orderBy("late", "id", F.xxhash64("t"))
    n = F.length("t")
    quarter = F.floor(n / 4).cast("int")
    texts = (dealt.withColumn("rn", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("t").over(order), F.lit("")))
             .select("bucket", "rn", "late", "id", "t", n.alias("n"),
                     F.concat(F.substring("t", F.lit(1), n - quarter), F.substring("next", F.lit(1), quarter)).alias("edited")))
    info = F.concat_ws(",", "late", "n", F.sha2("edited", 256), F.coalesce(F.col("id").cast("string"), F.lit("")))
    done = fingerprint_texts(texts, lex, ["bucket", "rn"], {"fingerprint": "t", "edited_fingerprint": "edited"}, info)
    follow = Window.partitionBy("bucket").orderBy("rn")
    part = F.split("info", ",")
    return (done.withColumn("next_fp", F.lead("fingerprint").over(follow)).where(F.get(part, 0) == "0")
            .select(F.when(F.get(part, 3) != "", F.get(part, 3)).cast(df.schema[id_col].dataType).alias(id_col),
                    F.get(part, 1).cast("long").alias("n_chars"), F.get(part, 2).alias("edited_sha256"),
                    "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                    likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next")))
