"""Language identification by Bayesian evidence fusion.

For each language l the evidence of a document adds up in logarithms:

* text: mean log-probability of its hashed byte trigrams under l, times a weight that
  saturates (neighbouring trigrams are not independent),
* the declared markup language d: P(d | l),
* the address suffix s (last label of the host name): P(s | l),
* the host: a prior over l, shrunk towards its domain, and that towards the whole corpus.

All three tables are grouped sums, over all documents, of the posteriors that the texts
alone give; a document's own share is taken out of its host's counts. "und" is one more
hypothesis, under which every trigram is about as likely as any other: text in no language
of the corpus goes there. A trigram that a language's sample lacks is less likely than that
by the same factor under every language, however small its sample. The trigram model is fitted on a bounded sample of the
documents that declare a language.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.split import unused
from quire.llm.common import cut, let, row_key, whole_text, without

BUCKETS = 1 << 15
SAMPLE_DOCS = 2000  # labelled documents per language, about; the bound of the training sample
SATURATION = 50.0
UND = "und"
FLOOR_SHARE = 0.02  # of every language's trigram model, the share spread evenly over the buckets, whatever its sample
FLOOR = math.log(FLOOR_SHARE / BUCKETS)  # log-probability, under any language, of a trigram not in its sample
UND_TRIGRAM = -math.log(BUCKETS) - 1.0  # a trigram's log-probability under "und"


def trigrams(text: str | None):
    """Yield arrays of bucket numbers of the byte trigrams of a whole text: ASCII letters in lower
    case, any other ASCII as a space, a space at both ends, runs of three spaces left out."""
    import numpy as np

    raw = b" " + (text or "").encode("utf-8", "replace") + b" "
    for at in range(0, max(0, len(raw) - 2), 1 << 20):
        b = np.frombuffer(raw[at:at + (1 << 20) + 2].translate(_fold()), dtype=np.uint8).astype(np.uint32)
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        code = code[code != 0x202020]
        yield ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def _fold() -> bytes:
    letters = lambda b: b >= 128 or chr(b).isalpha()
    return bytes(ord(chr(b).lower()) if b < 128 and letters(b) else b if letters(b) else 32 for b in range(256))


# Tags that declare no one language (undetermined, several, no language, uncoded) and words put in their place.
NO_LANGUAGE = ("und", "mul", "zxx", "mis", "unknown", "null", "none", "other")


def declared_language(value: Column) -> Column:
    """The primary subtag in lower case; null if there is none or it names no language."""
    tag = F.regexp_extract(F.lower(F.coalesce(value.cast("string"), F.lit(""))), r"^\s*([a-z]{2,8})(?![a-z])", 1)
    return F.when((tag != "") & ~tag.isin(*NO_LANGUAGE), tag)


def markup_language(html: Column) -> Column:
    """The lang attribute of the html element; null if there is none."""
    tag = F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z][A-Za-z0-9-]*)""", 1)
    return F.when(tag != "", tag)


def host_of(address: Column) -> Column:
    """The host name of a URL, or the part of a bare address before a slash; null if empty."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(address.cast("string"), F.lit("")))), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(host != "", host)


def train(df: DataFrame, text_col: str, declared: Column, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], tuple]:
    """(languages, model) from about ``sample_docs`` documents of each declared language. Counts are
    summed by Spark; the driver gets one number per language and bucket that its sample holds.

    The model is sparse: (first entry of each bucket, languages, log-probabilities over ``FLOOR``).
    """
    import numpy as np

    rows = df.select(declared.alias("label"), whole_text(df[text_col]).alias("text")).where("label is not null")
    named = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # one row per language
    languages = sorted(named)
    if not languages:
        return [], (np.zeros(BUCKETS + 1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))
    share = df.sparkSession.createDataFrame(
        [(k, x, min(1.0, sample_docs / named[x])) for k, x in enumerate(languages)], "place int, label string, share double")
    rows = rows.join(F.broadcast(share), "label")
    pick = F.pmod(F.xxhash64("text", "label"), F.lit(1 << 20)) < F.col("share") * (1 << 20)

    def counts(batches):
        import pyarrow as pa

        def part(place, total):
            at = np.nonzero(total)[0].astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), place, np.int32)), pa.array(at), pa.array(total[at])],
                                              names=["place", "bucket", "n"])

        sums = {}
        for b in batches:
            for place, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if place not in sums and len(sums) == 64:  # no more tables at a time; Spark adds the parts up
                    yield from (part(*x) for x in sums.items())
                    sums.clear()
                total = sums.setdefault(place, np.zeros(BUCKETS, dtype=np.int64))
                for codes in trigrams(text):
                    total += np.bincount(codes, minlength=BUCKETS)
        yield from (part(*x) for x in sums.items())

    found = (rows.where(pick).select("place", "text").mapInArrow(counts, "place int, bucket int, n long")
             .groupBy("place", "bucket").agg(F.sum("n").alias("n")).toArrow())
    place, bucket, n = (found.column(c).to_numpy() for c in ("place", "bucket", "n"))
    total = np.bincount(place, weights=n, minlength=len(languages))
    above = np.log((1 - FLOOR_SHARE) * n / total[place] + FLOOR_SHARE / BUCKETS) - FLOOR
    order = np.lexsort((place, bucket))
    first = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=BUCKETS))])
    return languages, (first, place[order].astype(np.int32), above[order].astype(np.float32))


def text_scores(model: tuple, size: int, text: str | None) -> list[float]:
    """The mean log-probability of a text's trigrams under each of ``size`` languages, and their number."""
    import numpy as np

    first, place, above = model
    seen = np.zeros(BUCKETS, dtype=np.int64)
    for codes in trigrams(text):
        seen += np.bincount(codes, minlength=BUCKETS)
    n = int(seen.sum())
    at = np.nonzero(seen)[0]
    wide = first[at + 1] - first[at]
    entry = np.arange(wide.sum()) + np.repeat(first[at] - (np.cumsum(wide) - wide), wide)
    total = np.bincount(place[entry], weights=above[entry] * np.repeat(seen[at], wide), minlength=size)
    return [*(FLOOR + total / max(n, 1)).tolist(), float(n)]


def _soft(scores: Column) -> Column:
    """Softmax of an array of logarithms."""
    return let(scores, lambda s: let(F.array_max(s), lambda m: let(
        F.transform(s, lambda x: F.exp(x - m)),
        lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda t: F.transform(e, lambda x: x / t)))))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang",
             address_col: str | None = "source", carry: list[str] | None = None, shrink: float = 20.0,
             sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per row: id, carried columns, ``language`` ("und" if none fits), ``posterior``, ``declared``,
    ``host``, ``n_trigrams`` and ``kept`` (a language of the corpus was found).

    Null or letterless texts are "und" and not kept. A missing declared language or
    address is no evidence. If no row declares a language, nothing can be learned and all
    rows are "und". Repeated rows are returned each; extra columns are left out. Empty
    table: no rows.
    """
    carry = carry or []
    spark = df.sparkSession
    declared = declared_language(df[declared_col]) if declared_col else F.lit(None).cast("string")
    host = host_of(df[address_col]) if address_col else F.lit(None).cast("string")
    languages, model = train(df, text_col, declared, sample_docs)
    names = [*languages, UND]
    size = len(names)
    shared = spark.sparkContext.broadcast(model)  # as large as the training samples' trigrams

    @F.pandas_udf("array<double>")
    def score(texts):
        import pandas as pd
        return pd.Series([text_scores(shared.value, len(languages), x) for x in texts])

    given = df.select(df[id_col].alias("id"), *[df[c].alias(f"k{i}") for i, c in enumerate(carry)], declared.alias("declared"),
                      host.alias("host"), score(whole_text(df[text_col])).alias("s"))
    n = F.element_at("s", -1)
    weight = n / (1 + n / SATURATION)
    likelihood = F.transform(F.concat(F.slice("s", 1, len(languages)), F.array(F.lit(UND_TRIGRAM))), lambda x: x * weight)
    base = F.array(*[F.lit(-math.log(size))] * size)
    scored = cut(given.select("id", *[f"k{i}" for i in range(len(carry))], "declared", "host", n.alias("n"), likelihood.alias("ll"))
                 .withColumn("p", _soft(F.zip_with("ll", base, lambda a, b: a + b)))
                 .withColumn("suffix", F.when(F.col("host").rlike(r"\.[a-z]{2,}$"), F.regexp_extract("host", r"([a-z]+)$", 1)))
                 .withColumn("domain", F.when(F.col("host").isNotNull(), F.regexp_extract("host", r"([^.]+(?:\.[^.]+)?)$", 1))))

    def sums(*keys):
        got = scored.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(
            F.array(*[F.sum(F.get("p", k)) for k in range(size)]).alias("m"))
        return got

    total = scored.agg(*[F.coalesce(F.sum(F.get("p", k)), F.lit(0.0)) for k in range(size)]).first()  # one row
    all_docs = sum(total)
    world = [(x + 1.0) / (all_docs + size) for x in total]

    def given_language(keyed: DataFrame, key: str, out: str) -> DataFrame:
        """log P(key | l), smoothed with one document for each key and language."""
        kinds = keyed.count()
        log = [F.log((F.get("m", k) + 1.0) / (total[k] + kinds + 1.0)) for k in range(size)]
        return keyed.select(key, F.array(*log).alias(out))

    by_declared = given_language(sums("declared"), "declared", "log_declared")
    by_suffix = given_language(sums("suffix"), "suffix", "log_suffix")
    by_domain = sums("domain").select("domain", F.col("m").alias("domain_m"))
    by_host = sums("domain", "host").select("host", F.col("m").alias("host_m"))

    zero = F.array(*[F.lit(0.0)] * size)
    # the keyed sides hold one row per key; the scored side's hot keys are split by AQE
    joined = (scored.join(by_declared, "declared", "left").join(by_suffix, "suffix", "left")
              .join(by_domain, "domain", "left").join(by_host, "host", "left"))

    def shrunk(m: Column, own: Column, parent: Column) -> Column:
        rest = let(F.zip_with(F.coalesce(m, own), own, lambda a, b: F.greatest(a - b, F.lit(0.0))), lambda r: let(
            F.aggregate(r, F.lit(0.0), lambda a, x: a + x),
            lambda t: F.zip_with(r, parent, lambda a, b: (a + shrink * b) / (t + shrink))))
        return rest

    prior = let(shrunk(F.col("domain_m"), F.col("p"), F.array(*[F.lit(x) for x in world])),
                lambda d: shrunk(F.col("host_m"), F.col("p"), d))
    parts = [F.col("ll"), F.coalesce("log_declared", zero), F.coalesce("log_suffix", zero), F.transform(prior, lambda x: F.log(x))]
    fused = parts[0]
    for x in parts[1:]:
        fused = F.zip_with(fused, x, lambda a, b: a + b)
    post = joined.withColumn("post", _soft(fused)).withColumn("best", F.array_position("post", F.array_max("post")).cast("int"))
    found = (F.col("n") > 0) & (F.col("best") < size)
    return post.select(
        F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(carry)],
        F.when(found, F.get(F.array(*[F.lit(x) for x in names]), F.col("best") - 1)).otherwise(UND).alias("language"),
        F.array_max("post").alias("posterior"), "declared", "host", F.col("n").cast("long").alias("n_trigrams"), found.alias("kept"))


def keep_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose language was found, with their columns as they came. The keys of the
    rows that go are written and decide; texts move only if those are many."""
    key = unused(docs, "__key")
    keyed = docs.withColumn(key, row_key(docs))
    kept = F.coalesce("kept", F.lit(False))
    gone = identify(keyed, carry=[key], **options).where(~kept).select(F.col("doc_id").alias("gone_id"), F.col(key).alias("gone_key"))
    return without(keyed, ["doc_id", key], gone).select(*docs.columns)
