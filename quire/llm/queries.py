"""The registered queries of the training-data operators: opN_<name> over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.fingerprints import HALVINGS

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


@query("op7_simhash_near_dedup")
def op7(spark, d):
    from quire.llm import simhash
    return (simhash.near_duplicates(table(spark, d, "documents"), "doc_id", "text", ngram=3, radius=3)
            .select("doc_id", "fingerprint", "component_id"))


@query("op4_quality_rules", r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(5) t(k) GROUP BY 1),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS spoken,
             CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
             CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_bangs,
             CAST(len(string_split(t, chr(10))) AS BIGINT) AS n_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
d AS (SELECT *, CAST(len(spoken) - len(list_distinct(spoken)) AS BIGINT) AS n_dup_lines FROM m),
b AS (SELECT *, CAST(CAST(n_words < 10 AS INT) + 2 * CAST(100 * n_repeat_words > 20 * n_words AS INT)
             + 4 * CAST(10 * n_symbols > n_words AS INT)
             + 8 * CAST(word_chars < 2 * n_words OR word_chars > 20 * n_words AS INT)
             + 16 * CAST(2 * n_dup_lines > n_lines AS INT) + 32 * CAST(2 * n_upper > word_chars AS INT)
             + 64 * CAST(4 * n_bangs > n_words AS INT) AS BIGINT) AS bits FROM d)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept, bits
FROM b
""")
def op4(spark, d):
    from quire.llm import quality as Q
    rows = Q.ledger(table(spark, d, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~Q.apply_policy("bits", "base-1")).alias("base_failed"),
                       Q.apply_policy("bits", "default-1").alias("kept"), "bits")


@query("op8_secret_scan")
def op8(spark, d):
    from quire.llm import secrets as X
    found = X.find_all(table(spark, d, "documents"))
    return found.select("doc_id", *[X.count_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(X.listed(F.col("base")), 256).alias("base_sha256"), X.listed(F.col("spans")).alias("spans"))


@query("op2_token_counts")
def op2(spark, d):
    from quire.llm import bpe, token_counts as C
    from quire.llm.common import cut
    # the histogram is read for its totals and for its suffix sums, so it is written once
    return C.context_report(cut(C.length_histogram(bpe.count_tokens(table(spark, d, "documents")))))


@query("op6_packing")
def op6(spark, d):
    from quire.llm import bpe, packing
    from quire.llm.common import cut
    # the counts are read twice (histogram, places), so they are written once
    return packing.pack(cut(bpe.count_tokens(table(spark, d, "documents"))))


@query("op10_bpe_round_trip")
def op10(spark, d):
    from quire.llm import bpe
    ids = bpe.encode(table(spark, d, "documents"), carry=["doc_id"])
    done = bpe.decode(ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                                 F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids"),
                      carry=["doc_id", "n_tokens", "ids_sha256"])
    return done.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


@query("op5_language_id")
def op5(spark, d):
    from quire.llm import language
    return language.identify(table(spark, d, "documents")).select(
        "doc_id", "language", "posterior", "declared", "host", "n_trigrams", "kept")


@query("op9_license_scan")
def op9(spark, d):
    from quire.llm import licenses
    return licenses.scan(table(spark, d, "documents"))


_IN_SUBSET = ", ".join(f"CAST('0x' || substr(md5('{k}:' || term), 1, 4) AS INT) % {1 << h} = 0" for k, h in enumerate(HALVINGS))
_LIKE = """CASE WHEN len(list_filter({z}, lambda p: p[1] <> '--------' OR p[2] <> '--------')) = 0 THEN 1.0
  ELSE len(list_filter({z}, lambda p: p[1] = p[2] AND p[1] <> '--------'))::DOUBLE
  / len(list_filter({z}, lambda p: p[1] <> '--------' OR p[2] <> '--------')) END"""


def _like(a: str, b: str) -> str:
    return _LIKE.format(z=f"list_transform(range(1, {len(HALVINGS) + 1}), lambda i: [string_split({a}, '.')[i], string_split({b}, '.')[i]])")


@query("op1_imatch_fingerprints", rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt,
             coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM d),
e AS (SELECT *, substr(t, 1, n - n // 4) || substr(nt, 1, n // 4) AS ed FROM n),
w AS (SELECT doc_id, list_filter(list_distinct(regexp_split_to_array(t, '[\x20\x09-\x0D]+')), lambda x: x <> '') AS tw,
             list_filter(list_distinct(regexp_split_to_array(ed, '[\x20\x09-\x0D]+')), lambda x: x <> '') AS ew FROM e),
tw AS (SELECT doc_id, unnest(tw) AS term FROM w), ew AS (SELECT doc_id, unnest(ew) AS term FROM w),
o AS (SELECT doc_id, side, CASE WHEN len(x) = 0 THEN '--------' ELSE substr(sha256(array_to_string(list_sort(x), ' ')), 1, 8) END AS own
      FROM (SELECT doc_id, 0 AS side, tw AS x FROM w UNION ALL SELECT doc_id, 1, ew FROM w)),
c AS (SELECT count(*) AS docs FROM d),
df AS (SELECT term, count(*) AS df FROM tw GROUP BY 1),
lex AS (SELECT term, CAST('0x' || substr(md5(term), 1, 15) AS BIGINT) AS code, [{_IN_SUBSET}] AS inside
        FROM df, c WHERE df >= greatest(2, docs * 0.0005 - 1e-9) AND df <= docs * 0.5 + 1e-9),
hit AS (SELECT doc_id, 0 AS side, code, inside FROM tw JOIN lex USING (term)
        UNION ALL SELECT doc_id, 1, code, inside FROM ew JOIN lex USING (term)),
sig AS (SELECT doc_id, side, k, substr(sha256(string_agg(CAST(code AS VARCHAR), ' ' ORDER BY code)), 1, 8) AS s
        FROM hit, range(1, {len(HALVINGS) + 1}) r(k) WHERE inside[k] GROUP BY 1, 2, 3),
fp AS (SELECT doc_id, side, string_agg(coalesce(s, CASE WHEN k = 1 AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = x.doc_id AND h.side = x.side)
                                        THEN own END, '--------'), '.' ORDER BY k) AS f
       FROM (SELECT doc_id, side, k, own FROM o, range(1, {len(HALVINGS) + 1}) r(k)) x LEFT JOIN sig USING (doc_id, side, k)
       GROUP BY 1, 2),
a AS (SELECT e.doc_id, e.n, e.ed, o.f AS f, m.f AS g, x.f AS h FROM e JOIN fp o ON o.doc_id = e.doc_id AND o.side = 0
      JOIN fp m ON m.doc_id = e.doc_id AND m.side = 1 JOIN fp x ON x.doc_id = e.next_id AND x.side = 0)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(ed) AS edited_sha256, f AS fingerprint, g AS edited_fingerprint,
       {_like('f', 'g')} AS near_edited, {_like('f', 'h')} AS near_next FROM a
""")
def op1(spark, d):
    from quire.llm import fingerprints
    return fingerprints.edited_pairs(table(spark, d, "documents"))


# crc32 by its rule: eight shifts a byte, with the reversed polynomial 0xEDB88320
def _crc32(text: str) -> str:
    """DuckDB's crc32 of the UTF-8 bytes of ``text``, unsigned."""
    step = "list_reduce(range(8), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, xor(c, b))"
    bits = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({bits}, lambda c, b: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


@query("op11_importance_resampling", rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS f FROM benchmark),
d AS (SELECT doc_id, unnest(w) AS f FROM w),
b AS (SELECT f, {_crc32('f')} % 10000 AS b FROM (SELECT f FROM d UNION SELECT f FROM v)),
s AS (SELECT b, count(*) AS s FROM d JOIN b USING (f) GROUP BY 1), t AS (SELECT b, count(*) AS t FROM v JOIN b USING (f) GROUP BY 1),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ss, (SELECT coalesce(sum(t), 0) FROM t) AS tt),
g AS (SELECT x.b, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (ss::DOUBLE + 10000)
             / ((coalesce(s, 0)::DOUBLE + 1) * (tt::DOUBLE + 10000)))) AS BIGINT) AS gain
      FROM (SELECT unnest(range(10000)) AS b) x LEFT JOIN s USING (b) LEFT JOIN t USING (b), n),
a AS (SELECT doc_id, sum(gain) AS weight FROM d JOIN b USING (f) JOIN g USING (b) GROUP BY 1),
r AS (SELECT w.doc_id, len(w) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
             CAST('0x' || substr(sha256('2024:' || CAST(w.doc_id AS VARCHAR)), 1, 8) AS BIGINT)::DOUBLE AS h FROM w LEFT JOIN a USING (doc_id)),
k AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM r),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS eligible FROM k WHERE n >= 20)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, CAST(score AS BIGINT) AS score,
       CAST(CASE WHEN place <= eligible * 10 // 100 THEN place END AS BIGINT) AS rank
FROM k LEFT JOIN o USING (doc_id)
""")
def op11(spark, d):
    from quire.llm import resampling
    return resampling.resample(table(spark, d, "documents"), table(spark, d, "benchmark"), percent=10, least_words=20,
                               buckets=10_000, longest=1, seed=2024)


@query("op12_substring_dedup", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY 1),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM g JOIN f USING (g), range(13) t(k) WHERE least < doc_id),
l AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY 1),
k AS (SELECT w.doc_id, w, coalesce(gone, []) AS gone FROM w LEFT JOIN l USING (doc_id)),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
t AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS kept FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i WHERE c.i IS NULL GROUP BY 1)
SELECT k.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM k LEFT JOIN t USING (doc_id)
""")
def op12(spark, d):
    from quire.llm import substrings
    return substrings.remove_repeats(table(spark, d, "documents"), k=13).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_conversation_trie", rf"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':'
                                     || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY pos) AS own, {_crc32('CAST(c AS VARCHAR)')} % 6 AS h FROM t GROUP BY c),
r AS (SELECT o.c, coalesce(b.own, [])[1:CAST(o.h AS BIGINT)] || o.own[CAST(o.h AS BIGINT) + 1:] AS s
      FROM o LEFT JOIN o b ON b.c = o.c - o.c % 100),
m AS (SELECT c, d, s[1:d] AS p, s[1:d - 1] AS up, CASE WHEN d > 0 THEN length(s[d].text) ELSE 0 END AS chars, d = len(s) AS ends
      FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM r)),
n AS (SELECT p, any_value(up) AS up, d, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
             sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256 FROM m GROUP BY p, d),
k AS (SELECT up AS p, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
a AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON n.p = k.p AND n.d = k.d),
x AS (SELECT DISTINCT t.p AS low, t.d AS low_d, t.p[1:y.d] AS p, y.d FROM a t, (SELECT unnest(range(1000)) AS d) y WHERE y.d <= t.d),
u AS (SELECT x.p, x.d, sum(CASE WHEN a.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((a.n_convs - 1) * a.chars) AS saved
      FROM x JOIN a ON a.p = x.low AND a.d = x.low_d GROUP BY 1, 2)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, b.conv_id AS parent_conv_id, a.n_convs, CAST(a.n_children AS BIGINT) AS n_children,
       CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, a.ends_sha256
FROM a JOIN u ON u.p = a.p AND u.d = a.d LEFT JOIN n b ON a.d > 0 AND b.d = a.d - 1 AND b.p = a.up
""")
def op13(spark, d):
    from quire.llm import trie
    return trie.conversation_trie(table(spark, d, "conversations"), block=100, most=6)


@query("op3_html_main_text")
def op3(spark, d):
    from quire.llm import html_extract
    pages = html_extract.extract_text(table(spark, d, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
