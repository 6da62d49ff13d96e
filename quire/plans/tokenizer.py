"""Tokenizer queries: corpus statistics, BPE training, encoding, reports.

DuckDB's regular expressions have no lookahead; the word queries mark the last
white-space character before a word, after which the split needs none. Encoding
is checked by decoding: the decoded text must be the text. Ids and merges are
checked in ``tests/test_tokenizer.py`` against the ``tokenizers`` package.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import chat as C
from quire.functions import ids as I
from quire.operators import rows as B
from quire.operators import tokenizer as TK
from quire.plans.corpus import _RAW_MAP, SQL_MSGS, _j, conv_messages, conv_turns, doc_chunks, sql_chatml
from quire.plans.registry import SQL_CHUNKS, query, sql_cp, table
from quire.session import scratch_dir

EXACT_VOCAB = 6144  # the reference's vocabulary: five special tokens, 256 bytes, 5,883 merges


def exact_model(spark, d: str, vocab_size: int = EXACT_VOCAB) -> TK.BpeModel:
    """T-5 on the documents of ``d``, merge for merge as one-at-a-time training."""
    return TK.train_bpe(table(spark, d, "documents", "text"), "text", vocab_size=vocab_size, min_frequency=2)


def query_model(path: str | None = None) -> TK.BpeModel:
    """The model of the encoding queries: a published 50,257-entry byte-level vocabulary under this
    engine's special tokens; ``path`` names another tokenizer file."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    return TK.BpeModel.from_tokenizer_file(path)


# ---------------------------------------------------------------- SQL-checked variants
@query("word_counts_ws", "T-4", """
SELECT word, count(*) AS cnt
FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: length(x) > 0)) AS word FROM documents)
GROUP BY word
""")
def word_counts_ws(spark, d):
    return TK.whitespace_word_counts(table(spark, d, "documents", "text"), "text")


@query("pair_counts", "A-9", """
WITH w AS (SELECT word, count(*) AS cnt
           FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: length(x) > 0)) AS word
                 FROM documents) GROUP BY word),
p AS (SELECT substring(word, i, 1) AS "left", substring(word, i + 1, 1) AS "right", cnt
      FROM (SELECT word, cnt, unnest(range(1, length(word))) AS i FROM w))
SELECT "left", "right", CAST(sum(cnt) AS BIGINT) AS cnt FROM p GROUP BY 1, 2
""")
def pair_counts(spark, d):
    wc = TK.whitespace_word_counts(table(spark, d, "documents", "text"), "text")
    sym = wc.select(F.regexp_extract_all("word", F.lit("(?s)."), 0).alias("symbols"), "cnt")
    return TK.pair_counts(sym, "symbols", "cnt")


_CP_VOCAB_IDS = list(range(0, 5)) + list(range(32, 384))


def codepoint_vocab(spark):
    """A code-point vocabulary: the five special tokens, then U+0020..U+017F (a rule, not a list).

    Ids beyond it (newlines, say) are reported without a token.
    """
    rows = [(i, I.SPECIAL_TOKENS[i] if i < 5 else chr(i), i < 5) for i in _CP_VOCAB_IDS]
    return spark.createDataFrame(rows, "id int, token string, is_special boolean")


@query("vocab_usage", "Q-3", f"""
WITH v AS (SELECT i AS id, CASE WHEN i = 0 THEN '<unk>' WHEN i = 1 THEN '<s>' WHEN i = 2 THEN '</s>'
                               WHEN i = 3 THEN '<|im_start|>' WHEN i = 4 THEN '<|im_end|>' ELSE chr(CAST(i AS INTEGER)) END AS token,
                  i < 5 AS is_special
           FROM (SELECT unnest(list_concat(range(0, 5), range(32, 384))) AS i)),
u AS (SELECT id, count(*) AS uses FROM (SELECT unnest({sql_cp('text')}) AS id FROM documents) GROUP BY id)
SELECT coalesce(v.id, u.id) AS id, v.token, v.is_special, CAST(coalesce(u.uses, 0) AS BIGINT) AS uses
FROM v FULL OUTER JOIN u ON v.id = u.id
""")
def vocab_usage(spark, d):
    enc = table(spark, d, "documents", "text").select(I.codepoint_ids("text").alias("ids"))
    return TK.vocab_usage(enc, codepoint_vocab(spark), "ids")


@query("token_lookup", "J-4 T-7", f"""
WITH v AS (SELECT DISTINCT unicode(ch) AS id, ch AS token
           FROM (SELECT unnest(regexp_extract_all(text, '(?s:.)')) AS ch FROM documents)),
e AS (SELECT item_id, unnest(range(1, len(ids) + 1)) AS pos, unnest(ids) AS id
      FROM (SELECT item_id, {sql_cp('text')} AS ids FROM benchmark))
SELECT item_id, string_agg(coalesce(v.token, '?'), '' ORDER BY pos) AS decoded, count(*) - count(v.token) AS n_missing
FROM e LEFT JOIN v ON e.id = v.id GROUP BY item_id
""")
def token_lookup(spark, d):
    chars = table(spark, d, "documents", "text").select(F.explode(F.regexp_extract_all("text", F.lit("(?s)."), 0)).alias("token"))
    vocab = chars.distinct().select(F.ascii("token").alias("id"), "token")
    ids = table(spark, d, "benchmark", "item_id", "text").select(
        "item_id", F.posexplode(I.codepoint_ids("text")).alias("pos", "id"))
    j = ids.join(vocab, "id", "left")
    toks = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("token", F.lit("?")).alias("token"))))
    return j.groupBy("item_id").agg(
        F.array_join(F.transform(toks, lambda x: x.getField("token")), "").alias("decoded"),
        (F.count(F.lit(1)) - F.count("token")).alias("n_missing"))


# ---------------------------------------------------------------- words
# a mark before the last white-space character in front of a word stands in for the lookahead
_WORDS_SQL = r"""
WITH w AS (SELECT word, count(*) AS cnt FROM (
  SELECT unnest(regexp_extract_all(regexp_replace(text, '(\s)(\S)', chr(1) || '\1\2', 'g'),
    '''s|''t|''re|''ve|''m|''ll|''d| ?\pL+| ?\pN+| ?[^\s\pL\pN\x01]+|\s+|\x01')) AS word FROM documents)
  WHERE word <> chr(1) GROUP BY word)
"""


@query("word_counts", "T-4 T-1 T-2", _WORDS_SQL + "SELECT word, cnt FROM w")
def word_counts(spark, d):
    return TK.word_counts(table(spark, d, "documents", "text"), "text")


@query("word_symbols", "T-3 T-4", _WORDS_SQL + """,
b AS (SELECT word, cnt, list_transform(range(0, strlen(word)), lambda i: CAST('0x' || substr(hex(word), CAST(2 * i + 1 AS INT), 2) AS INT)) AS b FROM w)
SELECT word, cnt, array_to_string(list_transform(b, lambda x: 5 + CASE
  WHEN x BETWEEN 33 AND 126 THEN x - 33 WHEN x BETWEEN 161 AND 172 THEN x - 67 WHEN x >= 174 THEN x - 68
  WHEN x < 33 THEN 188 + x WHEN x = 173 THEN 255 ELSE x + 94 END), ' ') AS symbols
FROM b
""")
def word_symbols(spark, d):
    wc = TK.word_counts(table(spark, d, "documents", "text"), "text")
    return wc.select("word", "cnt", _j(TK.word_symbols("word")).alias("symbols"))


# characters that NFKC changes, put before every second text
_WIDE, _PLAIN = "Ａ１ ﬁne ² ", "A1 fine 2 "


@query("nfkc", "T-1", f"""
SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN '{_PLAIN}' || text ELSE text END AS text, doc_id % 2 = 1 AS changed FROM documents
""")
def nfkc(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    given = docs.withColumn("orig", F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit(_WIDE), "text")).otherwise(F.col("text")))
    n = TK.nfkc(given.withColumn("text", F.col("orig")), "text")
    return n.select("doc_id", "text", (F.col("text") != F.col("orig")).alias("changed"))


# ---------------------------------------------------------------- BPE
@query("train_bpe", "T-5")
def train_bpe(spark, d):
    return exact_model(spark, d).merges_df(spark)


@query("tokenizer_files", "T-8", """
SELECT 'vocab' AS part, 50261 AS n, 0 AS n_different UNION ALL SELECT 'config', 11, 0 UNION ALL SELECT 'special', 5, 0
""")
def tokenizer_files(spark, d):
    import json
    m = query_model()
    out = scratch_dir(spark, "tokenizer")
    m.save(spark, out)
    back = TK.BpeModel.load(spark, out)
    both = m.vocab_df(spark).join(back.vocab_df(spark).select("id", F.col("token").alias("again")), "id", "full_outer")
    rows = both.select(F.lit("vocab").alias("part"), (~F.col("token").eqNullSafe(F.col("again"))).cast("int").alias("bad"))
    for part, name in (("config", "tokenizer_config.json"), ("special", "special_tokens_map.json")):
        read = spark.read.text(f"{out}/{name}", wholetext=True).select(F.try_parse_json("value").alias("v"))
        keys = m.files()[name]
        got = read.select(F.explode(F.array(*[F.struct(
            F.lit(json.dumps(v) if not isinstance(v, str) else v).alias("want"),
            F.variant_get("v", f"$.{k}", "string").alias("got")) for k, v in keys.items()])).alias("x"))
        same = F.replace("x.want", F.lit(" "), F.lit("")).eqNullSafe(F.replace("x.got", F.lit(" "), F.lit("")))
        rows = rows.unionByName(got.select(F.lit(part).alias("part"), (~same).cast("int").alias("bad")))
    return rows.groupBy("part").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("bad").cast("int").alias("n_different"))


_CHUNKS_SQL = f"WITH {SQL_CHUNKS} "


@query("bpe_encode", "T-6")
def bpe_encode(spark, d):
    enc = query_model().encoder(spark)
    return doc_chunks(spark, d).select("doc_id", "chunk_id", enc(F.col("text")).alias("ids")).select(
        "doc_id", "chunk_id", F.size("ids").alias("n_tokens"), _j("ids").alias("ids"))


@query("bpe_decode", "T-6 T-7", _CHUNKS_SQL + "SELECT doc_id, chunk_id, '<|im_start|>' || text AS kept, text AS skipped FROM chunks")
def bpe_decode(spark, d):
    m = query_model()
    enc, keep, skip = m.encoder(spark), m.decoder(spark), m.decoder(spark, skip_special_tokens=True)
    ids = doc_chunks(spark, d).select("doc_id", "chunk_id", enc(C.render_pretrain("text")).alias("ids"))
    # one generated row per row: a text is encoded once, not by each of the decoders
    ids = ids.select("doc_id", "chunk_id", F.explode(F.array(F.struct("ids"))).alias("r"))
    return ids.select("doc_id", "chunk_id", keep("r.ids").alias("kept"), skip("r.ids").alias("skipped"))


@query("bpe_roundtrip", "Q-1 T-7", _CHUNKS_SQL + "SELECT lang, 1.0 AS roundtrip_rate, count(*) AS n FROM chunks GROUP BY lang")
def bpe_roundtrip(spark, d):
    return TK.roundtrip_report(doc_chunks(spark, d), query_model(), "text", ["lang"])


@query("special_tokens_preserved", "Q-2", "SELECT count(DISTINCT conv_id) AS n_with_special, count(DISTINCT conv_id) AS n_preserved FROM conversations")
def special_tokens_preserved(spark, d):
    prompts = conv_messages(spark, d).select(C.render_chatml("messages").alias("text"))
    return TK.special_tokens_preserved(prompts, query_model(), "text")


@query("bpe_vocab_usage", "Q-3 T-6", "SELECT CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents")
def bpe_vocab_usage(spark, d):
    """The characters that all counted uses spell: every use is counted, and of the right token."""
    m = query_model()
    enc = m.encoder(spark)
    used = TK.vocab_usage(doc_chunks(spark, d).select(enc(F.col("text")).alias("ids")), m.vocab_df(spark), "ids")
    # a byte symbol begins a character unless it stands for a UTF-8 continuation byte
    inner = "".join(TK.BYTE_CHARS[0x80:0xC0])
    begins = F.length(F.translate("token", inner, ""))
    return used.where("uses > 0").agg(F.sum(F.col("uses") * begins).cast("bigint").alias("n_chars"))


def _decoded(rows, dec, *keys):
    """Per row its keys, its own ids as text, and the ids that its loss mask marks as text."""
    # one generated row per row: the arrays are made once, before anything reads them
    made = rows.select(*keys, F.explode(F.array(F.struct("X", "Y", "loss_mask", "text_len"))).alias("r"))
    whole = F.slice(F.concat(F.slice("r.X", 1, 1), "r.Y"), F.lit(1), F.col("r.text_len"))
    # compiled up to the last mark: what a lambda or generator holds is interpreted
    after = F.array_position(F.reverse("r.loss_mask"), F.lit(1).cast("bigint"))
    upto = F.when(after > 0, F.size("r.loss_mask") - after + 1).otherwise(0).cast("int")
    # a row that waits for the decoder holds its own ids alone: the padded arrays end here
    ids = made.select(*keys, whole.alias("whole"), F.slice("r.Y", F.lit(1), upto).alias("y"), F.slice("r.loss_mask", F.lit(1), upto).alias("m"))
    ids = ids.select(*keys, F.explode(F.array(F.struct("whole", "y", "m"))).alias("d"))
    marked = F.filter("d.y", lambda y, i: F.get("d.m", i) == 1)
    return ids.select(*keys, dec(F.col("d.whole").cast("array<int>")).alias("rendered"), dec(marked.cast("array<int>")).alias("answers"))


@query("bpe_pretrain_rows", "B-ROW-7 T-6", _CHUNKS_SQL + """
SELECT doc_id, chunk_id, '<|im_start|>' || text AS rendered, text AS answers FROM chunks
""")
def bpe_pretrain_rows(spark, d):
    m = query_model()
    # 512 characters are 2,048 bytes at most, so a chunk always fits
    rows = B.pretrain_rows(doc_chunks(spark, d), "text", m.encoder(spark), 2049, keep=["doc_id", "chunk_id"])
    return _decoded(rows, m.decoder(spark), "doc_id", "chunk_id")


@query("bpe_sft_rows", "B-ROW-8 B-ROW-5 T-6")
def bpe_sft_rows(spark, d):
    m = query_model()
    rows = B.sft_rows_from_turns(conv_turns(spark, d), sender_map=_RAW_MAP, encoder=m.encoder(spark),
                                 header_ids=m.header_ids(C.ASSISTANT_HEADER))
    return rows.select("conv_id", "n_tokens", "text_len", _j("loss_mask").alias("loss_mask"))


_ANSWERS_SQL = "array_to_string(list_transform(list_filter(m, lambda x: x.role = 'assistant'), lambda x: x.content || '<|im_end|>'), '') AS answers"
WHOLE_ROW = 1 << 14  # ids; the test conversations fit whole


@query("bpe_sft_answers", "B-ROW-8 B-ROW-5 T-6 T-7", f"""
WITH {SQL_MSGS}
SELECT conv_id, {sql_chatml("m")} AS rendered, {_ANSWERS_SQL} FROM msgs
""")
def bpe_sft_answers(spark, d):
    """The row, decoded, is the rendering; what its mask marks, decoded, is the assistant's answers."""
    m = query_model()
    rows = B.sft_rows(conv_messages(spark, d), "messages", m.encoder(spark), m.header_ids(C.ASSISTANT_HEADER), WHOLE_ROW, keep=["conv_id"])
    return _decoded(rows, m.decoder(spark), "conv_id")


@query("bpe_segment_rows", "B-ROW-6 R-5 T-6 T-7", f"""
WITH {SQL_MSGS}
SELECT conv_id,
  array_to_string(list_transform(list_filter(m, lambda x: x.role IN ('system', 'user', 'assistant')),
    lambda x: CASE x.role WHEN 'system' THEN 'System: ' || x.content || chr(10)
                          WHEN 'user' THEN 'User: ' || x.content || chr(10)
                          ELSE 'Assistant: ' || x.content || '<|im_end|>' || chr(10) END), '') AS rendered, {_ANSWERS_SQL}
FROM msgs
""")
def bpe_segment_rows(spark, d):
    m = query_model()
    rows = B.segment_rows(conv_messages(spark, d), "messages", m.encoder(spark), C.EOS, WHOLE_ROW, keep=["conv_id"],
                          array_encoder=m.array_encoder(spark))
    return _decoded(rows, m.decoder(spark), "conv_id")
