"""Corpus -> chunks -> pretraining rows; conversations -> messages -> SFT rows.

Array outputs are rendered as space-joined strings for the oracle comparison.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import chat as C
from quire.functions import ids as I
from quire.functions import text as T
from quire.operators import length_sketches as L
from quire.operators import reshape as R
from quire.operators import rows as B
from quire.plans.registry import SQL_CHUNKS, query, sql_cp, sql_join, sql_pad, table

H = I.codepoint_header(C.ASSISTANT_HEADER)
HL = len(H)
H_SQL = "[" + ", ".join(map(str, H)) + "]"


def _j(c):
    return F.array_join(F.col(c) if isinstance(c, str) else c, " ")


def doc_chunks(spark, d):
    return R.chunk_text(table(spark, d, "documents", "doc_id", "lang", "source", "text"), "text", 512)


# ---------------------------------------------------------------- P-1
@query("chunk_text", "P-1", f"""
WITH {SQL_CHUNKS}
SELECT doc_id, chunk_id, text FROM chunks
""")
def chunk_text(spark, d):
    return doc_chunks(spark, d).select("doc_id", "chunk_id", "text")


# ---------------------------------------------------------------- B-ROW-7 (+R-3, B-ROW-1..4)
_PRE_SQL = f"""
WITH {SQL_CHUNKS},
enc AS (SELECT doc_id, chunk_id, lang, {sql_cp("'<|im_start|>' || text")} AS full_ids FROM chunks),
cut AS (SELECT doc_id, chunk_id, lang, len(full_ids) AS n_tokens, full_ids[1:512] AS ids FROM enc),
padded AS (SELECT doc_id, chunk_id, lang, n_tokens, len(ids) AS text_len,
                  {sql_pad("ids", 512, 4)} AS p,
                  list_concat(list_transform(range(len(ids)), lambda _i: 1),
                              list_transform(range(512 - len(ids)), lambda _i: 0)) AS m
           FROM cut)
"""


@query("pretrain_rows", "B-ROW-7 R-3 B-ROW-1 B-ROW-2 B-ROW-3 B-ROW-4", _PRE_SQL + f"""
SELECT doc_id, chunk_id, n_tokens, text_len,
       {sql_join("p[1:511]")} AS X, {sql_join("p[2:512]")} AS Y, {sql_join("m[2:512]")} AS loss_mask
FROM padded
""")
def pretrain_rows(spark, d):
    rows = B.pretrain_rows(doc_chunks(spark, d), "text", I.codepoint_ids, 512, keep=["doc_id", "chunk_id"])
    return rows.select("doc_id", "chunk_id", "n_tokens", "text_len",
                       _j("X").alias("X"), _j("Y").alias("Y"), _j("loss_mask").alias("loss_mask"))


# ---------------------------------------------------------------- B-ROW-13 (entry)
@query("pretrain_length_report", "B-ROW-13 P-1 B-ROW-7", _PRE_SQL + """
SELECT lang, count(*) AS n_rows, CAST(sum(text_len) AS BIGINT) AS sum_text_len,
       CAST(sum(512 - text_len) AS BIGINT) AS sum_padding_len,
       round(avg(text_len), 6) AS avg_text_len, max(text_len) AS max_text_len,
       quantile_cont(text_len, 0.5) AS median_text_len,
       round(avg(CASE WHEN n_tokens > 512 THEN 1.0 ELSE 0.0 END), 6) AS share_truncated
FROM padded GROUP BY lang
""")
def pretrain_length_report(spark, d):
    rows = B.pretrain_rows(doc_chunks(spark, d), "text", I.codepoint_ids, 512, keep=["lang"])
    return B.length_report(rows, ["lang"], 512)


@query("length_rollup", "B-ROW-13", """
WITH l AS (SELECT lang, source, length(text) AS n FROM documents WHERE text IS NOT NULL)
SELECT lang, source, CAST(2 - bit_count(CAST(grouping(lang, source) AS BIGINT)) AS INTEGER) AS level, count(*) AS n_rows,
       CAST(sum(n) AS BIGINT) AS sum_length, max(n) AS max_length, true AS p50_ok, true AS p99_ok
FROM l GROUP BY ROLLUP (lang, source)
""")
def length_rollup(spark, d):
    """Lengths by language and source, by language and over all, with quantiles off the sketches; each quantile is
    held against the exact ranks of all rows, from a count per distinct length."""
    group = ["lang", "source"]
    docs = table(spark, d, "documents", *group, "text").select(*group, F.length("text").cast("long").alias("len"))
    asked = {"p50": 0.5, "p99": 0.99}
    report = L.quantiles(L.roll_up(L.length_sketches(docs, group, "len"), group), asked)
    counts = (docs.where("len is not null").groupBy(*group, "len").agg(F.count(F.lit(1)).alias("k"))
              .select("len", "k", *[c for c in group], F.explode(F.array(*[F.lit(x) for x in range(3)])).alias("at"))
              .select("len", "k", "at", *[F.when(F.col("at") > i, F.col(c)).alias(f"own_{c}") for i, c in enumerate(group)])
              .groupBy("at", "own_lang", "own_source", "len").agg(F.sum("k").alias("k")))
    on = (F.col("at") == F.col("level")) & F.col("own_lang").eqNullSafe(F.col("lang")) & F.col("own_source").eqNullSafe(F.col("source"))
    ranks = [F.sum(F.when(F.col("len") < F.col(p), F.col("k")).otherwise(0)).alias(f"{p}_below") for p in asked]
    ranks += [F.sum(F.when(F.col("len") <= F.col(p), F.col("k")).otherwise(0)).alias(f"{p}_upto") for p in asked]
    keys = ["lang", "source", "level", "n_rows", "sum_length", "max_length"]
    seen = counts.join(report, on).groupBy(*keys).agg(*ranks)
    # a group of a few rows has no rank nearer than one row
    off = F.lit(L.RANK_ERROR) * F.col("n_rows") + 1
    return seen.select(*keys, *[((F.col(f"{p}_below") - off <= q * F.col("n_rows")) & (F.col(f"{p}_upto") + off >= q * F.col("n_rows"))).alias(f"{p}_ok")
                                for p, q in asked.items()])


# ---------------------------------------------------------------- conversations
_RAW_MAP = {"user": "human"}  # the long table already says user; raw corpora say human

SQL_MSGS = """
turns AS (
  SELECT conv_id, list({'f': CASE role WHEN 'user' THEN 'human' ELSE role END, 'v': text} ORDER BY turn) AS t
  FROM conversations GROUP BY conv_id
),
msgs AS (
  SELECT conv_id, len(t) - len(list_filter(t, lambda x: x.f IN ('human', 'assistant'))) AS dropped,
         list_concat([{'role': 'system', 'content': '你是一个AI助手'}],
                     list_transform(list_filter(t, lambda x: x.f IN ('human', 'assistant')),
                                    lambda x: {'role': CASE WHEN x.f = 'human' THEN 'user' ELSE 'assistant' END,
                                               'content': x.v})) AS m
  FROM turns
)"""


def sql_chatml(m: str, gen: bool = False) -> str:
    body = (f"array_to_string(list_transform(list_filter({m}, lambda x: x.role IN ('system', 'user', 'assistant')), "
            "lambda x: '<|im_start|>' || x.role || chr(10) || coalesce(x.content, '') || '<|im_end|>' || chr(10)), '')")
    return f"({body} || '<|im_start|>assistant' || chr(10))" if gen else body


def conv_messages(spark, d):
    long = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    return R.collect_messages(long, "conv_id", "turn", "role", "text", sender_map=_RAW_MAP)


def conv_turns(spark, d):
    return table(spark, d, "conversations", "conv_id", "turn", "role", "text")


@query("to_messages", "P-2 P-3 P-4 P-5", f"""
WITH {SQL_MSGS}
SELECT conv_id, array_to_string(list_transform(m, lambda x: x.role), ',') AS roles,
       dropped AS dropped_turns, len(m) AS n_messages,
       list_sum(list_transform(m, lambda x: length(x.content))) AS content_chars,
       m[len(m)].content AS last_content
FROM msgs
""")
def to_messages(spark, d):
    m = conv_messages(spark, d)
    return m.select("conv_id", F.array_join(F.transform("messages", lambda x: x.getField("role")), ",").alias("roles"),
                    "dropped_turns", F.size("messages").alias("n_messages"),
                    F.aggregate(F.transform("messages", lambda x: F.length(x.getField("content"))),
                                F.lit(0).cast("bigint"), lambda a, b: a + b).alias("content_chars"),
                    F.element_at("messages", -1).getField("content").alias("last_content"))


@query("template_report", "R-1 Q-4", f"""
WITH {SQL_MSGS}
SELECT conv_id, {sql_chatml("m", True)} AS prompt,
       list_bool_or(list_transform(m, lambda x: x.content LIKE '%<|im_start|>%' OR x.content LIKE '%<|im_end|>%'
                    OR x.content LIKE '%<unk>%' OR x.content LIKE '%<s>%' OR x.content LIKE '%</s>%')) AS spells_special
FROM msgs
""")
def template_report(spark, d):
    m = conv_messages(spark, d)
    flag = F.exists("messages", lambda x: C.spells_special(x.getField("content")))
    return m.select("conv_id", C.render_chatml("messages", add_generation_prompt=True).alias("prompt"),
                    flag.alias("spells_special"))


@query("render_plain", "R-2", f"""
WITH {SQL_MSGS}
SELECT conv_id,
  array_to_string(list_transform(list_filter(m, lambda x: x.role IN ('system', 'user', 'assistant')),
    lambda x: CASE x.role WHEN 'system' THEN 'System: ' || x.content || chr(10)
                          WHEN 'user' THEN 'User: ' || x.content || chr(10)
                          ELSE 'Assistant: ' || x.content || '<|im_end|>' || chr(10) END), '') || 'Assistant: ' AS prompt
FROM msgs
""")
def render_plain(spark, d):
    m = conv_messages(spark, d)
    return m.select("conv_id", C.render_plain("messages", C.EOS, add_generation_prompt=True).alias("prompt"))


_SFT_SQL = f"""
WITH {SQL_MSGS},
enc AS (SELECT conv_id, {sql_cp(sql_chatml("m"))} AS full_ids FROM msgs),
cut AS (SELECT conv_id, len(full_ids) AS n_tokens, full_ids[1:512] AS ids FROM enc),
padded AS (SELECT conv_id, n_tokens, len(ids) AS text_len, {sql_pad("ids", 512, 4)} AS p FROM cut),
starts AS (SELECT conv_id, n_tokens, text_len, p,
                  list_filter(range(0, 512 - {HL} + 1), lambda i: p[i + 1] = 3 AND p[i + 1:i + {HL}] = {H_SQL}) AS st
           FROM padded),
spans AS (SELECT conv_id, n_tokens, text_len, p,
                 list_filter(list_transform(st, lambda s: {{'lo': s + {HL},
                     'hi': s + {HL} + list_position(p[s + {HL} + 1:512], 4) - 1}}), lambda x: x.hi IS NOT NULL) AS sp
          FROM starts),
masked AS (SELECT conv_id, n_tokens, text_len, p,
                  list_transform(range(0, 512), lambda q: CASE WHEN len(list_filter(sp, lambda x: q >= x.lo AND q <= x.hi)) > 0
                                                              THEN 1 ELSE 0 END) AS mk
           FROM spans)
"""


@query("sft_rows", "B-ROW-8 B-ROW-5 R-1 P-3", _SFT_SQL + f"""
SELECT conv_id, n_tokens, text_len, {sql_join("p[1:511]")} AS X, {sql_join("p[2:512]")} AS Y,
       {sql_join("mk[2:512]")} AS loss_mask
FROM masked
""")
def sft_rows(spark, d):
    rows = B.sft_rows_from_turns(conv_turns(spark, d), sender_map=_RAW_MAP, header_ids=H)
    return rows.select("conv_id", "n_tokens", "text_len", _j("X").alias("X"), _j("Y").alias("Y"),
                       _j("loss_mask").alias("loss_mask"))


@query("sft_loss_tokens", "B-ROW-8 B-ROW-5 B-ROW-13", _SFT_SQL + """
SELECT count(*) AS n_rows, CAST(sum(list_sum(mk[2:512])) AS BIGINT) AS loss_tokens,
       CAST(sum(text_len) AS BIGINT) AS sum_text_len,
       CAST(sum(CASE WHEN n_tokens > 512 THEN 1 ELSE 0 END) AS BIGINT) AS n_truncated,
       CAST(sum(CASE WHEN list_sum(mk) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_without_answer
FROM masked
""")
def sft_loss_tokens(spark, d):
    rows = B.sft_rows_from_turns(conv_turns(spark, d), sender_map=_RAW_MAP, header_ids=H)
    tok = F.aggregate("loss_mask", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(tok).alias("loss_tokens"),
                    F.sum("text_len").cast("bigint").alias("sum_text_len"),
                    F.sum((F.col("n_tokens") > 512).cast("bigint")).alias("n_truncated"),
                    F.sum((tok == 0).cast("bigint")).alias("n_without_answer"))


_SEG_SQL = f"""
WITH {SQL_MSGS},
segs AS (
  SELECT conv_id, flatten(list_transform(list_filter(m, lambda x: x.role IN ('system', 'user', 'assistant')),
    lambda x: CASE x.role WHEN 'system' THEN [{{'text': 'System: ' || x.content || chr(10), 'tr': 0}}]
                          WHEN 'user' THEN [{{'text': 'User: ' || x.content || chr(10), 'tr': 0}}]
                          ELSE [{{'text': 'Assistant: ', 'tr': 0}}, {{'text': x.content || '<|im_end|>', 'tr': 1}},
                                {{'text': chr(10), 'tr': 0}}] END)) AS sg
  FROM msgs),
enc AS (SELECT conv_id, list_transform(sg, lambda s: {{'ids': {sql_cp("s.text")}, 'tr': s.tr}}) AS e FROM segs),
flat AS (SELECT conv_id, flatten(list_transform(e, lambda s: s.ids)) AS full_ids,
                flatten(list_transform(e, lambda s: list_transform(s.ids, lambda _x: s.tr))) AS fl FROM enc),
cut AS (SELECT conv_id, len(full_ids) AS n_tokens, full_ids[1:512] AS ids, fl[1:512] AS f FROM flat),
padded AS (SELECT conv_id, n_tokens, len(ids) AS text_len, {sql_pad("ids", 512, 4)} AS p, {sql_pad("f", 512, 0)} AS mk
           FROM cut)
"""


@query("sft_segment_rows", "R-5 B-ROW-6", _SEG_SQL + f"""
SELECT conv_id, n_tokens, text_len, {sql_join("p[1:511]")} AS X, {sql_join("mk[2:512]")} AS loss_mask FROM padded
""")
def sft_segment_rows(spark, d):
    rows = B.segment_rows(conv_messages(spark, d), "messages", I.codepoint_ids, C.EOS, 512, keep=["conv_id"])
    return rows.select("conv_id", "n_tokens", "text_len", _j("X").alias("X"), _j("loss_mask").alias("loss_mask"))


# ---------------------------------------------------------------- P-9, P-10, P-11, P-12
@query("preference_pairs", "P-9 P-12", f"""
WITH {SQL_MSGS},
pairs AS (
  SELECT conv_id, m AS chosen,
         list_transform(m, lambda x: {{'role': x.role, 'content': CASE WHEN x.role = 'assistant'
                                        THEN substring(x.content, 1, length(x.content) // 2) ELSE x.content END}}) AS rejected
  FROM msgs)
SELECT conv_id,
       list_filter(chosen, lambda x: x.role = 'user')[1].content AS "user",
       substring(list_filter(chosen, lambda x: x.role = 'assistant')[1].content, 1, 120) AS chosen,
       substring(list_filter(rejected, lambda x: x.role = 'assistant')[1].content, 1, 120) AS rejected,
       (list_filter(chosen, lambda x: x.role = 'user')[1].content IS NOT NULL
        AND list_filter(chosen, lambda x: x.role = 'assistant')[1].content IS NOT NULL
        AND list_filter(rejected, lambda x: x.role = 'assistant')[1].content IS NOT NULL) AS complete
FROM pairs
""")
def preference_pairs(spark, d):
    m = conv_messages(spark, d)
    def halve(x):
        c = x.getField("content")
        cut = F.substring(c, F.lit(1), F.floor(F.length(c) / 2).cast("int"))
        return F.struct(x.getField("role").alias("role"),
                        F.when(x.getField("role") == "assistant", cut).otherwise(c).alias("content"))
    half = F.transform("messages", halve)
    pairs = m.select("conv_id", F.col("messages").alias("chosen"), half.alias("rejected"))
    return R.preference_pairs(pairs, "chosen", "rejected", keep=("conv_id",), max_chars=120)


@query("first_turn", "P-10", """
SELECT conv_id, arg_min(text, turn) AS first_user FROM conversations WHERE role = 'user' GROUP BY conv_id
""")
def first_turn(spark, d):
    long = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    return R.first_turn(long, "user", out="first_user")


_WS_SQL = "'[\\s\\x1c-\\x1f]+'"


def _sql_shorten(x: str, n: int = 80) -> str:
    sq = f"trim(regexp_replace({x}, {_WS_SQL}, ' ', 'g'))"
    return f"CASE WHEN length({sq}) <= {n} THEN {sq} ELSE substring({sq}, 1, {n - 3}) || '...' END"


@query("preview", "P-11", f"""
WITH u AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS um,
                  arg_min(text, turn) FILTER (WHERE role = 'assistant') AS am
           FROM conversations GROUP BY conv_id)
SELECT conv_id, {_sql_shorten("um")} AS user_message, {_sql_shorten("am")} AS assistant_message
FROM u ORDER BY conv_id LIMIT 3
""")
def preview(spark, d):
    long = conv_turns(spark, d)
    shown = long.select("conv_id").distinct().orderBy("conv_id").limit(3)

    def first(role):
        own = F.col("role") == role
        return F.min_by(F.when(own, F.col("text")), F.when(own, F.col("turn")))

    firsts = (long.join(shown, "conv_id", "left_semi").groupBy("conv_id")
              .agg(first("user").alias("um"), first("assistant").alias("am")))
    return R.preview(firsts, {"user_message": "um", "assistant_message": "am"}, n=3, max_chars=80, order=["conv_id"])


# ---------------------------------------------------------------- R-3, R-4
@query("render_bracketed", "R-4 R-3", f"""
SELECT item_id, '<|im_start|>' || text || '<|im_end|>' AS bracketed,
       len({sql_cp("'<|im_start|>' || text || '<|im_end|>'")}) AS n_ids,
       len({sql_cp("'<|im_start|>' || text")}) AS n_ids_pretrain
FROM benchmark
""")
def render_bracketed(spark, d):
    b = table(spark, d, "benchmark", "item_id", "text")
    return b.select("item_id", C.render_bracketed("text").alias("bracketed"),
                    F.size(I.codepoint_ids(C.render_bracketed("text"))).alias("n_ids"),
                    F.size(I.codepoint_ids(C.render_pretrain("text"))).alias("n_ids_pretrain"))
