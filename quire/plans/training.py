"""Splits, shuffles, batches, batch plans and id-array operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import chat as C
from quire.functions import ids as I
from quire.functions import text as T
from quire.operators import reshape as R
from quire.operators import rows as B
from quire.operators import split as S
from quire.plans.corpus import _j, doc_chunks
from quire.plans.registry import SQL_CHUNKS, query, sql_cp, sql_join, sql_pad, table


# ---------------------------------------------------------------- W-1
@query("take_first", "W-1", """
SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 25
""")
def take_first(spark, d):
    return S.take_first(table(spark, d, "benchmark", "item_id", "text"), 25, ["item_id"])


# ---------------------------------------------------------------- W-2, J-3, U-2
_SPLIT_SQL = """
WITH n AS (SELECT least(32, greatest(1, count(*) // 10)) AS n_eval FROM documents),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents),
labelled AS (SELECT doc_id, CASE WHEN rn <= (SELECT n_eval FROM n) THEN 'test' ELSE 'train' END AS split FROM ranked)
"""


def _doc_split(spark, d):
    return S.exact_split(table(spark, d, "documents", "doc_id"), "doc_id", seed=42, cap=32)


@query("exact_split", "W-2", _SPLIT_SQL + "SELECT doc_id, split FROM labelled")
def exact_split(spark, d):
    return _doc_split(spark, d)


@query("split_complement", "J-3", _SPLIT_SQL + """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labelled WHERE split = 'test')
""")
def split_complement(spark, d):
    docs = table(spark, d, "documents", "doc_id")
    ev = _doc_split(spark, d).filter(F.col("split") == "test")
    return S.split_complement(docs, ev, "doc_id")


@query("split_is_partition", "U-2", """
SELECT * FROM (VALUES ('overlap', 0::BIGINT), ('missing', 0::BIGINT), ('extra', 0::BIGINT)) t("check", violations)
""")
def split_is_partition(spark, d):
    docs = table(spark, d, "documents", "doc_id")
    sp = _doc_split(spark, d)
    return S.split_is_partition(docs, sp.filter(F.col("split") == "train").select("doc_id"),
                                sp.filter(F.col("split") == "test").select("doc_id"), "doc_id")


# ---------------------------------------------------------------- U-1
@query("append_corpus", "U-1", f"""
WITH {SQL_CHUNKS},
b AS (SELECT item_id, s // 512 AS chunk_id, substring(text, s + 1, 512) AS text
      FROM (SELECT item_id, text, unnest(range(0, length(text), 512)) AS s FROM benchmark)),
u AS (SELECT 'documents' AS origin, text FROM chunks UNION ALL SELECT 'benchmark' AS origin, text FROM b
      UNION ALL SELECT 'benchmark' AS origin, text FROM b)
SELECT origin, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM u GROUP BY origin
""")
def append_corpus(spark, d):
    docs = doc_chunks(spark, d).select(F.lit("documents").alias("origin"), "text")
    bench = R.chunk_text(table(spark, d, "benchmark", "item_id", "text")).select(F.lit("benchmark").alias("origin"), "text")
    # appending the same batch twice keeps both copies, as append-mode output does
    u = S.append_corpus(S.append_corpus(docs, bench), bench)
    return u.groupBy("origin").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))


# ---------------------------------------------------------------- W-3, W-4
_SHUF_SQL = """
WITH ranked AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:0:' || CAST(doc_id AS VARCHAR))) - 1 AS idx FROM documents)
"""


@query("seeded_shuffle", "W-3", _SHUF_SQL + "SELECT doc_id, idx AS position FROM ranked")
def seeded_shuffle(spark, d):
    sh = S.shuffle_key(table(spark, d, "documents", "doc_id"), "doc_id", seed=42, epoch=0)
    return S.with_global_index(sh, ["shuffle_key"], "position").select("doc_id", "position")


@query("assign_batches", "W-4", _SHUF_SQL + """
SELECT doc_id, idx // 64 AS batch_id, CAST(idx % 64 AS INTEGER) AS pos_in_batch FROM ranked
""")
def assign_batches(spark, d):
    sh = S.shuffle_key(table(spark, d, "documents", "doc_id"), "doc_id", seed=42, epoch=0)
    return S.assign_batches(sh, ["shuffle_key"], 64).select("doc_id", "batch_id", "pos_in_batch")


@query("batches_by_language", "W-4", """
SELECT lang, idx // 64 AS batch_id, CAST(count(*) AS BIGINT) AS n_docs, CAST(min(idx % 64) AS INTEGER) AS first_pos
FROM (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx FROM documents) GROUP BY ALL
""")
def batches_by_language(spark, d):
    """Batches over a key that a quarter of the rows share: equal keys take consecutive places."""
    b = S.assign_batches(table(spark, d, "documents", "doc_id", "lang"), ["lang"], 64)
    return b.groupBy("lang", "batch_id").agg(F.count("*").alias("n_docs"), F.min("pos_in_batch").alias("first_pos"))


@query("qa_report_repeated", "P-13 G-3", """
WITH q AS (SELECT item_id // 3 AS k, text FROM benchmark),
a AS (SELECT DISTINCT k, 'group ' || CAST(k AS VARCHAR) AS answer FROM q)
SELECT row_number() OVER (ORDER BY k) AS number, k, answer FROM q JOIN a USING (k)
""")
def qa_report_repeated(spark, d):
    """Three questions share every key: each is numbered once."""
    from quire.operators.generate import qa_report as report
    b = table(spark, d, "benchmark", "item_id", "text").select(F.expr("item_id div 3").alias("k"), "text")
    a = b.select("k", F.concat(F.lit("group "), F.col("k").cast("string")).alias("answer")).distinct()
    return report(b, a, "k", "text", "answer").select("number", "k", "answer")


# ---------------------------------------------------------------- W-5
_PLAN_SQL = f"""
WITH {SQL_CHUNKS},
rows AS (SELECT doc_id, chunk_id, least(len({sql_cp("'<|im_start|>' || text")}), 512) AS text_len FROM chunks),
ranked AS (SELECT text_len - 1 AS loss_tokens,
                  row_number() OVER (ORDER BY md5('7:0:' || CAST(doc_id AS VARCHAR) || ':' || CAST(chunk_id AS VARCHAR))) - 1 AS idx
           FROM rows),
batches AS (SELECT idx // 64 AS batch_id, CAST(sum(loss_tokens) AS BIGINT) AS loss_tokens FROM ranked GROUP BY 1),
iters AS (SELECT max(batch_id) + 1 AS n FROM batches),
ep AS (SELECT unnest(range(0, 2)) AS epoch),
steps AS (SELECT epoch, batch_id AS step, epoch * (SELECT n FROM iters) + batch_id AS it,
                 2 * (SELECT n FROM iters) AS total, loss_tokens FROM batches, ep)
SELECT epoch, step, it, loss_tokens,
       round(CASE WHEN it < 5 THEN 2e-4 * it / 5
                  WHEN it > total THEN 2e-5
                  ELSE 2e-5 + 0.5 * (1.0 + cos(pi() * (it - 5) / (total - 5))) * (2e-4 - 2e-5) END, 12) AS lr,
       (step + 1) % 8 = 0 AS optimizer_step, step % 5 = 0 AS log_step, (step + 1) % 20 = 0 AS save_step
FROM steps
"""


@query("batch_plan", "W-5 W-4 W-3", _PLAN_SQL)
def batch_plan(spark, d):
    chunks = doc_chunks(spark, d).withColumn("row_key", F.concat_ws(":", "doc_id", "chunk_id"))
    rows = B.pretrain_rows(chunks, "text", I.codepoint_ids, 512, keep=["row_key"])
    tokens = F.aggregate("loss_mask", F.lit(0).cast("bigint"), lambda a, x: a + x)
    sh = S.shuffle_key(rows.select("row_key", tokens.alias("loss_tokens")), "row_key", seed=7, epoch=0)
    batched = S.assign_batches(sh, ["shuffle_key"], 64)
    per_batch = batched.groupBy("batch_id").agg(F.sum("loss_tokens").cast("bigint").alias("loss_tokens"))
    plan = S.batch_plan(per_batch, epochs=2, accumulation=8, base_lr=2e-4, warmup=5, log_interval=5,
                        save_interval=20)
    return plan.withColumn("lr", F.round("lr", 12))


# ---------------------------------------------------------------- P-13, G-3
@query("qa_report", "P-13 G-3", f"""
SELECT row_number() OVER (ORDER BY item_id) AS number, item_id,
       CASE WHEN length(q) <= 80 THEN q ELSE substring(q, 1, 77) || '...' END AS question,
       'item ' || CAST(item_id AS VARCHAR) || ': ' || CAST(length(text) AS VARCHAR) || ' chars' AS answer
FROM (SELECT item_id, text, trim(regexp_replace(text, '[\\s\\x1c-\\x1f]+', ' ', 'g')) AS q FROM benchmark)
""")
def qa_report(spark, d):
    from quire.operators.generate import qa_report as report
    b = table(spark, d, "benchmark", "item_id", "text")
    answers = b.select("item_id", F.concat(F.lit("item "), F.col("item_id").cast("string"), F.lit(": "),
                                           F.length("text").cast("string"), F.lit(" chars")).alias("answer"))
    return report(b, answers, "item_id", "text", "answer", max_chars=80).select("number", "item_id", "question", "answer")


# ---------------------------------------------------------------- P-14
@query("strip_prompt", "P-14", f"""
SELECT item_id, {sql_join(f"{sql_cp('text || chr(10) || text')}[len({sql_cp('text')}) + 1:]")} AS generated
FROM benchmark
""")
def strip_prompt(spark, d):
    b = table(spark, d, "benchmark", "item_id", "text")
    staged = b.select("item_id", I.codepoint_ids("text").alias("inp"),
                      I.codepoint_ids(F.concat("text", F.lit("\n"), "text")).alias("out"))
    return staged.select("item_id", _j(I.strip_prompt("out", "inp")).alias("generated"))


# ---------------------------------------------------------------- B-ROW-9, 10, 12
_BERT_SQL = f"""
WITH e AS (SELECT item_id, {sql_cp('text')}[1:64] AS ids FROM benchmark),
b AS (SELECT item_id, {sql_pad("ids", 64, 0)} AS input_ids,
             list_concat(list_transform(range(len(ids)), lambda _i: 1), list_transform(range(64 - len(ids)), lambda _i: 0)) AS am
      FROM e)
"""


def _bert(spark, d):
    b = table(spark, d, "benchmark", "item_id", "text").select("item_id", I.codepoint_ids("text").alias("ids"))
    return B.bert_style_inputs(b, "ids", 64, 0, keep=["item_id"])


@query("bert_inputs", "B-ROW-9", _BERT_SQL + f"""
SELECT item_id, {sql_join("input_ids")} AS input_ids, {sql_join("am")} AS attention_mask FROM b
""")
def bert_inputs(spark, d):
    return _bert(spark, d).select("item_id", _j("input_ids").alias("input_ids"), _j("attention_mask").alias("attention_mask"))


@query("attention_mask_bool", "B-ROW-10 B-ROW-12", _BERT_SQL + """
SELECT item_id, len(list_filter(am, lambda x: x > 0)) AS n_true, len(am) AS size,
       greatest(list_sum(am), 1) - 1 AS last_position
FROM b
""")
def attention_mask_bool(spark, d):
    b = _bert(spark, d)
    m = I.normalise_mask("attention_mask", "input_ids")
    return b.select("item_id", F.size(F.filter(m, lambda x: x)).alias("n_true"), F.size(m).alias("size"),
                    I.last_valid_position("attention_mask").alias("last_position"))


# ---------------------------------------------------------------- B-ROW-11
# whole texts; odd batches carry up to two padding ids per row, even ones none
_PADS = "(item_id // 8) % 2 * (item_id % 3)"


@query("left_pad_pack", "B-ROW-11", f"""
WITH e AS (SELECT item_id, item_id // 8 AS batch_id, {sql_cp('text')} AS ids, {_PADS} AS pads FROM benchmark),
m AS (SELECT item_id, batch_id, {sql_pad("ids", "len(ids) + pads", 4)} AS ids,
             list_concat(list_transform(range(len(ids)), lambda _i: true), list_transform(range(pads), lambda _i: false)) AS mask
      FROM e),
v AS (SELECT item_id, batch_id, ids, mask, list_filter(ids, lambda x, i: mask[i]) AS valid,
             len(list_filter(mask, lambda x: x)) AS nv FROM m),
w AS (SELECT *, greatest(max(nv) OVER (PARTITION BY batch_id), 1) AS L,
             min(CASE WHEN list_bool_and(mask) THEN 1 ELSE 0 END) OVER (PARTITION BY batch_id) = 1 AS all_true FROM v)
SELECT item_id, batch_id,
       {sql_join("CASE WHEN all_true THEN ids ELSE list_concat(list_transform(range(L - nv), lambda _i: 4), valid) END")} AS ids,
       {sql_join("list_transform(CASE WHEN all_true THEN mask ELSE list_concat(list_transform(range(L - nv), lambda _i: false), list_transform(range(nv), lambda _i: true)) END, lambda x: CAST(x AS INTEGER))")} AS mask
FROM w
""")
def left_pad_pack(spark, d):
    b = table(spark, d, "benchmark", "item_id", "text")
    batch = F.floor(F.col("item_id") / 8).cast("bigint")
    e = b.select("item_id", batch.alias("batch_id"), I.codepoint_ids("text").alias("_ids"),
                 (batch % 2 * (F.col("item_id") % 3)).cast("int").alias("_pads"))
    m = e.select("item_id", "batch_id", F.concat("_ids", F.array_repeat(F.lit(4), F.col("_pads"))).alias("ids"),
                 F.concat(F.array_repeat(F.lit(True), F.size("_ids")), F.array_repeat(F.lit(False), F.col("_pads"))).alias("mask"))
    out = B.left_pad_pack(m, "ids", "mask", "batch_id", 4)
    return out.select("item_id", "batch_id", _j("ids").alias("ids"),
                      _j(F.transform("mask", lambda x: x.cast("int"))).alias("mask"))


# ---------------------------------------------------------------- B-ROW-14
@query("context_tail", "B-ROW-14", f"""
WITH e AS (SELECT doc_id, {sql_cp('text')} AS ids FROM documents)
SELECT doc_id, len(ids) AS n_ids, {sql_join("ids[greatest(1, len(ids) - 511):greatest(1, len(ids) - 511) + 511]")} AS tail
FROM e
""")
def context_tail(spark, d):
    e = table(spark, d, "documents", "doc_id", "text").select("doc_id", I.codepoint_ids("text").alias("ids"))
    return e.select("doc_id", F.size("ids").alias("n_ids"), _j(I.context_tail("ids", 512)).alias("tail"))


# ---------------------------------------------------------------- M-5, M-6
_STOP_SQL = f"""
WITH e AS (SELECT item_id, item_id // 8 AS batch_id, {sql_cp('text')} AS ids FROM benchmark),
f AS (SELECT item_id, batch_id, ids, list_position(ids, 46) AS p FROM e),
g AS (SELECT item_id, batch_id, p IS NOT NULL AS stopped,
             CASE WHEN p IS NULL THEN ids ELSE list_transform(ids, lambda x, i: CASE WHEN i > p THEN 4 ELSE x END) END AS filled
      FROM f)
"""


def _stopped(spark, d):
    b = table(spark, d, "benchmark", "item_id", "text")
    e = b.select("item_id", F.floor(F.col("item_id") / 8).cast("bigint").alias("batch_id"),
                 I.codepoint_ids("text").alias("ids"))
    return e.select("item_id", "batch_id", I.stop_fill("ids", 46, 4).alias("filled"),
                    F.array_contains("ids", 46).alias("stopped"))


@query("stop_fill", "M-5", _STOP_SQL + f"SELECT item_id, {sql_join('filled')} AS filled FROM g")
def stop_fill(spark, d):
    return _stopped(spark, d).select("item_id", _j("filled").alias("filled"))


@query("all_finished", "M-6", _STOP_SQL + "SELECT batch_id, bool_and(stopped) AS all_finished FROM g GROUP BY batch_id")
def all_finished(spark, d):
    return _stopped(spark, d).groupBy("batch_id").agg(F.bool_and("stopped").alias("all_finished"))
