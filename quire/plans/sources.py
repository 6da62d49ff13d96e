"""Source, sink and streaming queries.

Each writes files that Spark derives from the test tables into a fresh folder
under the checkpoint folder, then reads them back with the operator under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import chat as C
from quire.operators import rows as B
from quire.functions import ids as I
from quire.operators import reshape as R
from quire.operators import split as S
from quire.plans.corpus import _PRE_SQL, _RAW_MAP, _SFT_SQL, H, SQL_MSGS, _j, conv_messages, conv_turns, doc_chunks
from quire.plans.scoring import _QA_SQL, scored
from quire.plans.registry import SQL_CHUNKS, query, sql_join, table
from quire.session import scratch_dir
from quire.sources import jsonl as J
from quire.sources.tables import load_split
from quire.streaming import corpus as ST
from quire.streaming import groups as SG


def _chunk_jsonl(spark, d, compression=None):
    out = f"{scratch_dir(spark, 'chunks-jsonl')}/part"
    J.write_jsonl(doc_chunks(spark, d).select("doc_id", "chunk_id", "text"), out, "overwrite", compression)
    return out


_CHUNK_TEXT_SQL = f"WITH {SQL_CHUNKS} SELECT text FROM chunks"


@query("jsonl_roundtrip", "S-4 S-1", _CHUNK_TEXT_SQL)
def jsonl_roundtrip(spark, d):
    good, _ = J.read_jsonl_text(spark, _chunk_jsonl(spark, d))
    return good.select("text")


@query("bz2_jsonl", "S-9 S-4 S-1", _CHUNK_TEXT_SQL)
def bz2_jsonl(spark, d):
    good, _ = J.read_bz2_jsonl(spark, _chunk_jsonl(spark, d, "bzip2"))
    return good.select("text")


@query("strict_jsonl", "S-2", f"WITH {SQL_CHUNKS} SELECT doc_id, chunk_id, text FROM chunks")
def strict_jsonl(spark, d):
    return J.read_jsonl_strict(spark, _chunk_jsonl(spark, d), "doc_id bigint, chunk_id int, text string")


def _raw_text():
    """A whole text as one line that is no JSON."""
    return F.concat(F.lit("raw: "), F.replace(F.replace("text", F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")))


@query("load_report", "S-1 A-10", f"""
WITH {SQL_CHUNKS}
SELECT 'good' AS reason, count(*) AS n_lines FROM chunks
UNION ALL SELECT 'missing_text', count(*) FROM documents
UNION ALL SELECT 'not_object', count(*) FROM documents
UNION ALL SELECT 'bad_json', count(*) FROM documents
""")
def load_report(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text", "n_chars")
    lines = (doc_chunks(spark, d).select(F.to_json(F.struct("text")).alias("value"))
             .unionByName(docs.select(F.to_json(F.struct("doc_id")).alias("value")))
             .unionByName(docs.select(F.col("n_chars").cast("string").alias("value")))
             .unionByName(docs.select(_raw_text().alias("value"))))
    out = scratch_dir(spark, "mixed-jsonl")
    lines.write.text(out)
    good, rejects = J.read_jsonl_text(spark, out)
    return good.agg(F.count(F.lit(1)).alias("n_lines")).withColumn("reason", F.lit("good")) \
        .unionByName(J.load_report(rejects)).select("reason", "n_lines")


# lines without line breaks, written in (doc_id, chunk_id) order: files in name order hold them so
_LINES_SQL = f"""
WITH {SQL_CHUNKS},
lines AS (SELECT row_number() OVER (ORDER BY doc_id, chunk_id) - 1 AS idx,
                 doc_id || ':' || chunk_id || ' ' || regexp_replace(text, '[\\r\\n]', ' ', 'g') AS value FROM chunks),
placed AS (SELECT idx, value, CAST(strlen(value) + 1 AS BIGINT) AS byte_len,
                  CAST(coalesce(sum(strlen(value) + 1) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position
           FROM lines)
"""


def _chunk_lines(spark, d):
    out = f"{scratch_dir(spark, 'chunk-lines')}/lines"
    line = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("chunk_id").cast("string"), F.lit(" "),
                    F.regexp_replace("text", "[\\r\\n]", " "))
    doc_chunks(spark, d).orderBy("doc_id", "chunk_id").select(line.alias("value")).write.text(out)
    return out


@query("line_index", "S-5", _LINES_SQL + "SELECT idx, position, byte_len FROM placed")
def line_index(spark, d):
    return J.line_index(spark, _chunk_lines(spark, d)).select("idx", "position", "byte_len")


@query("fetch_lines", "S-6 S-5", _LINES_SQL + "SELECT idx, value FROM placed WHERE idx IN (SELECT doc_id FROM labels)")
def fetch_lines(spark, d):
    return J.fetch_lines(spark, _chunk_lines(spark, d), table(spark, d, "labels", "doc_id"), "doc_id").select("idx", "value")


@query("seek_lines", "S-6 S-5", _LINES_SQL + "SELECT idx, value FROM placed WHERE idx IN (SELECT doc_id FROM labels)")
def seek_lines(spark, d):
    index = J.write_line_index(spark, _chunk_lines(spark, d), scratch_dir(spark, "line-index"))
    return J.seek_lines(index, table(spark, d, "labels", "doc_id"), "doc_id").select("idx", "value")


@query("messages_jsonl", "S-3 S-4", f"""
WITH {SQL_MSGS}
SELECT array_to_string(list_transform(m, lambda x: x.role), ',') AS roles, len(m) AS n_messages,
       list_sum(list_transform(m, lambda x: length(x.content))) AS content_chars
FROM msgs
""")
def messages_jsonl(spark, d):
    out = f"{scratch_dir(spark, 'messages-jsonl')}/part"
    J.write_jsonl(conv_messages(spark, d).select("messages"), out)
    m = J.read_messages_jsonl(spark, out)
    return m.select(F.array_join(F.transform("messages", lambda x: x.getField("role")), ",").alias("roles"),
                    F.size("messages").alias("n_messages"),
                    F.aggregate(F.transform("messages", lambda x: F.length(x.getField("content"))),
                                F.lit(0).cast("bigint"), lambda a, b: a + b).alias("content_chars"))


@query("resolve_prompts", "S-8", """
SELECT item_id, text || chr(10) AS prompt FROM benchmark
UNION ALL SELECT item_id, 'plain ' || text FROM benchmark
UNION ALL SELECT item_id, NULL FROM benchmark
""")
def resolve_prompts(spark, d):
    b = table(spark, d, "benchmark", "item_id", "text")
    out = scratch_dir(spark, "prompt-files")
    b.repartition("item_id").write.partitionBy("item_id").text(out)
    # the files that Spark wrote, by item
    files = spark.read.format("binaryFile").load(out).select("item_id", "path")
    prompts = (files.select(F.col("item_id").cast("bigint").alias("item_id"), F.concat(F.lit("FILE:"), "path").alias("prompt"))
               .unionByName(b.select("item_id", F.concat(F.lit("plain "), "text").alias("prompt")))
               .unionByName(b.select("item_id", F.lit(None).cast("string").alias("prompt"))))
    return J.resolve_prompts(spark, prompts, files=out)


@query("load_split", "S-7", "SELECT doc_id, lang, source, n_chars, text FROM documents")
def load_split_q(spark, d):
    return load_split(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", "text")


@query("load_split_json", "S-7 S-4", "SELECT doc_id, lang, text FROM documents UNION ALL SELECT item_id, 'bench', text FROM benchmark")
def load_split_json(spark, d):
    root = scratch_dir(spark, "splits")
    J.write_jsonl(table(spark, d, "documents", "doc_id", "lang", "text"), f"{root}/train")
    table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("bench").alias("lang"), "text").write.parquet(f"{root}/test")
    train, test = load_split(spark, root, "train", "json"), load_split(spark, root, "test")
    return train.select("doc_id", "lang", "text").unionByName(test)


# ---------------------------------------------------------------- streaming
@query("stream_chunk_text", "ST-1 P-1", f"WITH {SQL_CHUNKS} SELECT doc_id, chunk_id, text FROM chunks")
def stream_chunk_text(spark, d):
    schema = table(spark, d, "documents").schema
    out = ST.stream_chunks(spark, d, schema, "documents.parquet")
    return out.select("doc_id", "chunk_id", "text")


@query("stream_loss_by_batch", "ST-2 A-7", """
SELECT event_id // 100 AS log_step,
       round(sum(value * CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)
             / nullif(sum(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 0), 9) AS masked_mean,
       sum(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS mask_sum
FROM events GROUP BY 1
""")
def stream_loss_by_batch(spark, d):
    schema = table(spark, d, "events").schema
    ev = ST.read_stream(spark, d, schema, "events.parquet")
    steps = ev.select("event_id", F.col("value").alias("loss"), (F.col("event_type") != "error").cast("int").alias("mask"))
    rep = ST.running_masked_loss(spark, steps, "loss", "mask", "event_id", 100)
    return rep.select("log_step", F.round("masked_mean", 9).alias("masked_mean"), "mask_sum")


@query("stream_pretrain_length_report", "ST-1 B-ROW-7 B-ROW-13", _PRE_SQL + """
SELECT lang, count(*) AS n_rows, CAST(sum(text_len) AS BIGINT) AS sum_text_len,
       CAST(sum(512 - text_len) AS BIGINT) AS sum_padding_len,
       round(avg(text_len), 6) AS avg_text_len, max(text_len) AS max_text_len,
       quantile_cont(text_len, 0.5) AS median_text_len,
       round(avg(CASE WHEN n_tokens > 512 THEN 1.0 ELSE 0.0 END), 6) AS share_truncated
FROM padded GROUP BY lang
""")
def stream_pretrain_length_report(spark, d):
    schema = table(spark, d, "documents").schema
    rows = ST.stream_pretrain_rows(spark, d, schema, "documents.parquet")
    return B.length_report(rows, ["lang"], 512)


@query("stream_load_report", "ST-1 S-1 A-10", f"""
WITH {SQL_CHUNKS}
SELECT 'good' AS reason, count(*) AS n_lines FROM chunks
UNION ALL SELECT 'missing_text', count(*) FROM documents
UNION ALL SELECT 'not_object', count(*) FROM documents
UNION ALL SELECT 'bad_json', count(*) FROM documents
""")
def stream_load_report(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text", "n_chars")
    lines = (doc_chunks(spark, d).select(F.to_json(F.struct("text")).alias("value"))
             .unionByName(docs.select(F.to_json(F.struct("doc_id")).alias("value")))
             .unionByName(docs.select(F.col("n_chars").cast("string").alias("value")))
             .unionByName(docs.select(_raw_text().alias("value"))))
    src = scratch_dir(spark, "mixed-jsonl-stream")
    lines.write.text(src)
    good, rejects = ST.stream_lenient_jsonl(spark, src)
    return good.agg(F.count(F.lit(1)).alias("n_lines")).withColumn("reason", F.lit("good")) \
        .unionByName(J.load_report(rejects)).select("reason", "n_lines")


# ---------------------------------------------------------------- the two main paths, end to end
_SFT_ROWS_SQL = _SFT_SQL + f"""
SELECT n_tokens, text_len, {sql_join("p[1:511]")} AS X, {sql_join("mk[2:512]")} AS loss_mask FROM masked
"""


def _raw_conversations(spark, d, files: int = 1):
    """Conversations as raw JSON lines: ``{"conversations": [{"from", "value"}]}``."""
    out = f"{scratch_dir(spark, 'raw-conversations')}/part"
    raw = R.collect_turns(conv_turns(spark, d), sender_map=_RAW_MAP)
    raw.select(F.to_json(F.struct("conversations")).alias("value")).repartition(files).write.text(out)
    return out


def _sft_out(rows):
    return rows.select("n_tokens", "text_len", _j("X").alias("X"), _j("loss_mask").alias("loss_mask"))


@query("path_conversations_to_rows", "S-2 P-2 S-4 S-3 R-1 B-ROW-8", _SFT_ROWS_SQL)
def path_conversations_to_rows(spark, d):
    raw = J.read_jsonl_strict(spark, _raw_conversations(spark, d), f"conversations {C.TURN_TYPE}")
    out = f"{scratch_dir(spark, 'messages')}/part"
    J.write_jsonl(raw.select(C.to_messages("conversations").alias("messages")), out)
    return _sft_out(B.sft_rows(J.read_messages_jsonl(spark, out), "messages", I.codepoint_ids, H, 512))


@query("path_corpus_to_batches", "S-4 S-6 S-1 P-1 B-ROW-7 W-4", _PRE_SQL + """,
placed AS (SELECT text_len, row_number() OVER (ORDER BY doc_id, chunk_id) - 1 AS i FROM padded)
SELECT i // 64 AS batch_id, count(*) AS n_rows, CAST(sum(text_len) AS BIGINT) AS tokens, max(i % 64) AS last_pos FROM placed GROUP BY 1
""")
def path_corpus_to_batches(spark, d):
    lines = f"{scratch_dir(spark, 'corpus')}/part"
    J.write_jsonl(table(spark, d, "documents", "doc_id", "text").orderBy("doc_id"), lines)
    reason, text = J.lenient_parse("value")
    docs = J.numbered_lines(spark, lines).select("idx", reason.alias("reason"), text.alias("text")).where("reason is null")
    # every chunk makes one row, so its place is known before its padded arrays: the sort moves the texts alone
    placed = S.assign_batches(R.chunk_text(docs.select("idx", "text")), ["idx", "chunk_id"], 64)
    rows = B.pretrain_rows(placed, "text", I.codepoint_ids, 512, keep=[c for c in placed.columns if c != "text"])
    out = scratch_dir(spark, "batches")
    rows.write.parquet(out)
    return spark.read.parquet(out).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("text_len").cast("bigint").alias("tokens"), F.max("pos_in_batch").alias("last_pos"))


@query("stream_sft_rows", "ST-1 P-2 R-1 B-ROW-8", _SFT_ROWS_SQL)
def stream_sft_rows(spark, d):
    return _sft_out(ST.stream_sft_rows(spark, _raw_conversations(spark, d, 3), header_ids=H, max_files_per_trigger=1))


@query("stream_rewards", "ST-2 A-2 A-3", _QA_SQL + """
SELECT lang, round(avg(reward), 9) AS mean, count(*) AS n, true AS several_updates FROM rewarded GROUP BY lang
""")
def stream_rewards(spark, d):
    log = scratch_dir(spark, "reward-log")
    scored(spark, d).select("lang", "reward").repartition(4).write.parquet(log)
    stream = ST.read_stream(spark, log, "lang string, reward double", max_files_per_trigger=1)
    return ST.running_mean(spark, stream, "reward", "lang").select(
        "lang", F.round("mean", 9).alias("mean"), "n", (F.col("n_updates") > 1).alias("several_updates"))


@query("stream_reward_groups", "ST-2 A-5", """
WITH c AS (SELECT doc_id // 4 AS prompt_id, CASE WHEN length(text) > 300 THEN 1.0 ELSE 0.0 END AS reward FROM documents)
SELECT prompt_id, count(*) AS n, round(avg(reward), 9) AS group_mean, round(stddev_samp(reward), 9) AS group_std,
       max(reward) = min(reward) AS no_signal, true AS complete
FROM c GROUP BY prompt_id HAVING count(*) = 4
""")
def stream_reward_groups(spark, d):
    # four documents make a group; their rows lie in different files, so that they arrive apart
    log = scratch_dir(spark, "completion-log")
    docs = table(spark, d, "documents", "doc_id", "text")
    (docs.select(F.floor(F.col("doc_id") / 4).cast("bigint").alias("prompt_id"), F.col("doc_id").alias("completion_id"),
                 F.when(F.length("text") > 300, 1.0).otherwise(0.0).alias("reward"))
     .repartition(3, "completion_id").write.parquet(log))
    stream = ST.read_stream(spark, log, "prompt_id long, completion_id long, reward double", max_files_per_trigger=1)
    out = scratch_dir(spark, "reward-groups")
    got = SG.run_once_each(SG.stream_reward_groups(stream, 4), f"{out}/data", f"{out}/_checkpoint")
    return got.select("prompt_id", "n", F.round("group_mean", 9).alias("group_mean"), F.round("group_std", 9).alias("group_std"),
                      "no_signal", "complete")
