"""Next-token table and beam steps.

The count-based next-token table is derived from the documents (code-point
ids); prompts are the benchmark items.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import ids as I
from quire.operators import generate as G
from quire.plans.corpus import _j
from quire.plans.registry import query, sql_cp, table

_NT_SQL = f"""
WITH e AS (SELECT {sql_cp('text')} AS ids FROM documents),
p AS (SELECT ids[i] AS ctx, ids[i + 1] AS nxt FROM (SELECT ids, unnest(range(1, len(ids))) AS i FROM e)),
c AS (SELECT ctx, nxt, count(*) AS cnt FROM p GROUP BY 1, 2),
t AS (SELECT ctx, sum(cnt) AS tot FROM c GROUP BY 1),
nt AS (SELECT c.ctx, c.nxt, c.cnt, ln(c.cnt / t.tot) AS logprob FROM c JOIN t ON c.ctx = t.ctx)
"""


def doc_table(spark, d):
    ids = table(spark, d, "documents", "text").select(I.codepoint_ids("text").alias("ids"))
    return G.next_token_table(ids, "ids", order=1)


def bench_prompts(spark, d):
    return table(spark, d, "benchmark", "item_id", "text").select(
        F.col("item_id").alias("prompt_id"), I.codepoint_ids("text").alias("ids"))


@query("next_token_table", "G-1", _NT_SQL + """
SELECT CAST(ctx AS VARCHAR) AS context, nxt AS "next", cnt, round(logprob, 9) AS logprob FROM nt
""")
def next_token_table(spark, d):
    t = doc_table(spark, d)
    return t.select(_j("context").alias("context"), "next", "cnt", F.round("logprob", 9).alias("logprob"))


@query("beam_step", "J-5 W-7", _NT_SQL + """,
cands AS (SELECT ctx, nxt, logprob, row_number() OVER (PARTITION BY ctx ORDER BY logprob DESC, nxt) - 1 AS k FROM nt),
top AS (SELECT * FROM cands WHERE k < 3),
b0 AS (SELECT item_id, 0 AS beam_id, {cp} AS tokens, 0.0::DOUBLE AS score FROM benchmark),
x1 AS (SELECT b.item_id, b.beam_id AS parent, t.k, list_append(b.tokens, t.nxt) AS tokens, b.score + t.logprob AS score
       FROM b0 b JOIN top t ON b.tokens[len(b.tokens)] = t.ctx),
b1 AS (SELECT item_id, tokens, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, parent, k) - 1 AS beam_id FROM x1),
x2 AS (SELECT b.item_id, b.beam_id AS parent, t.k, list_append(b.tokens, t.nxt) AS tokens, b.score + t.logprob AS score
       FROM (SELECT * FROM b1 WHERE beam_id < 3) b JOIN top t ON b.tokens[len(b.tokens)] = t.ctx),
b2 AS (SELECT item_id, tokens, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, parent, k) - 1 AS beam_id FROM x2)
SELECT item_id, beam_id, array_to_string(tokens[len(tokens) - 1:], ' ') AS generated, round(score, 9) AS score
FROM b2 WHERE beam_id < 3
""".replace("{cp}", sql_cp("text")))
def beam_step(spark, d):
    cands = G.top_next(doc_table(spark, d), 3)
    beams = bench_prompts(spark, d).select("prompt_id", F.lit(0).alias("beam_id"), F.col("ids").alias("tokens"),
                                           F.lit(0.0).alias("score"))
    b1 = G.beam_prune(G.beam_extend(beams, cands, 1), 3)
    b2 = G.beam_prune(G.beam_extend(b1, cands, 1), 3)
    return b2.select(F.col("prompt_id").alias("item_id"), "beam_id",
                     _j(F.slice("tokens", -2, 2)).alias("generated"), F.round("score", 9).alias("score"))
