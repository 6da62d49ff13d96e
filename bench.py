"""Benchmark the headline operators; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs to completion through the ``noop`` sink (the whole plan
executes, nothing is collected). Times are wall-clock seconds; ``rates`` gives
rows per second for the row-producing stages.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    vocab = int(os.environ.get("BENCH_VOCAB", "300"))
    from quire.session import get_spark
    spark = get_spark(f"local[{cpus}]", app="quire-bench", shuffle_partitions=max(cpus * 2, 8),
                      extra={"spark.quire.spreadScans": "true"})
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-bench-"))

    from pyspark.sql import functions as F

    from quire.functions import ids as I
    from quire.operators import rows as B
    from quire.operators import split as S
    from quire.operators import tokenizer as TK
    from quire.plans import all_queries
    from quire.plans import corpus as PC
    from quire.plans import tokenizer as PT
    qs = all_queries()

    times: dict[str, float] = {}
    rows: dict[str, int] = {}

    def run(name: str, build) -> None:
        t0 = time.time()
        df = build()
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)

    # warm the JVM (codegen, class loading) on the smallest table so the first
    # timed query is not charged for it
    spark.read.parquet(f"{sf_dir}/region.parquet").write.format("noop").mode("overwrite").save()

    run("chunk_text", lambda: qs["chunk_text"](spark, sf_dir))
    rows["chunk_text"] = PC.doc_chunks(spark, sf_dir).count()
    run("pretrain_rows", lambda: qs["pretrain_rows"](spark, sf_dir))
    rows["pretrain_rows"] = rows["chunk_text"]
    run("pretrain_length_report", lambda: qs["pretrain_length_report"](spark, sf_dir))
    run("sft_rows", lambda: qs["sft_rows"](spark, sf_dir))
    rows["sft_rows"] = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
    run("word_counts", lambda: qs["word_counts"](spark, sf_dir))
    rows["pre_tokens"] = (TK.nfkc(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text"), "text")
                          .select(F.sum(F.size(TK.pretokenize("text")))).first()[0])

    t0 = time.time()
    model = PT.exact_model(spark, sf_dir, vocab)
    times["train_bpe"] = round(time.time() - t0, 3)

    def bpe_rows():
        ch = PC.doc_chunks(spark, sf_dir)
        return B.pretrain_rows(ch, "text", model.encoder(spark), 512, keep=["doc_id", "chunk_id"])
    run("bpe_pretrain_rows", bpe_rows)
    run("cross_entropy", lambda: qs["cross_entropy"](spark, sf_dir))
    run("topk_filter", lambda: qs["topk_filter"](spark, sf_dir))
    rows["logits"] = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    run("next_token_table", lambda: qs["next_token_table"](spark, sf_dir))
    run("assign_batches", lambda: S.assign_batches(
        S.shuffle_key(PC.doc_chunks(spark, sf_dir).withColumn("row_key", F.concat_ws(":", "doc_id", "chunk_id")),
                      "row_key", 42, 0), ["shuffle_key"], 64))
    for name in ("jsonl_roundtrip", "line_index", "fetch_lines", "preview", "bpe_decode"):
        run(name, lambda name=name: qs[name](spark, sf_dir))
    run("rewards", lambda: qs["rewards"](spark, sf_dir))
    run("exact_split", lambda: qs["exact_split"](spark, sf_dir))
    run("codepoint_context_tail", lambda: qs["context_tail"](spark, sf_dir))

    rates = {
        "chunks_per_sec": round(rows["chunk_text"] / max(times["chunk_text"], 1e-9), 1),
        "pretrain_rows_per_sec": round(rows["pretrain_rows"] / max(times["pretrain_rows"], 1e-9), 1),
        "bpe_pretrain_rows_per_sec": round(rows["pretrain_rows"] / max(times["bpe_pretrain_rows"], 1e-9), 1),
        "sft_rows_per_sec": round(rows["sft_rows"] / max(times["sft_rows"], 1e-9), 1),
        "pre_tokens_per_sec": round((rows["pre_tokens"] or 0) / max(times["word_counts"], 1e-9), 1),
        "logits_rows_per_sec": round(rows["logits"] / max(times["cross_entropy"], 1e-9), 1),
        "bpe_seconds_per_round": round(times["train_bpe"] / max(model.rounds, 1), 3),
        "bpe_rounds": model.rounds,
        "bpe_merges": len(model.merges),
    }
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rates": rates, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
