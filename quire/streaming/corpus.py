"""Structured Streaming forms of the corpus stages (ST-1) and running reports (ST-2).

The stateless operators are column expressions and ``select``/``explode``
plans, so they run unchanged on a streaming DataFrame. Sinks and state live
under the cluster's checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import chat as C
from quire.functions import ids as I
from quire.operators.reshape import chunk_text
from quire.operators.rows import pretrain_rows, sft_rows
from quire.session import scratch_dir
from quire.sources.jsonl import lenient_parse
from quire.sources.tables import is_folder


def read_stream(spark: SparkSession, source_dir: str, schema, file_glob: str | None = None,
                fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream; ``file_glob`` picks one table out of a folder holding several, be it a file or a folder of files."""
    if file_glob and is_folder(spark, f"{source_dir.rstrip('/')}/{file_glob}"):
        # the glob would be held against the names of the files inside
        source_dir, file_glob = f"{source_dir.rstrip('/')}/{file_glob}", None
    r = spark.readStream.schema(schema).format(fmt)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(source_dir)


def run_append(stream: DataFrame, sink_dir: str, checkpoint_location: str, fmt: str = "parquet") -> None:
    """ST-1 sink: append to files, process what is there now (``availableNow``), then stop."""
    q = (stream.writeStream.format(fmt).outputMode("append")
         .option("path", sink_dir).option("checkpointLocation", checkpoint_location)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_chunks(spark: SparkSession, source_dir: str, schema, file_glob: str | None = None,
                  text: str = "text", size: int = 512) -> DataFrame:
    """ST-1: P-1 on a stream into an append-mode Parquet sink; returns the sink as a table."""
    src = read_stream(spark, source_dir, schema, file_glob)
    out = scratch_dir(spark, "stream-chunks")
    run_append(chunk_text(src, text, size), f"{out}/data", f"{out}/_checkpoint")
    return spark.read.parquet(f"{out}/data")


def running_masked_loss(spark: SparkSession, stream: DataFrame, loss: str, mask: str, step: str,
                        interval: int = 100) -> DataFrame:
    """ST-2: masked mean loss per logging interval, updated as steps arrive.

    Update mode through ``foreachBatch``: every micro-batch appends the groups
    it changed, tagged with the batch id, to Parquet; the latest row per group
    is the current value. Nothing is collected to the driver.
    """
    agg = (stream.groupBy(F.floor(F.col(step) / interval).cast("bigint").alias("log_step"))
           .agg(F.sum(F.col(loss) * F.col(mask)).alias("num"), F.sum(F.col(mask).cast("double")).alias("mask_sum")))
    out = scratch_dir(spark, "stream-loss")
    data = f"{out}/data"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(data)

    q = (agg.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", f"{out}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return latest_report(spark.read.parquet(data))


def latest_report(updates: DataFrame) -> DataFrame:
    """The current value of each group from an update log (largest batch id wins)."""
    last = F.max_by(F.struct("num", "mask_sum"), "batch_id")
    return (updates.groupBy("log_step").agg(last.alias("v"))
            .select("log_step", F.try_divide(F.col("v.num"), F.col("v.mask_sum")).alias("masked_mean"),
                    F.col("v.mask_sum").alias("mask_sum")))


def stream_pretrain_rows(spark: SparkSession, source_dir: str, schema, file_glob: str | None = None,
                         text: str = "text", keep=("doc_id", "lang"), encoder=I.codepoint_ids,
                         max_length: int = 512) -> DataFrame:
    """ST-1: P-1 -> R-3 -> encode -> B-ROW-1..4 on a stream into an append sink."""
    src = read_stream(spark, source_dir, schema, file_glob)
    rows = pretrain_rows(chunk_text(src, text), text, encoder, max_length, keep=[*keep, "chunk_id"])
    out = scratch_dir(spark, "stream-rows")
    run_append(rows, f"{out}/data", f"{out}/_checkpoint")
    return spark.read.parquet(f"{out}/data")


def stream_lenient_jsonl(spark: SparkSession, source_dir: str, text_field: str = "text") -> tuple[DataFrame, DataFrame]:
    """ST-1: S-1's lenient reader on a stream of JSON-lines files: kept texts and rejects, both appended.

    Line numbers need the whole file's order, so the stream form reports the
    file and the reason instead.
    """
    src = (spark.readStream.format("text").load(source_dir)
           .select("value", F.col("_metadata.file_path").alias("file")))
    reason, text = lenient_parse("value", text_field)
    staged = src.select("file", reason.alias("reason"), text.alias(text_field))
    out = scratch_dir(spark, "stream-jsonl")
    run_append(staged, f"{out}/data", f"{out}/_checkpoint")
    res = spark.read.parquet(f"{out}/data")
    return (res.filter(F.col("reason").isNull()).select("file", text_field),
            res.filter(F.col("reason").isNotNull()).select("file", "reason"))


def stream_sft_rows(spark: SparkSession, source_dir: str, system: str = C.DEFAULT_SYSTEM, encoder=I.codepoint_ids,
                    header_ids: list[int] | None = None, max_length: int = 512,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """ST-1: raw ``{"conversations": [{from, value}]}`` lines -> P-2 -> R-1 -> encode -> B-ROW-8 on a
    stream into an append sink; returns the sink as a table."""
    src = read_stream(spark, source_dir, f"conversations {C.TURN_TYPE}", fmt="json", max_files_per_trigger=max_files_per_trigger)
    rows = sft_rows(src.select(C.to_messages("conversations", system).alias("messages")), "messages", encoder, header_ids, max_length)
    out = scratch_dir(spark, "stream-sft")
    run_append(rows, f"{out}/data", f"{out}/_checkpoint")
    return spark.read.parquet(f"{out}/data")


def running_mean(spark: SparkSession, stream: DataFrame, value: str, group: str) -> DataFrame:
    """ST-2: running mean of ``value`` (a reward) and row count per group, updated as rows arrive.

    As ``running_masked_loss``: each micro-batch appends the groups it changed;
    the latest row per group is the current value.
    """
    agg = stream.groupBy(group).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    out = scratch_dir(spark, "stream-mean")
    data = f"{out}/data"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(data)

    q = (agg.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    last = spark.read.parquet(data).groupBy(group).agg(F.max_by(F.struct("total", "n"), "batch_id").alias("v"),
                                                       F.count(F.lit(1)).alias("n_updates"))
    return last.select(group, F.try_divide("v.total", "v.n").alias("mean"), "v.n", "n_updates")
