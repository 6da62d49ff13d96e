"""JSON-lines readers and writers, line index and random access (S-1..S-6, S-8, S-9, A-10).

Reading a corpus is a narrow parse in the scan's own stage. Line numbers, byte
offsets and dataset-wide positions are made only where asked for, from
``(file, split, row id, byte length)``: a table with one row per file split
gives each split its first line and byte, and only that table is summed in
one place. Texts never move to be numbered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MESSAGE_TYPE = "array<struct<role:string,content:string>>"


def _raw_lines(spark: SparkSession, path, line_sep: str | None) -> DataFrame:
    """Lines with their file, split and a row id that grows in file order inside a split."""
    reader = spark.read.format("text")
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    return reader.load(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_row"),
        (F.octet_length("value") + F.lit(len((line_sep or "\n").encode("utf-8")))).cast("bigint").alias("nbytes"))


def _split_bases(raw: DataFrame) -> DataFrame:
    """One row per file split: its first row id and the lines and bytes before it, in its file and in
    the data set (files in name order)."""
    splits = raw.groupBy("file", "block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"), F.sum("nbytes").alias("_b"))
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_all = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    return splits.select("file", "block", "_first", before("_n", in_file).alias("_line"), before("_b", in_file).alias("_byte"),
                         before("_n", in_all).alias("_all_lines"), before("_b", in_all).alias("_all_bytes"))


def numbered_lines(spark: SparkSession, path, line_sep: str | None = None) -> DataFrame:
    """``(file, line_no, idx, value)``: the 1-based number in the file and the 0-based index in the data
    set (files in name order, then lines).

    ``line_sep=None`` splits on ``\\n``, ``\\r\\n`` and ``\\r`` (Python's text
    mode); ``'\\n'`` splits on LF only (binary mode, where ``\\r`` stays in the
    line). One join with the table of splits; no line is sorted.
    """
    raw = _raw_lines(spark, path, line_sep)
    nth = F.col("_row") - F.col("_first")
    return raw.join(_split_bases(raw), ["file", "block"]).select(
        "file", (F.col("_line") + nth + 1).alias("line_no"), (F.col("_all_lines") + nth).alias("idx"), "value")


def line_index(spark: SparkSession, path) -> DataFrame:
    """S-5: ``(idx, file, line_no, byte_offset, position, byte_len)`` of every line, split on ``\\n`` only.

    ``byte_offset`` counts in the file, ``position`` in the files one after the
    other. A blank line counts. Lengths, not texts, are summed: a window per file
    split, which has a bounded size. Assumes the separator after every line.
    """
    raw = _raw_lines(spark, path, "\n")
    slim = raw.drop("value")
    inside = Window.partitionBy("file", "block").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    local = slim.withColumn("_at", F.coalesce(F.sum("nbytes").over(inside), F.lit(0)))
    nth = F.col("_row") - F.col("_first")
    return local.join(_split_bases(raw), ["file", "block"]).select(
        (F.col("_all_lines") + nth).alias("idx"), "file", (F.col("_line") + nth + 1).alias("line_no"),
        (F.col("_byte") + F.col("_at")).alias("byte_offset"), (F.col("_all_bytes") + F.col("_at")).alias("position"),
        F.col("nbytes").alias("byte_len"))


def fetch_lines(spark: SparkSession, path, wanted: DataFrame, key: str = "idx") -> DataFrame:
    """S-6: random access: the lines whose data-set index is in ``wanted[key]``, once each.

    The semi-join runs on the numbered lines; an index beyond the data gives no row.
    """
    keys = wanted.select(F.col(key).cast("bigint").alias("idx")).where("idx is not null").distinct()
    return numbered_lines(spark, path, "\n").join(keys, "idx", "left_semi").select("idx", "file", "line_no", "value")


def write_line_index(spark: SparkSession, path, index_path: str, line_index_rows: DataFrame | None = None) -> DataFrame:
    """S-5, stored: the line index of ``path`` as Parquet in ranges of ``idx``, so that a lookup reads only the row
    groups that hold its lines. Returns the stored table."""
    rows = line_index(spark, path) if line_index_rows is None else line_index_rows
    (rows.select("idx", "file", "line_no", "byte_offset", "byte_len").repartitionByRange("idx").sortWithinPartitions("idx")
     .write.mode("overwrite").parquet(index_path))
    return spark.read.parquet(index_path)


def read_ranges(places: DataFrame, gap: int = 1 << 16) -> DataFrame:
    """(idx, file, line_no, value) for rows (idx, file, line_no, byte_offset, byte_len): each task opens the files of its
    rows and reads their byte ranges, ranges of one file up to ``gap`` bytes apart in one read. Files are
    reached by the file system that their address names (file, hdfs, s3, gs, abfs).

    A line's end mark is taken off; bytes that are no UTF-8 become U+FFFD. A range beyond the end of a file
    (the index is older than the file) stops the job.
    """
    def fetch(batches):
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            rows = sorted(zip(*(b.column(c).to_pylist() for c in ("file", "byte_offset", "byte_len", "idx", "line_no"))))
            out, at = [], 0
            while at < len(rows):
                name, begin, n, *_ = rows[at]
                to, end = at + 1, begin + n
                while to < len(rows) and rows[to][0] == name and rows[to][1] <= end + gap:
                    end = max(end, rows[to][1] + rows[to][2])
                    to += 1
                system, inner = fs.FileSystem.from_uri(name)
                with system.open_input_file(inner) as f:
                    if rows[to - 1][1] > f.size():
                        raise ValueError(f"line index and file differ: {name}")
                    data = f.read_at(min(end, f.size()) - begin, begin)
                for _, offset, size, idx, line_no in rows[at:to]:
                    line = data[offset - begin:offset - begin + size]
                    out.append((idx, name, line_no, line.removesuffix(b"\n").decode("utf-8", "replace")))
                at = to
            yield pa.RecordBatch.from_pydict({c: [r[i] for r in out] for i, c in enumerate(("idx", "file", "line_no", "value"))},
                                             pa.schema([("idx", pa.int64()), ("file", pa.string()), ("line_no", pa.int64()), ("value", pa.string())]))

    return (places.select("idx", "file", "line_no", "byte_offset", "byte_len")
            .mapInArrow(fetch, "idx long, file string, line_no long, value string"))


def seek_lines(index: DataFrame, wanted: DataFrame, key: str = "idx") -> DataFrame:
    """S-6 by offset: the lines whose data-set index is in ``wanted[key]``, once each, over a stored line index.

    Only the wanted lines' bytes are read. The smallest and largest wanted index go to the index's scan as
    filters; the wanted rows stay distributed, dealt by file and place so that a task reads on.
    """
    keys = wanted.select(F.col(key).cast("bigint").alias("idx")).where("idx is not null").distinct()
    ends = keys.agg(F.min("idx").alias("a"), F.max("idx").alias("b")).first()
    if ends["a"] is None:
        return read_ranges(index.limit(0))
    places = index.where(F.col("idx").between(ends["a"], ends["b"])).join(keys, "idx", "left_semi")
    return read_ranges(places.repartitionByRange("file", "byte_offset"))


def read_jsonl_text(spark: SparkSession, path, text_field: str = "text") -> tuple[DataFrame, DataFrame]:
    """S-1: lenient reader. Returns ``(good, rejects)``.

    ``good``: ``file, text`` for every object with a ``text`` key
    (``text: null`` is kept as null; a non-string value is kept as its JSON
    text); a narrow parse of one scan. ``rejects``: ``file, line_no, reason`` with
    reason ``bad_utf8`` (bytes that are no UTF-8, whatever the rest of the line),
    ``bad_json`` (a blank line too, and anything before or after the one
    value), ``missing_text`` (an object or array without the key) or
    ``not_object`` (a bare number, string, boolean or null, where the reference
    stops with an error). Duplicate keys keep the last value. Only rejects are numbered.
    """
    raw = _raw_lines(spark, path, None)
    reason, text = lenient_parse("value", text_field)
    good = raw.select("file", reason.alias("reason"), text.alias(text_field)).where("reason is null").select("file", text_field)
    bad = raw.select("file", "block", "_row", reason.alias("reason")).where("reason is not null")
    rejects = bad.join(_split_bases(raw), ["file", "block"]).select(
        "file", (F.col("_line") + F.col("_row") - F.col("_first") + 1).alias("line_no"), "reason")
    return good, rejects


def lenient_parse(value="value", text_field: str = "text"):
    """S-1's classification as two column expressions ``(reason, text)``.

    ``reason`` is null for a kept line. Stateless, so it also runs on a
    streaming ``readStream.text`` source (ST-1). The parsers stop after the
    first value they see, so a line is parsed as the only element of an array
    and as the only field of an object: whatever is not exactly one value spoils
    one of the two. Objects with a repeated key, which variants refuse, go
    through ``from_json`` in the same two wrappers.
    """
    value = F.col(value) if isinstance(value, str) else value
    listed, boxed = F.concat(F.lit("["), value, F.lit("]")), F.concat(F.lit('{"k":'), value, F.lit("}"))
    strict = {"allowSingleQuotes": "false"}
    v = F.try_parse_json(boxed)
    one = v.isNotNull() & F.try_parse_json(listed).isNotNull()
    kind = F.coalesce(F.schema_of_variant(F.variant_get(v, "$.k", "variant")), F.lit("VOID"))
    row = f"struct<{text_field}:string>"
    again = F.from_json(boxed, f"struct<k:{row}>", strict).getField("k")
    alone = F.coalesce(F.size(F.from_json(listed, f"array<{row}>", strict)) == 1, F.lit(False))
    fallback = F.when(alone & again.isNotNull(), again.getField(text_field))
    present = F.variant_get(v, f"$.k.{text_field}", "variant").isNotNull()
    # the text source hands on the bytes of a line as they are, so they can be checked here
    reason = (F.when(~F.is_valid_utf8(value), F.lit("bad_utf8"))
              .when(~one & fallback.isNull(), F.lit("bad_json"))
              .when(~one, F.lit(None))
              .when(kind.startswith("OBJECT") & present, F.lit(None))
              .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit("missing_text"))
              .otherwise(F.lit("not_object")))
    text = F.when(one, F.try_variant_get(v, f"$.k.{text_field}", "string")).otherwise(fallback)
    return reason, text


def load_report(rejects: DataFrame) -> DataFrame:
    """A-10: skipped lines by reason."""
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n_lines"))


def read_jsonl_strict(spark: SparkSession, path, schema: str) -> DataFrame:
    """S-2: the whole read fails on the first malformed line."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_messages_jsonl(spark: SparkSession, path) -> DataFrame:
    """S-3: one bare JSON array of ``{role, content}`` per line."""
    return spark.read.text(path).select(F.from_json("value", MESSAGE_TYPE).alias("messages"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None) -> None:
    """S-4: one JSON value per line, UTF-8, non-ASCII unescaped.

    A DataFrame with a single array column is written as bare arrays (the
    messages format); otherwise one object per row. ``mode='append'`` keeps
    earlier output, as the reference's append-mode files do.
    """
    fields = df.schema.fields
    w = None
    if len(fields) == 1 and fields[0].dataType.typeName() == "array":
        w = df.select(F.to_json(F.col(fields[0].name)).alias("value")).write.mode(mode)
        if compression:
            w = w.option("compression", compression)
        w.text(path)
        return
    w = df.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    w.json(path)


def read_bz2_jsonl(spark: SparkSession, path, text_field: str = "text") -> tuple[DataFrame, DataFrame]:
    """S-9: a bz2-compressed corpus reads through the same lenient reader (the codec is splittable)."""
    return read_jsonl_text(spark, path, text_field)


def resolve_prompts(spark: SparkSession, df: DataFrame, files: DataFrame | str | None = None, prompt: str = "prompt") -> DataFrame:
    """S-8: a prompt ``FILE:<path>`` becomes that file's whole content; others pass through.

    ``files``: a folder (or glob) that holds the prompt files, read as whole texts
    by Spark, or a table ``(path, content)``; by default the distinct paths
    themselves are read. Paths are matched without their ``file:`` scheme, other
    schemes as given. Each row is returned once; null prompts stay null. A
    path that is not there stops the job; so does an empty file in a folder, which
    Spark does not list (a path read by its own name then gives an empty text).
    """
    def plain(path):
        return F.regexp_replace(path, "^file:(?=/)/*", "/")

    is_file = F.coalesce(F.col(prompt).startswith("FILE:"), F.lit(False))
    wanted = df.where(is_file)
    by_name = files is None
    if by_name:
        # reading needs the paths by name: as many as there are prompt files
        names = [r[0] for r in wanted.select(F.substring(prompt, 6, 1 << 30)).distinct().collect()]
        if not names:
            return df
        files = names
    if not isinstance(files, DataFrame):
        # whole files by their plain paths; Spark itself stops at a name that is not there
        read = spark.read.format("binaryFile").load(files).select("path", F.decode("content", "UTF-8").alias("content"))
    else:
        read = files
    by_path = read.groupBy(plain(F.col("path")).alias("_path")).agg(F.first("content").alias("_content"), F.lit(True).alias("_there"))
    keyed = wanted.withColumn("_path", plain(F.substring(prompt, 6, 1 << 30)))
    got = keyed.join(by_path, "_path", "left")
    missing = F.lit("") if by_name else F.raise_error(F.concat(F.lit("prompt file not found: "), F.col("_path"))).cast("string")
    filled = got.withColumn(prompt, F.when(F.col("_there"), F.col("_content")).otherwise(missing)).select(*df.columns)
    return df.where(~is_file).unionByName(filled)
