"""Named tables and splits (S-7).

``load_split(root, name)`` reads ``{root}/{name}`` as Parquet (a directory or
``{name}.parquet``) or JSON lines; no network, no download step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that yields fewer partitions than the cluster has cores.

    A Parquet split is a row group; a file written as one row group is one
    task however large its rows' per-row work is. For benchmarks on small files
    only: on a large cluster it would move whole texts.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def load_table(spark: SparkSession, root: str, name: str, columns: list[str] | None = None,
               spread_rows: bool = False) -> DataFrame:
    """One table of a data set folder; ``columns`` prunes the scan at the source."""
    path = f"{root.rstrip('/')}/{name if name.endswith('.parquet') else name + '.parquet'}"
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return spread(df) if spread_rows else df


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder, on whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def load_split(spark: SparkSession, root: str, split: str, fmt: str | None = None) -> DataFrame:
    """S-7: a named split (``train``, ``test``, ...) of a data set folder on any file system.

    ``{root}/{split}`` is a folder of ``fmt`` (default Parquet) files; else
    ``{split}.parquet``, ``{split}.jsonl`` or ``{split}.json`` is read.
    """
    base = f"{root.rstrip('/')}/{split}"
    for path, kind in ((base, fmt or ("json" if base.endswith((".json", ".jsonl")) else "parquet")),
                       (f"{base}.parquet", "parquet"), (f"{base}.jsonl", "json"), (f"{base}.json", "json")):
        if _exists(spark, path):
            return spark.read.json(path) if kind == "json" else spark.read.parquet(path)
    raise FileNotFoundError(f"no split {split!r} under {root}")
