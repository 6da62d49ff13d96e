"""The corpus pipeline: language ID, quality rules, SimHash near-dedup, secret scans, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written as
Parquet and reread as the next stage's ``docs``. All but the last return the columns of
``docs`` as they came. ``run`` applies the stages to ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.llm import stages

STAGES = [
    ("language_id", stages.language_id),
    ("quality_rules", stages.quality_rules),
    ("near_dedup", stages.near_dedup),
    ("secret_scan", stages.secret_scan),
    ("packing", stages.pack),
]

# SimHash needs XXH64 of word shingles and packing needs BPE, neither of which SQL has.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written to the shared folder of
    ``spark.checkpoint.dir`` and read back."""
    from quire.session import checkpoint_dir

    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
