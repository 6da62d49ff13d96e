"""The stages of the corpus pipeline: each calls one operator and makes its decisions take effect.

All take (spark, docs, sf_dir). Every stage but the last returns exactly the columns of
``docs`` (extra ones included), in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import bpe, language, packing, quality, secrets, simhash
from quire.llm.common import cut, row_key, within, without
from quire.operators.split import unused


def language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the corpus's languages go."""
    return language.keep_documents(docs)


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy rejects go."""
    return quality.keep_documents(docs, "default-1")


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: that with the smallest id (ties: the smallest row
    hash; rows equal in every column collapse to one; a null id comes last)."""
    key = unused(docs, "__key")
    keyed = docs.withColumn(key, row_key(docs))
    groups = cut(simhash.near_duplicates(keyed, "doc_id", "text", ngram=3, radius=3, keep=[key])
                 .select(F.col("doc_id").alias("id"), F.col(key).alias("key"), "group_fp"))
    best = (groups.groupBy("group_fp")
            .agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("best"))
            .select("best.id", "best.key"))
    here = groups.select("id", "key")
    kept = without(keyed, ["doc_id", key], without(here, ["id", "key"], best))
    # rows equal in every column share id and key; only they have to meet
    again = cut(groups.groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1").select("id", "key"))
    if not again.isEmpty():
        equal = within(kept, ["doc_id", key], again).dropDuplicates(["doc_id", key])
        kept = without(kept, ["doc_id", key], again).unionByName(equal)
    return kept.select(*docs.columns)


def secret_scan(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; no document goes."""
    return secrets.scrub(docs)


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, then a place in a bucket and batch for every sequence."""
    return packing.pack(cut(bpe.count_tokens(docs)))
