"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import checkpoint_dir, scratch_dir

SPACE = r"[\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark) -> None:
    """Make ``checkpoint()`` write to the folder the session names."""
    checkpoint_dir(spark)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from the written copy.

    For loops: a checkpointed DataFrame hands its plan's constraints on to what is made from it, and over
    many rounds of sums and joins those grow until the driver's memory is full; a table has none.
    """
    path = scratch_dir(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(text: Column | str) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Words are runs of anything but ASCII white space."""
    return F.array_remove(F.split(text, SPACE), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, whatever ``body`` does with it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def row_key(df: DataFrame) -> Column:
    """A hash of every column, nulls told apart, that names a row next to its id.

    Rows equal in every column share it, so a table keyed by (id, row_key) has to be
    made distinct before it is joined back.
    """
    parts = []
    for c, kind in df.dtypes:
        col = F.to_json(df[c]) if kind.startswith("map") else df[c]
        parts += [col.isNull(), col]
    return F.xxhash64(*parts)


def without(df: DataFrame, keys: list[str], gone: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``keys`` (nulls equal) are not among the rows of ``gone``, its columns in that order.

    ``gone`` is written first, so that the join goes by its true size: a small one is broadcast and the
    rows of ``df`` do not move; otherwise both sides are shuffled, with the same result.
    """
    return df.join(*_on(df, keys, stored(gone)), "left_anti")


def within(df: DataFrame, keys: list[str], these: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``keys`` are among the rows of ``these``, as in ``without``."""
    return df.join(*_on(df, keys, stored(these)), "left_semi")


def _on(df: DataFrame, keys: list[str], other: DataFrame) -> tuple[DataFrame, list[Column]]:
    return other, [df[k].eqNullSafe(other[c]) for k, c in zip(keys, other.columns)]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint): root is the smallest node reachable.

    Alternating large-star and small-star steps: each round links every node's
    larger neighbours, then its smaller ones, to the smallest node it sees, until
    only stars are left. All work is joins and grouped minima; each round is written
    to the checkpoint folder. Self links and repeated links are harmless; an empty
    table gives an empty result.
    """
    e = cut(edges.where(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    seen = mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.where(F.col("b") > F.col("a")).join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a")
                 .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
                 .select("x.a", "x.b").where(F.col("a") != F.col("b")).distinct())
        e = cut(small)
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(nodes.select("root", "root").distinct())
