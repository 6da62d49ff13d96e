"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

1. Turns are numbered over key ranges, so that a conversation of any length is spread over tasks.
2. A prefix is named by the exclusive-or of two 64-bit hashes of (place, turn) of each of its turns: a
   running aggregate in blocks of bounded length and over the blocks of a conversation. Equal
   names are one node; its parent's name is the same without the last turn.
3. Contraction alternates two steps, each a few joins over the nodes that still live. Rake: leaves give
   their totals to their parents and go. Compress: of the nodes with a single child, a random
   set without neighbours is spliced out, its sum carried by the child. The number of live nodes
   falls by a constant share a round, for bushy trees and for long chains alike.
4. Expansion takes the rounds backwards: a spliced node's total is its child's plus what was noted
   when it went.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut, stored
from quire.operators.split import with_global_index

#: turns of one block of the running hash
BLOCK = 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def numbered_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """(c, pos, digest, chars): every turn with its 0-based place in its conversation.

    Turns stand in order of ``turn``, null first; equal ones in order of the SHA-256 of role and
    text. A null role or text is empty. Rows without a conversation id belong to none and are left out.
    """
    role, text = (F.coalesce(df[c], F.lit("")) for c in (role_col, text_col))
    one = (df.where(df[conv_col].isNotNull())
           .select(df[conv_col].cast("long").alias("c"), df[turn_col].alias("turn"),
                   F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
                   F.length(text).cast("long").alias("chars")))
    at = cut(with_global_index(one, ["c", "turn", "digest"], "at").drop("turn"))
    first = at.groupBy("c").agg(F.min("at").alias("first"))
    return at.join(first.hint("merge"), "c").select("c", (F.col("at") - F.col("first")).alias("pos"), "digest", "chars")


def with_shared_heads(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): conversation c begins with the first h turns of conversation c - c % ``block`` (all of
    them if it has fewer, none if it is absent), then come its own turns after its first h; h = crc32(c) % ``most``.

    turns: (c, depth from 1, digest, chars); conversations: (c, n), n the number of turns, 0 included.
    A head has fewer than ``most`` turns and serves ``block`` conversations (twice as many around 0).
    """
    head = (turns.where((F.col("c") % block == 0) & (F.col("pos") < most - 1)).groupBy(F.col("c").alias("base"))
            .agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("head")))
    convs = (turns.groupBy("c").agg(F.count("*").alias("own"))
             .withColumn("h", (F.crc32(F.col("c").cast("string").cast("binary")) % most).cast("int"))
             .withColumn("base", F.col("c") - F.col("c") % block).join(head, "base", "left")
             .withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h")))
             .withColumn("n", F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    tails = (turns.join(convs.select("c", "h", F.size("head").alias("lead")), "c").where(F.col("pos") >= F.col("h"))
             .select("c", (F.col("pos") - F.col("h") + F.col("lead") + 1).cast("long").alias("depth"), "digest", "chars"))
    heads = (convs.select("c", F.posexplode("head").alias("i", "t"))
             .select("c", (F.col("i") + 1).cast("long").alias("depth"), "t.digest", "t.chars"))
    return tails.unionByName(heads), convs.select("c", F.col("n").cast("long").alias("n"))


def memberships(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(c, depth, k1, k2, p1, p2, chars, last): one row for every prefix of every conversation, the empty one included;
    (k1, k2) names the prefix, (p1, p2) the one before it (null for the empty one)."""
    z = turns.select("c", "depth", "chars", *[F.xxhash64(F.lit(s), "depth", "digest").alias(f"z{s}") for s in (1, 2)],
                     F.expr(f"(depth - 1) div {block}").alias("blk"))
    inside = Window.partitionBy("c", "blk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("c").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (z.groupBy("c", "blk").agg(F.bit_xor("z1").alias("x1"), F.bit_xor("z2").alias("x2"))
               .select("c", "blk", *[F.coalesce(F.bit_xor(f"x{s}").over(before), F.lit(0)).alias(f"o{s}") for s in (1, 2)])
               .where("blk > 0"))
    k = (z.select("*", *[F.bit_xor(f"z{s}").over(inside).alias(f"r{s}") for s in (1, 2)])
         .join(offsets, ["c", "blk"], "left")
         .select("c", "depth", "chars", "z1", "z2",
                 *[F.col(f"r{s}").bitwiseXOR(F.coalesce(f"o{s}", F.lit(0))).alias(f"k{s}") for s in (1, 2)])
         .join(convs, "c")
         .select("c", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("z1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("z2")).alias("p2"),
                 "chars", (F.col("depth") == F.col("n")).alias("last")))
    none = F.lit(None).cast("long")
    root = convs.select("c", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"),
                        none.alias("p1"), none.alias("p2"), F.lit(0).cast("long").alias("chars"), (F.col("n") == 0).alias("last"))
    return k.unionByName(root)


def listed_sha256(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by`` and ``sha256``: the hash of the group's values in numeric order, comma-joined.

    A task streams through its sorted rows and holds one hash state, so a group may be of any size.
    """
    def stream(batches):
        import pyarrow as pa
        state, name = None, None
        for b in batches:
            out = []
            cols = [c.to_pylist() for c in b.columns]
            for *key, v in zip(*cols):
                if key != name:
                    if name is not None:
                        out.append((*name, state.hexdigest()))
                    state, name = hashlib.sha256(str(v).encode()), key
                else:
                    state.update(b",%d" % v)
            yield pa.RecordBatch.from_pydict({c: [r[i] for r in out] for i, c in enumerate([*by, "sha256"])}, schema)
        if name is not None:
            yield pa.RecordBatch.from_pydict({c: [x] for c, x in zip([*by, "sha256"], [*name, state.hexdigest()])}, schema)

    import pyarrow as pa
    schema = pa.schema([(c, pa.int64()) for c in by] + [("sha256", pa.string())])
    return (df.select(*by, value).repartition(*by).sortWithinPartitions(*by, value)
            .mapInArrow(stream, ", ".join(f"{c} long" for c in by) + ", sha256 string"))


def subtree_totals(nodes: DataFrame, values: list[str], max_rounds: int = 200, stats: dict | None = None) -> DataFrame:
    """(id, values...): the sum of each value over every node's subtree, itself included.

    ``nodes``: id, parent (bigint, null for roots; every parent is a node) and the bigint ``values``.
    All joins of the rounds are merge joins: a broadcast would gather a table at the driver in each of them.
    """
    own, up = [f"a_{v}" for v in values], [f"u_{v}" for v in values]
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    live = stored(nodes.join(kids.hint("merge"), "id", "left")
               .select("id", "parent", F.coalesce("kids", F.lit(0)).alias("kids"), *[F.col(v).alias(a) for v, a in zip(values, own)],
                       *[F.lit(0).cast("long").alias(u) for u in up]))
    raked, spliced = [], []
    for turn in range(max_rounds):
        # rake: leaves give what they have to the parent
        raked.append(live.where("kids = 0").select("id", *[F.col(a).alias(v) for a, v in zip(own, values)]))
        given = (live.where("kids = 0 and parent is not null").groupBy(F.col("parent").alias("id"))
                 .agg(F.count("*").alias("gone"), *[F.sum(F.col(a) + F.col(u)).alias(f"g_{a}") for a, u in zip(own, up)]))
        left = F.col("kids") - F.coalesce("gone", F.lit(0))
        # a node left with one child draws a coin; on heads it goes, unless its child shows heads too
        rest = stored(live.where("kids > 0").join(given.hint("merge"), "id", "left")
                   .select("id", "parent", left.alias("kids"), *[(F.col(a) + F.coalesce(f"g_{a}", F.lit(0))).alias(a) for a in own], *up,
                           ((left == 1) & F.col("parent").isNotNull() & (F.xxhash64(F.lit(f"round {turn}"), "id") % 2 == 0)).alias("heads")))
        if rest.isEmpty():
            break
        above = rest.where("heads").select(F.col("id").alias("parent"), F.col("parent").alias("grand"), *[F.col(c).alias(f"s_{c}") for c in (*own, *up)])
        took = rest.where("not heads").join(above.hint("merge"), "parent").withColumnRenamed("parent", "gone")
        took = stored(took)
        spliced.append(took.select(F.col("gone").alias("id"), F.col("id").alias("child"),
                                   *[(F.col(f"s_{a}") + F.col(u)).alias(v) for a, u, v in zip(own, up, values)]))
        # both the child as it was and the node above it give way to the child as it is now
        old = took.select(F.explode(F.array("id", "gone")).alias("id"))
        live = stored(rest.join(old.hint("merge"), "id", "left_anti").select("id", "parent", "kids", *own, *up)
                   .unionByName(took.select("id", F.col("grand").alias("parent"), "kids", *own,
                                            *[(F.col(u) + F.col(f"s_{a}") + F.col(f"s_{u}")).alias(u) for a, u in zip(own, up)])))
    else:
        raise RuntimeError(f"tree not contracted after {max_rounds} rounds")
    if stats is not None:
        stats["rounds"] = turn + 1
    # expansion, last round first
    done = _union(raked)
    for record in reversed(spliced):
        if record.isEmpty():
            continue
        child = done.select(F.col("id").alias("child"), *[F.col(v).alias(f"t_{v}") for v in values])
        more = stored(record.join(child.hint("merge"), "child").select("id", *[(F.col(v) + F.col(f"t_{v}")).alias(v) for v in values]))
        done = done.unionByName(more)
    return done


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prefix_trie(members: DataFrame) -> DataFrame:
    """One row per node of the trie of ``members`` (see ``memberships``): conv_id (its smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256. No members, no nodes."""
    members = stored(members)
    nodes = stored(members.groupBy("k1", "k2").agg(F.min("depth").alias("depth"), F.min("c").alias("conv_id"), F.count("*").alias("n_convs"),
                                                F.max("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
                .withColumn("id", F.monotonically_increasing_id()))
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    tree = nodes.join(above.hint("merge"), ["p1", "p2"], "left")
    children = tree.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    tree = stored(tree.join(children.hint("merge"), "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    totals = subtree_totals(tree.select("id", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                                        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    ends = listed_sha256(members.where("last"), ["k1", "k2"], "c").withColumnRenamed("sha256", "ends_sha256")
    return (tree.join(totals.hint("merge"), "id").join(ends.hint("merge"), ["k1", "k2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")))


def conversation_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text", block: int = 100, most: int = 6) -> DataFrame:
    """The trie of the conversations of ``df`` after ``with_shared_heads``.

    Nulls, equal turns and rows without a conversation id: see ``numbered_turns``. Repeated rows are
    turns of their own. Extra columns are ignored, whatever their names; an empty table gives an empty
    result. Names of prefixes are 128 bits of hash.
    """
    turns = cut(numbered_turns(df, conv_col, turn_col, role_col, text_col))
    rebuilt, convs = with_shared_heads(turns, block, most)
    return prefix_trie(memberships(rebuilt, cut(convs)))
