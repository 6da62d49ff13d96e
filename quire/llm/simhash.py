"""SimHash near-duplicates by tiled exact comparison.

1. Every text becomes a 64-bit fingerprint (numpy inside Spark tasks); equal
   fingerprints collapse to one node, so exact copies are never compared.
2. Nodes are dealt to cells by the population counts of their blocks (32-bit
   halves, or finer for larger tables). Fingerprints within the radius lie in cells
   whose counts differ by the radius at most, so all other cell pairs are skipped.
3. Every cell is cut into tiles of bounded size. A task holds one tile and the
   rows of the cells it may match, and compares them with exclusive-or and
   bit counts, leaving out sub-tiles whose counts are too far apart.
4. A task returns a spanning forest of the links it found, never all pairs;
   connected components over those links give the groups.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import connected_components, cut

BLOCK_CHOICES = (1, 2, 4)


def text_fingerprint(text: str | None, ngram: int = 3) -> int:
    """The SimHash of one text as a signed 64-bit number.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are
    ``ngram`` words (or the whole shorter sequence), repeats included. No word
    (also null): zero.
    """
    import numpy as np
    import xxhash

    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    h64 = xxhash.xxh64_intdigest
    grams = [b" ".join(w)] if len(w) < ngram else map(b" ".join, zip(*(w[i:] for i in range(ngram))))
    n = max(1, len(w) - ngram + 1)
    ones = np.zeros(64, dtype=np.int64)
    hashes = (h64(g, 42) for g in grams)
    while True:  # bounded pieces: a very long text never becomes one large bit matrix
        part = np.fromiter(itertools.islice(hashes, 1 << 15), dtype="<u8")
        if not len(part):
            break
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", ngram: int = 3) -> Column:
    """Column of signed 64-bit SimHash fingerprints (``df[text_col]``; null as empty)."""
    @F.pandas_udf("long")
    def fp(s):
        import pandas as pd
        return pd.Series([text_fingerprint(x, ngram) for x in s], dtype="int64")
    return fp(F.coalesce(df[text_col], F.lit("")))


def _offsets(blocks: int, radius: int) -> list[tuple[int, ...]]:
    """Zero and one of each pair +d, -d of count differences within the radius."""
    out = []
    for d in itertools.product(range(-radius, radius + 1), repeat=blocks):
        if sum(map(abs, d)) <= radius and d >= tuple([0] * blocks):
            out.append(d)
    return out


def _forest(home, guest, radius: int, sub: int = 512, wide: int = 4096):
    """Links (a, b) of a spanning forest over the numbers of ``home`` and ``guest`` that lie
    within ``radius`` differing bits, home against guest."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([home, guest]), return_inverse=True)
    root = np.arange(len(nodes))
    hi, gi = at[:len(home)], at[len(home):]

    def boxes(x, size):
        """Rows in order of their quarter counts, cut up, with each piece's range of counts."""
        q = np.stack([np.bitwise_count((x >> np.uint64(16 * k)) & np.uint64(0xFFFF)) for k in range(4)]).astype(np.int16)
        order = np.lexsort(q[::-1])
        for i in range(0, len(x), size):
            o = order[i:i + size]
            yield o, q[:, o].min(axis=1), q[:, o].max(axis=1)

    tiles = list(boxes(guest, wide))
    for h, hlo, hhi in boxes(home, sub):
        for g, glo, ghi in tiles:
            if np.maximum(0, np.maximum(hlo - ghi, glo - hhi)).sum() > radius:
                continue
            near = np.bitwise_count(home[h][:, None] ^ guest[g][None, :]) <= radius
            i, j = np.nonzero(near)
            a, b = hi[h[i]], gi[g[j]]
            while True:
                ra, rb = root[a], root[b]
                differ = ra != rb
                if not differ.any():
                    break
                a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
                np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
                while True:
                    up = root[root]
                    if (up == root).all():
                        break
                    root = up
    linked = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[linked], nodes[root[linked]]


def near_links(nodes: DataFrame, radius: int = 3, tile_rows: int = 8192, guest_rows: int = 1 << 18,
               blocks: int | None = None) -> DataFrame:
    """Links (a, b) between different fingerprints (``nodes``: fp bigint, distinct) whose
    connected components are those of all pairs within ``radius`` bits.

    ``blocks`` (1, 2 or 4; default: by the number of nodes) is the number of blocks whose
    population counts name a cell; it changes the plan, never the result.
    """
    if blocks is None:
        n = nodes.count()
        # the fullest cell holds about 10 %, 1 % or 0.04 % of evenly spread fingerprints
        blocks = next((b for b, share in zip(BLOCK_CHOICES, (0.1, 0.01, 0.0004)) if n * share <= 4 * tile_rows), 4)
    width = 64 // blocks
    base = width + 2 * radius + 1  # room on both sides: a shifted code is never another cell's
    mask = F.lit((1 << width) - 1) if width < 64 else F.lit(-1)
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND(mask)) if width < 64 else F.bit_count("fp")
              for k in range(blocks)]

    def code(parts):
        out = 0
        for p in parts:
            out = out * base + p
        return out.cast("int") if isinstance(out, Column) else out

    rows = nodes.select("fp", *[c.alias(f"p{k}") for k, c in enumerate(counts)])
    rows = rows.select("fp", code([F.col(f"p{k}") + radius for k in range(blocks)]).alias("cell"))
    steps = F.explode(F.lit([code(d) for d in _offsets(blocks, radius)])).alias("step")
    shifted = (F.col("cell") + F.col("step")).cast("int").alias("cell")
    # cells (65, 1089 or 83,521 at most) with their numbers of tiles and of guest lots
    size = rows.groupBy("cell").count()
    guests = size.select("count", "cell", steps).select("count", shifted).groupBy("cell").agg(F.sum("count").alias("guests"))
    plan = (size.select("cell", F.ceil(F.col("count") / tile_rows).cast("int").alias("tiles"))
            .join(guests, "cell")
            .select("cell", "tiles", F.ceil(F.col("guests") / guest_rows).cast("int").alias("lots")))
    plan = F.broadcast(plan)  # at most (64 / blocks + 1) ** blocks rows
    pick = F.xxhash64("fp")
    home = (rows.join(plan, "cell")
            .select("fp", "cell", F.pmod(pick, F.col("tiles")).cast("int").alias("tile"),
                    F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(True).alias("home")))
    guest = (rows.select("fp", "cell", steps).select("fp", shifted)
             .join(plan, "cell")
             .select("fp", "cell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"),
                     F.pmod(pick, F.col("lots")).cast("int").alias("lot"), F.lit(False).alias("home")))

    def compare(table):
        import numpy as np
        import pyarrow as pa
        fp = table.column("fp").to_numpy().view(np.uint64)
        own = table.column("home").to_numpy().astype(bool)
        a, b = _forest(fp[own], fp[~own], radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return (home.union(guest).groupBy("cell", "tile", "lot")
            .applyInArrow(compare, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3,
                    radius: int = 3, keep: list[str] | None = None, **tiling) -> DataFrame:
    """One row per row of ``df``: the id, ``fingerprint`` (16 hex digits), ``component_id`` (the
    smallest id reachable over links of ``radius`` bits or fewer) and ``group_fp`` (a number that
    names the group).

    Null or wordless texts have fingerprint zero and link like any other. Rows
    repeated or sharing an id are all returned. A null id is returned as it is and
    never becomes a component id unless its group has no other. Extra columns are
    ignored, whatever their names; ``keep`` names columns to carry along (small ones).
    An empty table gives an empty result.
    """
    keep = keep or []
    sig = cut(df.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
                        fingerprints(df, text_col, ngram).alias("fp")))
    nodes = sig.groupBy("fp").agg(F.min("id").alias("first_id"))
    links = near_links(nodes.select("fp"), radius, **tiling)
    roots = connected_components(links)
    named = (nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
             .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    label = named.select("fp", "root").join(least, "root")
    return (sig.join(label, "fp")  # a hot fingerprint is a skewed key of this side alone, which AQE splits
            .select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
                    F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
                    F.col("root").alias("group_fp")))
