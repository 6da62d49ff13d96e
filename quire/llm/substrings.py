"""Substring dedup by compaction of a De Bruijn graph of word k-mers.

A k-mer (k words in a row) is an edge from the node of its first k - 1 words to the node of its
last k - 1. A window that starts in documents of different ids is a repeated edge, and a long
repeated passage is a path of such edges whose inner nodes do not branch.

1. Documents are dealt to batches of bounded size, written once as a table bucketed by batch, so that
   every later step meets its texts without moving them.
2. Anchors: every window names the least hash of its shorter word runs. Windows that occur twice name
   the same one, so only windows whose anchor two documents hold can be repeated, and only they
   become edges. This keeps nothing back: it is the exact filter that saves shuffling all windows.
3. Edges are grouped by their first node and by their last one: the groups give each edge its
   source coordinate (the document with the smallest id that holds it, and the place there) and each
   node its branches.
4. Compaction: in every batch, edges that follow each other in the text and in the source
   coordinates, over a node that does not branch, form one run. Runs of the source itself are pieces of
   paths; pieces that meet at such a node are joined to paths by Spark joins.
5. Verification: a run found in another document is compared with the words at its source
   coordinates by a strong hash; equal requests are made once, however many copies ask.
6. The words that verified runs cover go.

Between batches and groups travel blobs: one row holds all the numbers a batch sends to a group.
All tasks hold one batch or one group at a time.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import connected_components, cut, ensure_checkpoint_dir

#: a batch ends at so many bytes of text or so many documents; a longer text is a batch of its own
BATCH_BYTES = 4 << 20
BATCH_DOCS = 4096
NO_ID = (1 << 63) - 1  # stands for a null id: larger than all others
_M = (1 << 64) - 1


# ------------------------------------------------------------------ words and hashes, in numpy
@functools.lru_cache(1)
def _byte_codes():
    """A random 64-bit number per byte value, from a fixed seed."""
    import numpy as np
    return np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x):
    import numpy as np
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int):
    import numpy as np
    p = np.full(n, 0x9E3779B97F4A7C15, dtype=np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def word_hashes(data, offsets, piece: int = 1 << 20):
    """(hash per word, document per word) of the UTF-8 bytes ``data`` of documents that begin and end at
    ``offsets``. Words are runs without 0x20 and 0x09-0x0D."""
    import numpy as np
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | border[1:-1]
    starts = np.flatnonzero(first)
    del first, border
    hashes, table = np.empty(len(starts), np.uint64), _byte_codes()
    # whole words of about ``piece`` bytes at a time
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + piece)))
        end = starts[to] if to < len(starts) else len(data)
        keep = np.flatnonzero(solid[starts[at]:end]) + starts[at]
        s = np.searchsorted(keep, starts[at:to])
        n = np.diff(np.append(s, len(keep)))
        place = np.arange(len(keep)) - np.repeat(s, n)
        hashes[at:to] = np.add.reduceat(table[data[keep]] * _powers(int(n.max()))[place], s)
        at = to
    return _mix(hashes), np.searchsorted(offsets, starts, "right") - 1


def grams(h, k: int):
    """Hash of every run of ``k`` words (regardless of documents)."""
    import numpy as np
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD1342543DE82EF95) + h[j:j + n]
    return _mix(out)


class Batch:
    """The documents of one batch, in order of their ids (null ids last), with word hashes."""

    def __init__(self, table, k: int):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        table = table.combine_chunks()
        slot = table.column("slot").to_numpy()
        ids = pc.fill_null(table.column("id"), NO_ID).to_numpy()
        order = np.lexsort((slot, ids))
        self.k, self.slot, self.ids = k, slot[order], ids[order]
        text = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.large_binary())
        text = (text.chunk(0) if isinstance(text, pa.ChunkedArray) and text.num_chunks else text).cast(pa.large_binary())
        self.texts = text.take(pa.array(order)) if len(order) else text
        self.batch = int(table.column("batch")[0].as_py()) if table.num_rows else 0

    @functools.cached_property
    def hashes(self):
        import numpy as np
        if not len(self.texts):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        o = np.frombuffer(self.texts.buffers()[1], np.int64)[self.texts.offset:self.texts.offset + len(self.texts) + 1]
        data = np.frombuffer(self.texts.buffers()[2] or b"", np.uint8)[o[0]:o[-1]]
        return word_hashes(data, o - o[0])

    @functools.cached_property
    def windows(self):
        """Index of the first word of every window, a document at a time."""
        import numpy as np
        _, doc = self.hashes
        n = max(0, len(doc) - self.k + 1)
        return np.flatnonzero(doc[:n] == doc[self.k - 1:])

    def words(self, i: int) -> list[bytes]:
        """Words of the ``i``-th document, as the hashes take them (bytes.split cuts at the same six)."""
        return self.texts[i].as_py().split()

    # anchors: 40 bits beside the group's number, enough to tell nearly all runs apart
    def anchors(self, groups: int):
        """(group, value, flag, number of the anchor per window): the batch's distinct anchors in order of
        group and value, those that two ids hold flagged."""
        import numpy as np
        h, doc = self.hashes
        w = self.windows
        short = max(1, self.k - 4)
        g = grams(h, short)
        least = g[w].copy() if len(w) else np.zeros(0, np.uint64)
        for j in range(1, self.k - short + 1):
            np.minimum(least, g[w + j], out=least)
        values, inverse = np.unique(least, return_inverse=True)
        group = ((values & np.uint64(0xFFFFFF)) % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((values, group))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at, ids = rank[inverse.reshape(-1)], self.ids[doc[w]]
        lo = np.full(len(order), np.iinfo(np.int64).max)
        hi = np.full(len(order), np.iinfo(np.int64).min)
        np.minimum.at(lo, at, ids)
        np.maximum.at(hi, at, ids)
        return group[order], values[order] >> np.uint64(24), lo != hi, at

    def edges(self, windows):
        """(first node, next word, last node, previous word) of the given windows."""
        import numpy as np
        h, _ = self.hashes
        node = grams(h, self.k - 1)
        low = np.uint64(0xFFFFFFFF)
        return node[windows], (h[windows + self.k - 1] & low).astype(np.uint32), node[windows + 1], (h[windows] & low).astype(np.uint32)

    def place(self, words_at):
        """(document, word in it) of indexes into the words of the batch."""
        import numpy as np
        _, doc = self.hashes
        d = doc[words_at]
        return d, words_at - np.searchsorted(doc, d)


def pack(*columns) -> bytes:
    """Numbers of equal count, stored byte plane by byte plane and compressed: high zero bytes cost nothing, neither in
    an exchange nor in a checkpoint, which Spark writes as it is. Eight bytes of length go before."""
    import numpy as np
    import pyarrow as pa
    planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes() for c in columns)
    return len(planes).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpack(blob: bytes, *kinds):
    import numpy as np
    import pyarrow as pa
    size = int.from_bytes(blob[:8], "little")
    blob = pa.decompress(blob[8:], size, "zstd", asbytes=True) if size else b""
    kinds = [np.dtype(x) for x in kinds]
    n, at, out = len(blob) // sum(x.itemsize for x in kinds), 0, []
    for x in kinds:
        planes = np.frombuffer(blob, np.uint8, n * x.itemsize, at).reshape(x.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(x))
        at += n * x.itemsize
    return out


def _slices(sorted_groups):
    """(group, from, to) of each run of equal numbers."""
    import numpy as np
    if not len(sorted_groups):
        return []
    cuts = np.flatnonzero(np.diff(sorted_groups)) + 1
    return list(zip(sorted_groups[np.r_[0, cuts]].tolist(), np.r_[0, cuts].tolist(), np.r_[cuts, len(sorted_groups)].tolist()))


def _table(rows, schema):
    import pyarrow as pa
    return pa.table({f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)}, schema)


def _starts(*keys):
    """Where a new combination of the sorted ``keys`` begins."""
    import numpy as np
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    return new


# ------------------------------------------------------------------ 1: batches
def deal(docs: DataFrame, id_col: str, text_col: str, batch_bytes: int = BATCH_BYTES, batch_docs: int = BATCH_DOCS) -> DataFrame:
    """(batch, slot, id, text as bytes): documents dealt to batches of bounded size as they are stored."""
    def number(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext
        batch, slot, size = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            text = pc.fill_null(b.column(1), b"")
            at, slots = [], []
            for n in pc.binary_length(text).to_pylist():
                if slot and (size + n > batch_bytes or slot >= batch_docs):
                    batch, slot, size = batch + 1, 0, 0
                at.append(batch)
                slots.append(slot)
                slot, size = slot + 1, size + n
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(slots, pa.int32()), b.column(0), text],
                                             ["batch", "slot", "id", "text"])

    return (docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("binary").alias("text"))
            .mapInArrow(number, "batch long, slot int, id long, text binary"))


def written(dealt: DataFrame) -> DataFrame:
    """The dealt documents as a table bucketed by batch in the shared folder: grouping by batch needs no exchange."""
    import uuid

    from quire.session import scratch_dir
    spark = dealt.sparkSession
    name = f"dealt_{uuid.uuid4().hex}"
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (dealt.write.format("parquet").option("path", scratch_dir(spark, name)).option("compression", "zstd")
     .bucketBy(n, "batch").saveAsTable(name))
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name goes, the files stay
    return out


# ------------------------------------------------------------------ 2: anchors
def shared_anchors(dealt: DataFrame, k: int, groups: int) -> DataFrame:
    """(batch, grp, bits): for each anchor that a batch sent to a group, whether two documents hold it."""
    def send(table):
        import numpy as np
        import pyarrow as pa
        b = Batch(table, k)
        group, value, flag, _ = b.anchors(groups)
        # a slice's values ascend: their differences are small numbers
        rows = [(g, b.batch, pack(np.diff(value[i:j], prepend=np.uint64(0))), np.packbits(flag[i:j]).tobytes()) for g, i, j in _slices(group)]
        return _table(rows, pa.schema([("grp", pa.int32()), ("batch", pa.int64()), ("v", pa.binary()), ("flag", pa.binary())]))

    def meet(table):
        import numpy as np
        import pyarrow as pa
        values = [np.cumsum(unpack(v, "<u8")[0], dtype=np.uint64) for v in table.column("v").to_pylist()]
        sizes, value = [len(v) for v in values], np.concatenate(values)
        flag = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n) for f, n in zip(table.column("flag").to_pylist(), sizes)])
        order = np.argsort(value, kind="stable")
        new = _starts(value[order])
        group = np.cumsum(new) - 1
        shared = np.bincount(group, minlength=1) + np.bincount(group, weights=flag[order], minlength=1) > 1
        back = np.empty(len(order), bool)
        back[order] = shared[group]
        ends = np.cumsum(sizes)
        rows = [(b, g, np.packbits(back[e - n:e]).tobytes())
                for b, g, n, e in zip(table.column("batch").to_pylist(), table.column("grp").to_pylist(), sizes, ends)]
        return _table(rows, pa.schema([("batch", pa.int64()), ("grp", pa.int32()), ("bits", pa.binary())]))

    sent = dealt.groupBy("batch").applyInArrow(send, "grp int, batch long, v binary, flag binary")
    return sent.groupBy("grp").applyInArrow(meet, "batch long, grp int, bits binary")


def _shared_windows(b: Batch, replies, groups: int):
    """Indexes of the first words of the windows whose anchor is shared."""
    import numpy as np
    group, _, _, at = b.anchors(groups)
    known = dict(zip(replies.column("grp").to_pylist(), replies.column("bits").to_pylist()))
    bits = np.zeros(len(group), bool)
    for g, i, j in _slices(group):
        bits[i:j] = np.unpackbits(np.frombuffer(known[g], np.uint8), count=j - i).astype(bool)
    return b.windows[bits[at]] if len(at) else b.windows


# ------------------------------------------------------------------ 3: edges and nodes
_EDGE = ("<u8", "<u4", "<i8", "<i4", "<i4", "u1")  # first node, next word, least id, its slot, its word, two ids
_BACK = ("<u8", "<u4")  # last node, previous word
_FOUND = ("<i8", "<i8", "<i4", "<i4", "u1")  # source id, batch, slot, word; bit 0: repeated, bit 1: first node branches


def _own_edges(b: Batch, windows, groups: int):
    """The batch's distinct edges by first node: (group, node, next, least id, slot, word, two ids, number per window)."""
    import numpy as np
    node, nxt, _, _ = b.edges(windows)
    doc, word = b.place(windows)
    order = np.lexsort((word, doc, nxt, node, (node % np.uint64(groups)).astype(np.int64)))
    node, nxt, doc, word = node[order], nxt[order], doc[order], word[order]
    new = _starts(node, nxt)
    at = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(node)) - 1
    number = np.empty(len(order), np.int64)
    number[order] = at
    two = (b.ids[doc[first]] != b.ids[doc[last]]).astype(np.uint8) if len(first) else np.zeros(0, np.uint8)
    node, nxt, doc, word = node[first], nxt[first], doc[first], word[first]
    return ((node % np.uint64(groups)).astype(np.int64), node, nxt, b.ids[doc].astype(np.int64), b.slot[doc].astype(np.int32),
            word.astype(np.int32), two, number)


def _own_backs(b: Batch, windows, groups: int):
    """The batch's distinct edges by last node: (group, node, previous word, number per window)."""
    import numpy as np
    _, _, node, prv = b.edges(windows)
    order = np.lexsort((prv, node, (node % np.uint64(groups)).astype(np.int64)))
    new = _starts(node[order], prv[order])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    return (node[first] % np.uint64(groups)).astype(np.int64), node[first], prv[first], number


def edge_sources(dealt: DataFrame, anchors: DataFrame, k: int, groups: int) -> DataFrame:
    """(batch, side, grp, blob): source coordinates and branches for the edges a batch sent to a group."""
    def send(texts, replies):
        import pyarrow as pa
        b = Batch(texts, k)
        w = _shared_windows(b, replies, groups)
        group, *cols, _ = _own_edges(b, w, groups)
        rows = [(0, g, b.batch, pack(*[c[i:j] for c in cols])) for g, i, j in _slices(group)]
        group, node, prv, _ = _own_backs(b, w, groups)
        rows += [(1, g, b.batch, pack(node[i:j], prv[i:j])) for g, i, j in _slices(group)]
        return _table(rows, pa.schema([("side", pa.int32()), ("grp", pa.int32()), ("batch", pa.int64()), ("blob", pa.binary())]))

    def meet(table):
        import numpy as np
        import pyarrow as pa
        side, grp = table.column("side")[0].as_py(), table.column("grp")[0].as_py()
        owners = table.column("batch").to_pylist()
        parts = [unpack(x, *(_BACK if side else _EDGE)) for x in table.column("blob").to_pylist()]
        sizes = [len(p[0]) for p in parts]
        cols = [np.concatenate(c) for c in zip(*parts)]
        owner = np.repeat(np.array(owners, np.int64), sizes)
        if side:
            order = np.lexsort((cols[1], cols[0]))
        else:
            order = np.lexsort((cols[3], owner, cols[2], cols[1], cols[0]))
        cols, owner = [c[order] for c in cols], owner[order]
        new = _starts(cols[0], cols[1])
        first, edge = np.flatnonzero(new), np.cumsum(new) - 1
        # branches of a node: its distinct edges
        at_node = np.cumsum(_starts(cols[0])) - 1
        branches = np.bincount(at_node[first]) > 1
        if side:
            out = [branches[at_node].astype(np.uint8)]
        else:
            last = np.append(first[1:], len(edge)) - 1
            two = (cols[2][first] != cols[2][last]) | (np.bincount(edge, weights=cols[5]) > 0)
            f = first[edge]
            out = [cols[2][f], owner[f], cols[3][f], cols[4][f], (two[edge] + 2 * branches[at_node]).astype(np.uint8)]
        back = [np.empty_like(c) for c in out]
        for c, v in zip(back, out):
            c[order] = v
        ends = np.cumsum(sizes)
        rows = [(b, side, grp, pack(*[c[e - n:e] for c in back])) for b, n, e in zip(owners, sizes, ends)]
        return _table(rows, pa.schema([("batch", pa.int64()), ("side", pa.int32()), ("grp", pa.int32()), ("blob", pa.binary())]))

    sent = dealt.groupBy("batch").cogroup(anchors.groupBy("batch")).applyInArrow(send, "side int, grp int, batch long, blob binary")
    return sent.groupBy("side", "grp").applyInArrow(meet, "batch long, side int, grp int, blob binary")


# ------------------------------------------------------------------ 4: runs and paths
_RUN = ("kind int, batch long, slot int, start int, n int, s_batch long, s_slot int, s_start int, "
        "head long, tail long, head_open boolean, tail_open boolean, digest binary")


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def runs(dealt: DataFrame, anchors: DataFrame, sources: DataFrame, k: int, groups: int) -> DataFrame:
    """Runs of repeated edges over nodes that do not branch, consecutive in the text and at the source.

    kind 0: a piece of a path, in its source document; kind 1: the same words in a document of a
    larger id, with the source coordinates and a hash of its words. ``n`` counts words.
    """
    def find(key, texts, replies):
        import numpy as np
        import pyarrow as pa
        schema = pa.schema([("kind", pa.int32()), ("batch", pa.int64()), ("slot", pa.int32()), ("start", pa.int32()), ("n", pa.int32()),
                            ("s_batch", pa.int64()), ("s_slot", pa.int32()), ("s_start", pa.int32()), ("head", pa.int64()),
                            ("tail", pa.int64()), ("head_open", pa.bool_()), ("tail_open", pa.bool_()), ("digest", pa.binary())])
        b = Batch(texts, k)
        anchor = replies.filter(pa.compute.equal(replies.column("side"), -1))
        w = _shared_windows(b, anchor, groups)
        if not len(w):
            return schema.empty_table()
        known = {(s, g): x for s, g, x in zip(*(replies.column(c).to_pylist() for c in ("side", "grp", "bits"))) if s >= 0}
        group, *_, number = _own_edges(b, w, groups)
        parts = [unpack(known[0, g], *_FOUND) for g, _, _ in _slices(group)]
        s_id, s_batch, s_slot, s_word, bits = (np.concatenate(c)[number] for c in zip(*parts))
        group, _, _, number = _own_backs(b, w, groups)
        in_branch = np.concatenate([unpack(known[1, g], "u1")[0] for g, _, _ in _slices(group)])[number].astype(bool)
        out_branch = (bits & 2).astype(bool)
        doc, word = b.place(w)
        ids, slot = b.ids[doc].astype(np.int64), b.slot[doc].astype(np.int64)
        own = (s_batch == b.batch) & (s_slot == slot) & (s_word == word)
        use = (bits & 1).astype(bool) & (own | (s_id < ids))
        w, doc, word, own, s_batch, s_slot, s_word, out_branch, in_branch, slot = (
            x[use] for x in (w, doc, word, own, s_batch, s_slot, s_word, out_branch, in_branch, slot))
        if not len(w):
            return schema.empty_table()
        joined = np.zeros(len(w), bool)  # with the window before it
        joined[1:] = ((w[1:] == w[:-1] + 1) & (doc[1:] == doc[:-1]) & (s_batch[1:] == s_batch[:-1]) & (s_slot[1:] == s_slot[:-1])
                      & (s_word[1:] == s_word[:-1] + 1) & (own[1:] == own[:-1]) & ~out_branch[1:] & ~in_branch[:-1])
        first = np.flatnonzero(~joined)
        last = np.append(first[1:], len(w)) - 1
        n = (last - first + k).astype(np.int32)
        node, _, to, _ = b.edges(w)
        digests, of, held = [None] * len(first), -1, []
        for i, f in enumerate(first.tolist()):
            if not own[f]:
                if doc[f] != of:
                    of, held = doc[f], b.words(int(doc[f]))
                digests[i] = _digest(held[word[f]:word[f] + n[i]])
        arrays = [(~own[first]).astype(np.int32), np.full(len(first), b.batch), slot[first].astype(np.int32), word[first].astype(np.int32), n,
                  s_batch[first], s_slot[first], s_word[first], node[first].view(np.int64), to[last].view(np.int64),
                  ~out_branch[first], ~in_branch[last]]
        return pa.table([pa.array(a, f.type) for a, f in zip(arrays, schema)] + [pa.array(digests, pa.binary())], schema)

    mail = (anchors.select("batch", F.lit(-1).alias("side"), "grp", "bits")
            .unionByName(sources.select("batch", "side", "grp", F.col("blob").alias("bits"))))
    return dealt.groupBy("batch").cogroup(mail.groupBy("batch")).applyInArrow(find, _RUN)


def paths(found: DataFrame, k: int) -> DataFrame:
    """(batch, slot, start, n, path, path_words) of every piece: pieces that meet at a node which does not
    branch are joined, round by round, to one path, named by a piece in it."""
    pieces = (found.where("kind = 0").dropDuplicates(["batch", "slot", "start"])
              .withColumn("piece", F.xxhash64("batch", "slot", "start")))
    ends = pieces.where("tail_open").select(F.col("tail").alias("node"), F.col("piece").alias("a"))
    begins = pieces.where("head_open").select(F.col("head").alias("node"), F.col("piece").alias("b"))
    roots = connected_components(ends.join(begins, "node").select("a", "b"))
    named = (pieces.join(roots.withColumnRenamed("node", "piece"), "piece", "left")
             .select("batch", "slot", "start", "n", F.coalesce("root", "piece").alias("path")))
    size = named.groupBy("path").agg((F.sum(F.col("n") - (k - 1)) + (k - 1)).alias("path_words"))
    return named.join(size, "path")


# ------------------------------------------------------------------ 5: verification at the source
def resolved(dealt: DataFrame, found: DataFrame, piece_paths: DataFrame, k: int) -> DataFrame:
    """(s_batch, s_slot, s_start, n, digest, path, path_words) of the distinct requests whose words stand at their source."""
    def check(texts, mail):
        import numpy as np
        import pyarrow as pa
        schema = pa.schema([("s_batch", pa.int64()), ("s_slot", pa.int32()), ("s_start", pa.int32()), ("n", pa.int32()), ("digest", pa.binary()),
                            ("path", pa.int64()), ("path_words", pa.int64())])
        b, rows = Batch(texts, k), []
        mail = mail.sort_by([("slot", "ascending"), ("start", "ascending")])
        slot, start, n, digest, path, size = (mail.column(c).to_pylist() for c in ("slot", "start", "n", "digest", "path", "path_words"))
        at = {int(s): i for i, s in enumerate(b.slot)}
        of, held, piece = None, [], None
        for i in np.lexsort(([d is not None for d in digest], start, slot)).tolist() if slot else ():
            if slot[i] != of:
                of, held, piece = slot[i], b.words(at[slot[i]]), None
            if digest[i] is None:
                piece = (start[i], start[i] + n[i], path[i], size[i])
            elif _digest(held[start[i]:start[i] + n[i]]) == digest[i]:
                inside = piece and piece[0] <= start[i] and start[i] + n[i] <= piece[1]
                rows.append((b.batch, of, start[i], n[i], digest[i], piece[2] if inside else None, piece[3] if inside else None))
        return _table(rows, schema)

    asked = (found.where("kind = 1").select("s_batch", "s_slot", "s_start", "n", "digest").distinct()
             .select(F.col("s_batch").alias("batch"), F.col("s_slot").alias("slot"), F.col("s_start").alias("start"), "n", "digest",
                     F.lit(None).cast("long").alias("path"), F.lit(None).cast("long").alias("path_words")))
    mail = asked.unionByName(piece_paths.select("batch", "slot", "start", "n", F.lit(None).cast("binary").alias("digest"), "path",
                                                F.col("path_words").cast("long").alias("path_words")))
    return dealt.groupBy("batch").cogroup(mail.groupBy("batch")).applyInArrow(
        check, "s_batch long, s_slot int, s_start int, n int, digest binary, path long, path_words long")


def _spans(dealt: DataFrame, k: int, groups: int | None) -> DataFrame:
    groups = groups or 2 * max(1, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    anchors = cut(shared_anchors(dealt, k, groups))
    sources = cut(edge_sources(dealt, anchors, k, groups))
    found = cut(runs(dealt, anchors, sources, k, groups))
    good = resolved(dealt, found, paths(found, k), k)
    # copies ask alike: a hot request is a skewed key of the runs alone, which AQE splits
    return (found.where("kind = 1").join(good, ["s_batch", "s_slot", "s_start", "n", "digest"])
            .select("batch", "slot", "start", "n", "s_batch", "s_slot", "s_start", "path", "path_words"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, groups: int | None = None,
                   **batches) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): the dealt documents (batch, slot, id, text as bytes) and every verified span of ``k``
    words or more that a document shares with its source, the document of the smallest id that holds it:
    batch, slot, start, n (words), the same of the source, and the path it lies on with its length."""
    ensure_checkpoint_dir(docs.sparkSession)
    dealt = written(deal(docs, id_col, text_col, **batches))
    return dealt, _spans(dealt, k, groups)


# ------------------------------------------------------------------ 6: removal
def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, groups: int | None = None,
                   **batches) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_words``, ``n_removed``, ``kept`` (the words that stay, joined by one
    space), ``n_spans`` (verified runs) and ``longest_path`` (words of the longest path that a run lies on, 0 for none).

    A word goes if a window of ``k`` words covers it whose words also start in a row of a smaller id. Null texts have
    no words. A null id is larger than every other, so such a row gives way to all others but not to another null. Rows
    of one id do not take from each other. Repeated rows, ties and extra columns of any name are harmless; an empty table
    gives an empty result. Ids are whole numbers.
    """
    dealt, spans = repeated_spans(docs, id_col, text_col, k, groups, **batches)

    def drop(texts, mail):
        import numpy as np
        import pyarrow as pa
        b = Batch(texts, k)
        slot, start, n, path = (mail.column(c).to_pylist() for c in ("slot", "start", "n", "path_words"))
        by_slot: dict[int, list] = {}
        for s, *span in zip(slot, start, n, path):
            by_slot.setdefault(s, []).append(span)
        rows = []
        for i in range(len(b.ids)):
            words, mine = b.words(i), by_slot.get(int(b.slot[i]), ())
            stay = np.ones(len(words), bool)
            for s, m, _ in mine:
                stay[s:s + m] = False
            kept = words if not mine else [w for w, y in zip(words, stay.tolist()) if y]
            rows.append((None if b.ids[i] == NO_ID else int(b.ids[i]), len(words), len(words) - len(kept), b" ".join(kept), len(mine),
                         max((p or 0 for *_, p in mine), default=0)))
        return _table(rows, pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()),
                                       ("n_spans", pa.int64()), ("longest_path", pa.int64())]))

    done = dealt.groupBy("batch").cogroup(spans.groupBy("batch")).applyInArrow(
        drop, "id long, n_words long, n_removed long, kept binary, n_spans long, longest_path long")
    return done.select(F.col("id").alias(id_col), "n_words", "n_removed", F.decode("kept", "UTF-8").alias("kept"), "n_spans", "longest_path")
