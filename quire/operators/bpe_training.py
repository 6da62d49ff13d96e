"""T-5: training of a byte-level BPE vocabulary over the distinct-word table, by maintained counts.

State, all of it distributed: the words in blocks, a row each (``x``: the symbols of some thousand words, every
one higher by one, with a 0 after each word; ``c``: the words' counts in ``w`` bytes each), and the counts of all pairs of
neighbouring symbols. A block reports what it gained and lost by "grams" (two symbols at the end of a word, three
elsewhere, so a pair's count is the sum over the grams that begin with it; ``gram_key`` makes one number of a gram).

A round lists the best pairs and cuts the words into stretches in which every neighbouring pair is listed
(``stretches``). Equal stretches are added up across the corpus, and the driver merges them one pair after the
other (``plan_stretches``), down to the last listed pair in the order of the one-at-a-time trainer: count, then
left id, then right id. That is exact. A pair across a border of a stretch, whatever its symbols were merged from, is
never more frequent than the unlisted pair that stood there, so it comes later than all listed ones; and
an occurrence of any other pair lies inside a stretch, where all are counted. Two to four times as many pairs are listed
from round to round while the distinct stretches have far fewer than ``STRETCHES`` symbols, and half as many where
they have more; so the driver's share is bounded whatever the corpus, and the words stay where they are. Then
the blocks' changed words are rewritten in one narrow pass, and only what these words lost and gained is added to
the counts. The corpus and the unchanged words are never counted again.

``exact=False`` merges all listed pairs that share no symbol (``plan_batch``, which can also decide
exactly from pairs and triples alone, by lower and upper bounds of their counts, some twenty merges a round).

With ``log_dir`` every ``checkpoint_every`` rounds the words, then the merges so far, are written to
that folder, and a job that is started again goes on from there.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import checkpoint_dir

_FIRST = 0x100  # symbol 0 is this character; the surrogates are left out


def symbol_char(i: int) -> str:
    """The character that stands for symbol ``i``; characters are ordered as the ids are."""
    c = _FIRST + i
    return chr(c if c < 0xD800 else c + 0x800)


def symbol_id(ch: str) -> int:
    c = ord(ch)
    return (c if c < 0xD800 else c - 0x800) - _FIRST


_BITS = 21  # of a symbol in a gram's key
_MASK = (1 << _BITS) - 1
STRETCHES = 2_000_000  # symbols of distinct stretches that the driver merges in a round, some 60 bytes each
LISTED = 1 << 16  # pairs listed in a round
_BLOCK = "x binary, c binary, w int, g array<long>, d array<long>"


def gram_key(a, b, c):
    """Three symbols, each higher by one, as one number in their order; ``c`` is 0 for a gram at a word's end."""
    return (a << 2 * _BITS) | (b << _BITS) | c


def gram_symbols(g: int) -> tuple[int, int, int]:
    return (g >> 2 * _BITS) - 1, (g >> _BITS & _MASK) - 1, (g & _MASK) - 1


def _grams(x, cnt):
    """(key, count) of every gram of a block's words."""
    import numpy as np
    first = np.flatnonzero((x[:-1] != 0) & (x[1:] != 0))  # the block ends in 0, so first + 2 is inside
    a, b, c = (x[first + i].astype(np.int64) for i in range(3))
    return gram_key(a, b, c), cnt[np.searchsorted(np.flatnonzero(x == 0), first)]


def _gained(*parts):
    """The summed counts of the grams in (key, count) pairs, without those that come to 0."""
    import numpy as np
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at.reshape(-1), np.concatenate([c for _, c in parts]))
    return keys[total != 0], total[total != 0]


def _grouped(keys, at):
    """(key, its places) of places with their keys."""
    import numpy as np
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    cuts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[cuts].tolist(), np.split(at, cuts[1:]) if len(cuts) else [], order, cuts


class Places:
    """Words as chains of symbols (every one higher by one, a 0 after each word), with the places of their pairs.

    A merge visits the places of its pair alone. ``wanted``: keys of the pairs to keep places of; of pairs that
    come up by a merge those in ``wanted``, or all with a count of ``least`` or more. Keys are ``gram_key(0, a, b)``.
    """

    def __init__(self, x, weights=None, wanted=None, least: int = 0):
        import numpy as np
        self.x = np.append(x, 0).astype(np.int64)
        self.after = np.arange(1, len(self.x) + 1, dtype=np.int32)
        self.before = np.arange(-1, len(self.x) - 1, dtype=np.int32)
        self.weights, self.wanted, self.least = weights, wanted, least
        at = np.flatnonzero((self.x[:-1] != 0) & (self.x[1:] != 0))
        keys = self._keys(at)
        if wanted is not None:
            kept = np.isin(keys, wanted)
            keys, at = keys[kept], at[kept]
            self.wanted = set(wanted.tolist())
        names, places, order, cuts = _grouped(keys, at.astype(np.int32))
        self.places = dict(zip(names, places))
        self.counts = dict(zip(names, np.add.reduceat(weights[at[order]], cuts).tolist())) if weights is not None and len(cuts) else {}

    def _keys(self, at):
        return (self.x[at] << _BITS) | self.x[self.after[at]]

    def _add(self, at, sign: int):
        """Add the pairs that begin at some places to the counts; for new ones returns (key, places)."""
        import numpy as np
        keys = self._keys(at)
        if sign < 0:
            order = np.argsort(keys)
            keys, at = keys[order], at[order]
            cuts = np.flatnonzero(np.diff(keys, prepend=-1))
            counts = self.counts
            for k, c in zip(keys[cuts].tolist(), np.add.reduceat(self.weights[at], cuts).tolist()):
                if k in counts:
                    counts[k] -= c
                    yield k
            return
        names, places, order, cuts = _grouped(keys, at)
        totals = np.add.reduceat(self.weights[at[order]], cuts).tolist() if self.weights is not None else [None] * len(names)
        for k, p, c in zip(names, places, totals):
            if k in self.wanted if self.wanted is not None else c >= self.least:
                self.places[k] = np.concatenate((self.places[k], p)) if k in self.places else p
                self.counts[k] = self.counts.get(k, 0) + c if c is not None else 0
                yield k

    def merge(self, a: int, b: int, n: int) -> list[int]:
        """Merge a pair (ids as in ``x``, higher by one) wherever it stands; the keys of changed counts."""
        import numpy as np
        key = gram_key(0, a, b)
        at = self.places.pop(key, None)
        self.counts.pop(key, None)
        if at is None:
            return []
        at = np.sort(at[(self.x[at] == a) & (self.x[self.after[at]] == b)])
        if a == b and len(at):  # of overlapping places every second one, from the first of each run
            starts = np.flatnonzero(np.append(True, self.after[at[:-1]] != at[1:]))
            at = at[(np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))) % 2 == 0]
        if not len(at):
            return []
        gone, left = self.after[at], self.before[at]
        left = np.where((left >= 0) & (self.x[left] != 0), left, -1)
        changed = []
        if self.weights is not None:
            own = np.append(True, left[1:] != gone[:-1])  # between two merged places a pair stands once
            old = np.concatenate((left[(left >= 0) & own], gone[self.x[self.after[gone]] != 0]))
            changed += self._add(old, -1) if len(old) else []
        self.x[at], self.x[gone] = n, -1
        right = self.after[gone]
        self.after[at], self.before[right] = right, at
        left = self.before[at]
        follows = np.append(False, left[1:] == at[:-1])
        new = np.concatenate((left[(left >= 0) & (self.x[left] > 0) & ~follows], at[self.x[right] != 0]))
        changed += self._add(new, 1) if len(new) else []
        return changed

    def symbols(self):
        return self.x[:-1][self.x[:-1] >= 0]


def merge_symbols(x, batch: list[tuple[int, int, int]]):
    """A block's symbols rewritten with the merges, one after the other, each from left to right in every word."""
    import numpy as np
    wanted = np.array([gram_key(0, a + 1, b + 1) for a, b, _ in batch], np.int64)
    words = Places(x, wanted=wanted)
    for a, b, n in batch:
        words.merge(a + 1, b + 1, n + 1)
    return words.symbols().astype(x.dtype)


def rewrite_block(x, cnt, batch):
    """(symbols, counts, gram keys, gram counts): the block after the merges, and what its grams gained and lost."""
    import numpy as np
    hit = np.zeros(len(x), bool)
    # a pair of a symbol made in this batch can only come up in a word that holds an earlier one
    hit[:-1] = np.isin(gram_key(0, x[:-1].astype(np.int64), x[1:]), [gram_key(0, a + 1, b + 1) for a, b, _ in batch])
    ends = np.flatnonzero(x == 0)
    words = np.unique(np.searchsorted(ends, np.flatnonzero(hit)))
    if not len(words):
        return x, cnt, np.zeros(0, np.int64), np.zeros(0, np.int64)
    changed = np.zeros(len(ends), bool)
    changed[words] = True
    inside = np.repeat(changed, np.diff(ends, prepend=-1))
    old = x[inside]
    new = merge_symbols(old, batch)
    g, d = _gained((lambda k, c: (k, -c))(*_grams(old, cnt[changed])), _grams(new, cnt[changed]))
    # words of one symbol are done
    sizes = np.diff(np.flatnonzero(new == 0), prepend=-1)
    long = sizes > 2
    return (np.concatenate([x[~inside], new[np.repeat(long, sizes)]]), np.concatenate([cnt[~changed], cnt[changed][long]]), g, d)


def _row(x, cnt, g, d):
    import numpy as np
    import pyarrow as pa
    kind = np.min_scalar_type(int(cnt.max())) if len(cnt) and cnt.min() >= 0 else np.dtype(np.int64)
    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, pa.int64())) for v in (g, d)]
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([cnt.astype(kind).tobytes()], pa.binary()),
                                       pa.array([kind.itemsize], pa.int32()), *lists], ["x", "c", "w", "g", "d"])


def _blocks(batches, wide: str):
    """(symbols, counts) of the blocks in Arrow batches of (x, c, w)."""
    import numpy as np
    for batch in batches:
        for x, c, w in zip(*(col.to_pylist() for col in batch.columns)):
            yield np.frombuffer(x, wide), np.frombuffer(c, np.int64 if w == 8 else f"<u{w}").astype(np.int64)


def _counts(column):
    import pyarrow as pa
    import pyarrow.compute as pc
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)


def blocks_of_words(words: DataFrame, byte_ids: list[int], wide: str) -> DataFrame:
    """Blocks with all their grams, from (word as bytes, cnt)."""
    def build(batches):
        import numpy as np
        import pyarrow as pa
        lut = np.array(byte_ids, np.int64) + 1
        for batch in batches:
            if batch.num_rows:
                text = batch.column(0).cast(pa.large_binary())
                ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
                data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
                x = np.zeros(len(data) + len(text), wide)
                x[np.arange(len(data)) + np.repeat(np.arange(len(text)), np.diff(ends))] = lut[data]
                cnt = _counts(batch.column(1))
                yield _row(x, cnt, *_gained(_grams(x, cnt)))

    return words.mapInArrow(build, _BLOCK)


def blocks_of_strings(words: DataFrame, wide: str) -> DataFrame:
    """Blocks with all their grams, from (s, cnt) as the log has them."""
    def build(batches):
        import numpy as np
        for batch in batches:
            if batch.num_rows:
                chars = np.frombuffer("".join(s + "\n" for s in batch.column(0).to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
                x = np.where(chars == 10, 0, chars - _FIRST + 1 - np.where(chars >= 0xE000, 0x800, 0)).astype(wide)
                cnt = _counts(batch.column(1))
                yield _row(x, cnt, *_gained(_grams(x, cnt)))

    return words.mapInArrow(build, _BLOCK)


def strings_of_blocks(state: DataFrame, wide: str) -> DataFrame:
    """(s, cnt): a row per word, one character per symbol."""
    def spell(batches):
        import numpy as np
        import pyarrow as pa
        for x, cnt in _blocks(batches, wide):
            c = x.astype(np.int64) - 1 + _FIRST
            chars = np.where(x == 0, 10, np.where(c < 0xD800, c, c + 0x800)).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array(chars.tobytes().decode("utf-32-le").split("\n")[:-1], pa.string()), pa.array(cnt)],
                                             ["s", "cnt"])

    return state.select("x", "c", "w").mapInArrow(spell, "s string, cnt long")


def rewritten_blocks(state: DataFrame, batch: list[tuple[int, int, int]], wide: str) -> DataFrame:
    """The blocks after the merges of a batch, with what their grams gained and lost."""
    def rewrite(batches):
        for x, cnt in _blocks(batches, wide):
            yield _row(*rewrite_block(x, cnt, batch))

    return state.select("x", "c", "w").mapInArrow(rewrite, _BLOCK)


def changed_pairs(blocks: DataFrame) -> DataFrame:
    """(p, c): the pairs (keys) that blocks gained and lost."""
    return changed_grams(blocks).select(F.shiftright("g", _BITS).alias("p"), "c")


def stretches(state: DataFrame, pairs: list[int], wide: str) -> DataFrame:
    """(s, c): the stretches of the blocks' words in which every neighbouring pair is one of ``pairs`` (keys), a 0 after
    each, with their counts added up."""
    def cut(batches):
        import numpy as np
        import pyarrow as pa
        listed = np.array(sorted(pairs), np.int64)
        for x, cnt in _blocks(batches, wide):
            key = gram_key(0, x[:-1].astype(np.int64), x[1:])
            joined = np.append(listed[np.minimum(np.searchsorted(listed, key), len(listed) - 1)] == key, False)
            inside = joined.copy()  # symbols of a stretch: those joined to the next one, and the last
            inside[1:] |= joined[:-1]
            last = inside & ~joined
            out = x[inside]
            ends = np.flatnonzero(last[inside])
            size = x.dtype.itemsize
            if len(ends):
                out = np.insert(out, ends + 1, 0)
                offsets = np.append(0, (ends + 2 + np.arange(len(ends)))) * size
                c = cnt[np.searchsorted(np.flatnonzero(x == 0), np.flatnonzero(last))]
                s = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out.tobytes())])
                found = pa.table([s, pa.array(c)], ["s", "c"]).group_by("s", use_threads=False).aggregate([("c", "sum")])
                yield from found.select(["s", "c_sum"]).rename_columns(["s", "c"]).cast(pa.schema([("s", pa.binary()), ("c", pa.int64())])).to_batches()

    return state.select("x", "c", "w").mapInArrow(cut, "s binary, c long").groupBy("s").agg(F.sum("c").alias("c"))


def plan_stretches(x, weights, last: tuple[int, int, int] | None, next_id: int, room: int, known=lambda a, b: None,
                   min_frequency: int = 2) -> list[tuple[int, int, int]]:
    """Merges (left, right, id) of one round, in order, from the stretches' symbols and their counts.

    ``last``: the least of the listed pairs as (-count, left, right), with which the merges end; None if all pairs
    are listed. ``known(left, right)`` names the id of a token spelled alike, if there is one; its pairs may
    rise in count outside the stretches, so the round ends there.
    """
    import numpy as np
    from heapq import heapify, heappop, heappush
    each = np.repeat(weights, np.diff(np.flatnonzero(x == 0), prepend=-1))
    least = max(min_frequency, -last[0]) if last else min_frequency
    words = Places(x, np.append(each, 0), least=least)
    heap = [(-c, k) for k, c in words.counts.items()]
    heapify(heap)
    out: list[tuple[int, int, int]] = []
    while heap and len(out) < room:
        c, key = heappop(heap)
        now = words.counts.get(key, 0)
        if now != -c:  # an older count of the pair
            continue
        a, b = (key >> _BITS) - 1, (key & _MASK) - 1
        if now < min_frequency or last and (c, a, b) > last:
            break
        n = known(a, b)
        out.append((a, b, next_id if n is None else n))
        if n is not None:
            break
        for k in set(words.merge(a + 1, b + 1, next_id + 1)):
            heappush(heap, (-words.counts[k], k))
        next_id += 1
    return out


def changed_grams(blocks: DataFrame) -> DataFrame:
    """(g, c): the grams that blocks gained and lost."""
    return blocks.selectExpr("inline(arrays_zip(g, d))").toDF("g", "c")


def apply_merges(s: Column, batch: list[tuple[int, int, int]]) -> Column:
    """``merge_symbols`` of a word in the log's spelling, as a column. (A fold over a constant
    array: the generated code is the same every round, so nothing is compiled anew.)"""
    steps = F.split(F.lit(" ".join(symbol_char(a) + symbol_char(b) + symbol_char(n) for a, b, n in batch)), " ")
    return F.aggregate(steps, s, lambda word, m: F.replace(word, F.substring(m, 1, 2), F.substring(m, 3, 1)))


def plan_batch(pairs: list[tuple[int, int, int]], triples: dict[tuple[int, int, int], int], floor: int, next_id: int, room: int,
               known=lambda a, b: None, min_frequency: int = 2, exact: bool = True) -> list[tuple[int, int, int]]:
    """Merges (left, right, id) of one round, in order.

    ``pairs``: the most frequent pairs with their counts, in order (count, left, right); ``triples``: every triple
    whose two pairs are both among them; ``floor``: no other pair is more frequent. ``known(left, right)``
    names the id of a token spelled alike, if there is one. ``exact=False`` accepts all pairs that share no
    symbol with an accepted one, whatever the bounds.
    """
    if not exact:
        out, used = [], set()
        for a, b, _ in pairs:
            if len(out) < room and not {a, b} & used:
                old = known(a, b)
                out.append((a, b, next_id + sum(x[2] >= next_id for x in out) if old is None else old))
                used |= {a, b, out[-1][2]}
        return out
    bounds = {(a, b): [c, c] for a, b, c in pairs}
    before, after = defaultdict(list), defaultdict(list)  # what stands left and right of a pair
    for x, y, z in triples:
        before[y, z].append(x)
        after[x, y].append(z)
    atoms: dict[int, tuple[int, ...]] = {}  # new symbols, spelled in those of the round's start
    touched: set[int] = set()
    spell = lambda s: atoms.get(s, (s,))

    def most(*symbols) -> int:
        """An upper bound of how often the symbols stand in a row."""
        seq = [x for s in symbols for x in spell(s)]
        return min(triples.get(tuple(seq[i:i + 3]), floor) for i in range(len(seq) - 2))

    out: list[tuple[int, int, int]] = []
    while len(out) < room and bounds:
        best = min(bounds, key=lambda p: (-bounds[p][0], p))
        low = bounds[best][0]
        if low < min_frequency:
            break
        if out and (low <= floor or any(hi > low or (hi == low and p < best) for p, (_, hi) in bounds.items() if p != best)):
            break
        a, b = best
        n = known(a, b)
        reused = n is not None
        if not reused:
            n, next_id = next_id, next_id + 1
        out.append((a, b, n))
        if reused:  # counts of its pairs rise by more than triples say
            break
        del bounds[best]
        plain = a != b and not {a, b} & touched and a not in atoms and b not in atoms
        sure = lambda x: plain and x not in touched and x not in atoms and x != a and x != b
        for (u, v), bound in bounds.items():
            for overlaps, other, row in ((v == a, u, (u, a, b)), (u == b, v, (a, b, v))):
                if overlaps:
                    t = most(*row)
                    bound[0] = max(0, bound[0] - t)
                    if sure(other) and row in triples:
                        bound[1] -= t
        spelled = spell(a) + spell(b)
        atoms[n] = spelled
        for x in before[spelled[0], spelled[1]]:
            for left in [x, *(m for m, s in atoms.items() if s[-1] == x)]:
                hi = most(left, a, b)
                if hi > floor:
                    bounds[left, n] = [hi if left == x and sure(x) else 0, hi]
        for y in after[spelled[-2], spelled[-1]]:
            for right in [y, *(m for m, s in atoms.items() if s[0] == y)]:
                hi = most(a, b, right)
                if hi > floor:
                    low_known = hi if right == y and sure(y) else 0
                    old = bounds.get((n, right))
                    bounds[n, right] = [low_known, hi] if old is None else [max(old[0], low_known), max(old[1], hi)]
        touched |= {a, b}
    return out


class RoundLog:
    """Written rounds: ``words/round=N`` (s, cnt), then ``merges/round=N`` (rank, left, right)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.base = spark, folder.rstrip("/")

    def last(self) -> tuple[int, DataFrame, list[tuple[str, str]]] | None:
        """The newest complete round: its number, words and merges; None if there is none."""
        try:
            merges = self.spark.read.parquet(f"{self.base}/merges")
        except AnalysisException:
            return None
        n = merges.agg(F.max("round")).first()[0]
        if n is None:
            return None
        rows = merges.where(F.col("round") == n).orderBy("rank").collect()  # the model's own size
        return n, self.spark.read.parquet(f"{self.base}/words/round={n}"), [(r["left"], r["right"]) for r in rows]

    def write(self, n: int, words: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
        """Write a round, words first; returns the written words."""
        words.write.mode("overwrite").parquet(f"{self.base}/words/round={n}")
        (self.spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank int, left string, right string")
         .coalesce(1).write.mode("overwrite").parquet(f"{self.base}/merges/round={n}"))
        return self.spark.read.parquet(f"{self.base}/words/round={n}")


class _Spelled:
    """``known`` of a round: the id of a token spelled as two symbols together, new tokens of the round included."""

    def __init__(self, vocab: list[str], index: dict[str, int]):
        self.vocab, self.index = list(vocab), dict(index)

    def __call__(self, a: int, b: int) -> int | None:
        token = self.vocab[a] + self.vocab[b]
        n = self.index.get(token)
        if n is None:
            self.index[token] = len(self.vocab)
            self.vocab.append(token)
        return n


def _collected(found: DataFrame, wide: str):
    """(symbols, counts) of the stretches; None if they have more than ``STRETCHES`` symbols."""
    import numpy as np
    import pyarrow as pa
    found = found.persist()
    try:
        if (found.agg(F.sum(F.octet_length("s"))).first()[0] or 0) > STRETCHES * np.dtype(wide).itemsize:
            return None
        rows = found.toArrow()
    finally:
        found.unpersist()
    x = np.frombuffer(b"".join(rows["s"].to_pylist()), wide)
    return x, rows["c"].cast(pa.int64()).to_numpy()


def train(words: DataFrame, vocab: list[str], byte_ids: list[int], vocab_size: int, min_frequency: int = 2, candidates: int = 256,
          exact: bool = True, checkpoint_every: int = 4, log_dir: str | None = None,
          stop_after: int | None = None) -> tuple[list[str], list[tuple[str, str]], list[int]]:
    """(vocabulary, merges, merges per round) from (word, cnt). ``vocab``: special tokens and alphabet, in id order.

    ``stop_after`` ends the job after so many rounds of its own (a time limit; with ``log_dir`` the next job goes on).
    """
    spark = words.sparkSession
    checkpoint_dir(spark)
    if vocab_size >= _MASK:
        raise ValueError(f"vocab_size must be under {_MASK}")
    wide = "<u2" if max(vocab_size, len(vocab)) < 0xFFFF else "<u4"
    vocab, merges, sizes = list(vocab), [], []
    index = {t: i for i, t in enumerate(vocab)}
    log = RoundLog(spark, log_dir) if log_dir else None
    resumed = log.last() if log else None
    first = 0
    if resumed:
        first, state, merges = resumed
        for a, b in merges:
            if a + b not in index:
                index[a + b] = len(vocab)
                vocab.append(a + b)
        state = blocks_of_strings(state.select("s", "cnt"), wide).checkpoint(eager=True)
    else:
        # the distinct words are few next to the corpus; adaptive execution would pack them into a task or two
        # (tasks go through them block by block, so a few per core do, however many a shuffle has)
        parts = 2 * spark.sparkContext.defaultParallelism
        state = blocks_of_words(words.select(F.col("word").cast("binary"), F.col("cnt").cast("long")).where(F.octet_length("word") > 1)
                                .repartition(parts), byte_ids, wide).checkpoint(eager=True)
    counts = changed_pairs(state).groupBy("p").agg(F.sum("c").alias("c")).persist()
    held: list[DataFrame] = [counts]
    old: list[DataFrame] = []
    done = 0
    listed = max(1, candidates // 32) if exact else candidates
    while len(vocab) < vocab_size and (stop_after is None or done < stop_after):
        best = counts.where(F.col("c") >= min_frequency).orderBy(F.desc("c"), "p").limit(listed).collect()
        for df in old:  # read for the last time by the job above
            df.unpersist()
        if not best:
            break
        pairs = [(*gram_symbols(r["p"] << _BITS)[:2], r["c"]) for r in best]
        if exact:
            rest = len(pairs) == listed  # there may be pairs that are not listed
            while (found := _collected(stretches(state, [gram_key(0, a + 1, b + 1) for a, b, _ in pairs], wide), wide)) is None:
                pairs, rest = pairs[:len(pairs) // 2], True
            a, b, c = pairs[-1]
            made = _Spelled(vocab, index)
            batch = plan_stretches(*found, (-c, a, b) if rest else None, len(vocab), vocab_size - len(vocab), made, min_frequency)
            more = (2 if done < 3 else 4) if len(found[0]) <= STRETCHES // 12 else 2 if len(found[0]) <= STRETCHES // 3 else 1
            listed = min(LISTED, more * len(pairs))
        else:
            batch = plan_batch(pairs, {}, best[-1]["c"], len(vocab), vocab_size - len(vocab),
                               lambda a, b: index.get(vocab[a] + vocab[b]) if max(a, b) < len(vocab) else None, min_frequency, False)
        for a, b, n in batch:
            merges.append((vocab[a], vocab[b]))
            if n == len(vocab):
                index[vocab[a] + vocab[b]] = n
                vocab.append(vocab[a] + vocab[b])
        done += 1
        sizes.append(len(batch))
        rewritten = rewritten_blocks(state, batch, wide).persist()
        counts = counts.unionByName(changed_pairs(rewritten)).groupBy("p").agg(F.sum("c").alias("c")).where("c > 0")
        state = rewritten
        if done % checkpoint_every == 0:
            counts = counts.checkpoint(eager=True)
            state = (blocks_of_strings(log.write(first + done, strings_of_blocks(state, wide), merges), wide) if log
                     else state.select("x", "c", "w").checkpoint(eager=True))
            old, held = [*held, rewritten], []
        else:
            counts = counts.persist()
            old, held = held, [counts, rewritten]
    if log and done % checkpoint_every:
        log.write(first + done, strings_of_blocks(state, wide), merges)
    for df in (*old, *held):
        df.unpersist()
    return vocab, merges, sizes
