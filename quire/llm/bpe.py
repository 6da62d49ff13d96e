"""Byte-level BPE: speculate and verify.

A tokenizer file (``tokenizers`` JSON, byte-level BPE) is broadcast to the tasks. There a
text is cut into pre-tokens; each new pre-token is

1. proposed: greedy longest match over the vocabulary,
2. verified: all adjacent token pairs of all proposals are tested at once with numpy.
   A pair is compatible if merging its bytes alone leaves the two tokens as they
   are; a sequence whose adjacent pairs are all compatible is the exact encoding,
3. merged exactly, only if a pair failed.

Known pre-tokens are looked up. ``decode`` turns ids back into text with a table of bytes.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NEVER = 1 << 40
CACHE_WORDS = 600_000  # pre-tokens remembered by a Python worker; then it starts afresh
PART_CHARS = 1 << 21
PARTING = "\u0100"  # beyond the 256 letters that bytes are spelled with

PLAIN_TOP = 0x250  # texts of Latin letters below this code point take Python's own regular expressions


def pretoken_pattern(letter: str, number: str, space: str) -> str:
    """The pre-token pattern of byte-level tokenizers over given character classes."""
    return (rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+"
            rf"|[{space}]+(?![^{space}])|[{space}]+")


def category_ranges(kind: str, top: int) -> str:
    """A character class of the code points under ``top`` whose Unicode category starts with ``kind``."""
    import re
    import unicodedata

    runs: list[list[int]] = []
    for c in range(top):
        if unicodedata.category(chr(c)).startswith(kind):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands
    for itself, the others are numbered from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Bpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, raw: bytes):
        import re

        import ahocorasick
        import numpy as np
        import regex

        spec = json.loads(raw)
        model = spec["model"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer") \
                or model.get("dropout") or model.get("ignore_merges") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("not a plain byte-level BPE tokenizer file")
        added = spec.get("added_tokens") or []
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            raise ValueError("added tokens that strip or match whole words are not supported")
        letters = byte_letters()

        def as_bytes(token: str) -> bytes:
            try:
                return bytes(letters[c] for c in token)
            except KeyError:
                return token.encode("utf-8")

        ids = model["vocab"]
        top = max([*ids.values(), *(t["id"] for t in added)], default=-1) + 1
        self.piece = [b""] * top
        for token, i in ids.items():
            self.piece[i] = as_bytes(token)
        self.added = {t["content"]: t["id"] for t in added}
        for content, i in self.added.items():
            self.piece[i] = as_bytes(content)
        self.byte_id = {letters[t]: i for t, i in ids.items() if len(t) == 1 and t in letters}

        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.width = top
        keys = left * top + right
        keys, first = np.unique(keys, return_index=True)
        self.keys, self.key_rank = keys, first
        self.rank_of = dict(zip(keys.tolist(), first.tolist()))
        self.made_by = made.tolist()
        # how a token came to be; a token with several merges is never proposed
        self.rank = np.full(top, -1, dtype=np.int64)
        self.left, self.right = np.zeros(top, dtype=np.int64), np.zeros(top, dtype=np.int64)
        self.rank[made], self.left[made], self.right[made] = np.arange(len(made)), left, right
        times = np.bincount(made, minlength=top) if len(made) else np.zeros(top, dtype=np.int64)
        whole = self._compatible(left, right, np.arange(len(made)))
        sound = np.zeros(top, dtype=bool)
        sound[list(self.byte_id.values())] = True
        for r in range(len(made)):  # parts are made before wholes
            sound[made[r]] = whole[r] and times[made[r]] == 1 and sound[left[r]] and sound[right[r]]
        self.made = made
        self.length = np.array([len(x) for x in self.piece], dtype=np.int64)
        self.greedy = ahocorasick.Automaton()
        for i in np.nonzero(sound)[0].tolist():
            self.greedy.add_word(self.piece[i].decode("latin-1"), i)
        self.greedy.make_automaton()
        self.wide = re.compile(f"[^\0-{chr(PLAIN_TOP - 1)}]").search
        self.plain = re.compile(pretoken_pattern(category_ranges("L", PLAIN_TOP), category_ranges("N", PLAIN_TOP), r"\t-\r \x85\xa0"))
        self.full = regex.compile(pretoken_pattern(r"\p{L}", r"\p{N}", r"\t-\r\p{Z}\x85"))
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self.known: dict[str, bytes] = {}
        self.stats = {"proposed": 0, "failed": 0}

    # ------------------------------------------------------------ verify
    def _compatible(self, a, b, limit=None):
        """Per pair of tokens: does no merge cross the border when the bytes of both are merged?

        Goes back in time: the two tokens at the border are undone, latest merge first. If
        they could merge with a rank under that of the merge just undone, they would
        have. Among equal ranks the left place comes first, so undoing the right token
        lets an equal rank win.
        """
        import numpy as np

        a, b = a.copy(), b.copy()
        limit = np.full(len(a), NEVER) if limit is None else limit.copy()
        ok = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        while len(live) and len(self.keys):
            x, y = a[live], b[live]
            key = x * self.width + y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            merged = np.where(self.keys[at] == key, self.key_rank[at], NEVER)
            bad = merged < limit[live]
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[on], x[on], y[on], rx[on], ry[on]
            later = ry >= rx
            limit[live] = np.where(later, ry + 1, rx)
            b[live] = np.where(later, self.left[y], y)
            a[live] = np.where(later, x, self.right[x])
        return ok

    # ------------------------------------------------------------ propose
    def _propose(self, raw: list[bytes]):
        """Greedy longest match of many words at once: (ids, number of the word of each id, words that the
        vocabulary does not cover)."""
        import numpy as np

        starts = np.cumsum([0, *(len(w) + 1 for w in raw)], dtype=np.int64)
        joined = PARTING.join(w.decode("latin-1") for w in raw) + PARTING
        found = list(self.greedy.iter_long(joined))
        ends = np.fromiter((e for e, _ in found), dtype=np.int64, count=len(found))
        ids = np.fromiter((t for _, t in found), dtype=np.int64, count=len(found))
        owner = np.searchsorted(starts, ends, side="right") - 1
        covered = np.bincount(owner, weights=self.length[ids], minlength=len(raw))
        return ids, owner, np.nonzero(covered != np.diff(starts) - 1)[0]

    # ------------------------------------------------------------ exact
    def _merge(self, raw: list[bytes]) -> list[list[int]]:
        """Exact merging, lowest rank first, then leftmost. Words of usual length take their merges side
        by side, one merge per word and round; a long word takes a heap."""
        import numpy as np

        out: list = [None] * len(raw)
        usual = [k for k, w in enumerate(raw) if len(w) <= 64]
        for k in set(range(len(raw))) - set(usual):
            out[k] = self._merge_long([self.byte_id[b] for b in raw[k] if b in self.byte_id])
        byte = np.full(256, -1, dtype=np.int64)
        byte[list(self.byte_id)] = list(self.byte_id.values())
        ids = byte[np.frombuffer(b"".join(raw[k] for k in usual), dtype=np.uint8)]
        owner = np.repeat(np.array(usual, dtype=np.int64), [len(raw[k]) for k in usual])
        ids, owner = ids[ids >= 0], owner[ids >= 0]

        def ranks(at):
            """The rank of the pair that begins at each place."""
            nxt = np.minimum(at + 1, len(ids) - 1)
            key = ids[at] * self.width + ids[nxt]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[k] == key) & (at + 1 < len(ids)) & (owner[at] == owner[nxt])
            return np.where(hit, self.key_rank[k], NEVER)

        done = [(owner[:0], ids[:0])]
        rank = ranks(np.arange(len(ids))) if len(ids) and len(self.keys) else np.full(len(ids), NEVER)
        while len(ids):
            first = np.r_[0, np.nonzero(np.diff(owner))[0] + 1]
            word = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(ids)]))
            least = np.minimum.reduceat(rank, first)
            over = (least == NEVER)[word]
            if over.any():
                done.append((owner[over], ids[over]))
                ids, owner, rank = ids[~over], owner[~over], rank[~over]
                continue
            at = np.nonzero(rank == least[word])[0]
            at = at[np.r_[True, np.diff(word[at]) > 0]]  # the leftmost of each word
            ids[at] = self.made[rank[at]]
            stay = np.ones(len(ids), dtype=bool)
            stay[at + 1] = False
            moved = at - np.arange(len(at))  # their places once the right halves are gone
            ids, owner, rank = ids[stay], owner[stay], rank[stay]
            around = np.unique(np.r_[moved, np.maximum(moved - 1, 0)])
            rank[around] = ranks(around)
        owner, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], usual)
        ends = np.searchsorted(owner[order], usual, side="right")
        ids = ids[order].tolist()
        for k, a, b in zip(usual, cuts.tolist(), ends.tolist()):
            out[k] = ids[a:b]
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        import heapq

        nxt, prv = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = []

        def offer(i):
            j = nxt[i]
            if j < len(ids):
                r = self.rank_of.get(ids[i] * self.width + ids[j])
                if r is not None:
                    heapq.heappush(heap, (r, i, ids[i], j, ids[j]))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            r, i, x, j, y = heapq.heappop(heap)
            if ids[i] != x or nxt[i] != j or ids[j] != y:
                continue
            ids[i], ids[j] = self.made_by[r], -1
            nxt[i] = nxt[j]
            if nxt[j] < len(ids):
                prv[nxt[j]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return [t for t in ids if t >= 0]

    # ------------------------------------------------------------ words
    def learn(self, words: set[str]) -> None:
        """Encode pre-tokens not known yet and remember their ids as 32-bit numbers."""
        from array import array

        import numpy as np

        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        fresh = [w for w in words if w not in self.known]
        if not fresh:
            return
        raw = [w.encode("utf-8") for w in fresh]
        ids, owner, uncovered = self._propose(raw)
        inner = np.nonzero(owner[1:] == owner[:-1])[0]
        pairs, back = np.unique(ids[inner] * self.width + ids[inner + 1], return_inverse=True)
        fits = self._compatible(pairs // self.width, pairs % self.width)
        wrong = sorted({*uncovered.tolist(), *owner[inner[~fits[back]]].tolist()})
        self.stats["proposed"] += len(fresh)
        self.stats["failed"] += len(wrong)
        ends = np.cumsum(np.bincount(owner, minlength=len(fresh)))
        flat = ids.astype("<i4").tobytes()
        start = 0
        for w, end in zip(fresh, (ends * 4).tolist()):
            self.known[w] = flat[start:end]
            start = end
        for k, merged in zip(wrong, self._merge([raw[k] for k in wrong])):
            self.known[fresh[k]] = array("i", merged).tobytes()

    def _pattern(self, text: str):
        return self.full if self.wide(text) else self.plain

    def _words(self, text: str):
        """Lists of pre-tokens of a stretch without added tokens; long stretches in several lists."""
        if len(text) <= PART_CHARS:
            yield self._pattern(text).findall(text)
            return
        from itertools import islice
        it = (m.group() for m in self._pattern(text).finditer(text))
        while part := list(islice(it, 1 << 17)):
            yield part

    def _stretches(self, text: str):
        if self.split_added is None or not any(t in text for t in self.added):
            return [text]
        return [s for s in self.split_added.split(text) if s]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as 32-bit little-endian numbers."""
        import numpy as np

        out = []
        part, size = [], 0

        def flush():
            lists = []
            for text in part:
                of = []
                for s in self._stretches(text):
                    if s in self.added:
                        of.append(np.int32(self.added[s]).tobytes())
                    elif len(s) > PART_CHARS:
                        for w in self._words(s):
                            self.learn(set(w))
                            of.append(b"".join(map(self.known.__getitem__, w)))
                    else:
                        of.append(self._pattern(s).findall(s))
                lists.append(of)
            self.learn(set().union(*(x for of in lists for x in of if isinstance(x, list))))
            for of in lists:
                out.append(b"".join(b"".join(map(self.known.__getitem__, x)) if isinstance(x, list) else x for x in of))

        for text in texts:
            part.append(text or "")
            size += len(part[-1])
            if size > PART_CHARS:
                flush()
                part, size = [], 0
        flush()
        return out

    def decode(self, ids) -> str:
        """The text of a list of ids; unknown ids are skipped, broken UTF-8 is replaced."""
        piece = self.piece
        return b"".join([piece[i] for i in ids if 0 <= i < len(piece)]).decode("utf-8", "replace")


def read_tokenizer(spark, path: str) -> bytes:
    """The tokenizer file: a local path on the driver, or a URI that Spark reads."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _over(df: DataFrame, path: str | None, carry: list[str], source: str, out: str, kind: T.DataType, work) -> DataFrame:
    """Run ``work(model, arrow array) -> arrow array`` over column ``source``, beside ``carry``."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast({"raw": read_tokenizer(spark, path or default_path())})  # one file's size

    def run(batches):
        import pyarrow as pa

        held = shared.value
        if "model" not in held:  # once per Python worker
            held["model"] = Bpe(held["raw"])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                made = work(held["model"], b.column(b.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=[*names, out])

    names = [f"c{k}" for k in range(len(carry))]
    given = df.select(*[df[c].alias(n) for c, n in zip(carry, names)], df[source].alias("source"))
    schema = T.StructType([*[T.StructField(n, given.schema[n].dataType) for n in names], T.StructField(out, kind)])
    return given.mapInArrow(run, schema).toDF(*carry, out)


def encode(df: DataFrame, carry=("doc_id",), text_col: str = "text", path: str | None = None) -> DataFrame:
    """(carry..., ids array<int>): whole texts encoded, one row per row, no shuffle.

    Null texts count as empty and give no ids. Strings of added tokens in a text become their
    ids. Extra columns are left out unless carried.
    """
    def work(model, texts):
        import numpy as np
        import pyarrow as pa
        got = model.encode(texts.to_pylist())
        ends = np.cumsum([0, *(len(x) // 4 for x in got)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), dtype="<i4")))
    return _over(df, path, list(carry), text_col, "ids", T.ArrayType(T.IntegerType()), work)


def count_tokens(df: DataFrame, carry=("doc_id",), text_col: str = "text", path: str | None = None) -> DataFrame:
    """(carry..., n_tokens bigint): the encoded length of every whole text; null counts as empty."""
    def work(model, texts):
        import pyarrow as pa
        return pa.array([len(x) // 4 for x in model.encode(texts.to_pylist())], pa.int64())
    return _over(df, path, list(carry), text_col, "n_tokens", T.LongType(), work)


def decode(df: DataFrame, carry=("doc_id",), ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(carry..., text): the text of every list of ids; null lists give an empty text."""
    def work(model, lists):
        import pyarrow as pa
        return pa.array([model.decode(x or ()) for x in lists.to_pylist()], pa.string())
    return _over(df, path, list(carry), ids_col, "text", T.StringType(), work)
