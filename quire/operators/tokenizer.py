"""Byte-level BPE tokenizer on Spark (T-1..T-8, Q-1..Q-3, A-9).

Training (T-5, ``bpe_training``) never gathers the corpus: the corpus pass is a
distributed word count (T-4), and the rounds keep the counts of pairs and triples
up to date from the words that change. Only the model itself (vocabulary and
merges, bounded by ``vocab_size``) lives on the driver, as a trained model does.

Encoding (T-6) hands whole texts to an Arrow UDF over a broadcast of the model, which
cuts a batch into words (T-2, ``pretokens``), looks up each distinct word once and
merges all words that are new to it side by side; decoding (T-7) is an Arrow
UDF. Both work on a batch's flat values, so no row becomes Python lists.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from quire.functions import col_of, int_array, let
from quire.functions.ids import SPECIAL_TOKENS
from quire.operators import pretokens

# ---------------------------------------------------------------- fixed values
# The published byte-level pre-tokenizer split pattern (add_prefix_space=False).
PRETOKEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Tokenizer files written next to the model (key names are the contract).
TOKENIZER_CONFIG = {
    "add_bos_token": False,
    "add_eos_token": False,
    "add_prefix_space": False,
    "bos_token": "<|im_start|>",
    "eos_token": "<|im_end|>",
    "pad_token": "<|im_end|>",
    "unk_token": "<unk>",
    "model_max_length": int(1e30),
    "clean_up_tokenization_spaces": False,
    "tokenizer_class": "PreTrainedTokenizerFast",
    "chat_template": (
        "{% for message in messages %}"
        "{% if message['role'] in ['system', 'user', 'assistant'] %}"
        "<|im_start|>{{ message['role'] }}\n{{ message['content'] }}<|im_end|>\n"
        "{% endif %}{% endfor %}"
        "{% if add_generation_prompt %}{{ '<|im_start|>assistant\n' }}{% endif %}"
    ),
}
SPECIAL_TOKENS_MAP = {
    "bos_token": "<|im_start|>",
    "eos_token": "<|im_end|>",
    "unk_token": "<unk>",
    "pad_token": "<|im_end|>",
    "additional_special_tokens": ["<s>", "</s>"],
}

# Characters for which NFKC is the identity: ASCII and the Latin-1 letters.
# Rows made only of these skip the Python normalizer.
_NFKC_STABLE = r"^[\x{00}-\x{7F}\x{C0}-\x{FF}]*$"


def byte_to_char() -> list[str]:
    """The 256-symbol byte alphabet: printable Latin-1 bytes map to themselves,
    the other bytes to U+0100 upwards in byte order (rule, not a table)."""
    keep = (list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1))
            + list(range(ord("®"), ord("ÿ") + 1)))
    out, extra = {}, 0
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


BYTE_CHARS = byte_to_char()
# Alphabet ids follow the special tokens, in code-point order of the symbols.
ALPHABET = sorted(BYTE_CHARS)
N_SPECIAL = len(SPECIAL_TOKENS)
BYTE_IDS = [N_SPECIAL + ALPHABET.index(c) for c in BYTE_CHARS]


# ---------------------------------------------------------------- T-1, T-2, T-3, T-4
@F.pandas_udf(StringType())
def _nfkc_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(df: DataFrame, text: str = "text") -> DataFrame:
    """T-1: Unicode NFKC of ``text``, in one scan.

    Rows whose characters are all NFKC-stable stay on the JVM: they cross to
    Python as nulls and keep their own text.
    """
    c = F.col(text)
    return df.withColumn(text, F.coalesce(_nfkc_udf(F.when(~c.rlike(_NFKC_STABLE), c)), c))


def pretokenize(text) -> Column:
    """T-2: the byte-level splitter on the JVM (Java regex has the lookahead RE2 lacks)."""
    return F.regexp_extract_all(col_of(text), F.lit("(?U)" + PRETOKEN_PATTERN), 0)


def split_special(text, specials=SPECIAL_TOKENS) -> Column:
    """A text cut before and after every special token; empty pieces left out."""
    either = "|".join(re.escape(t) for t in sorted(specials, key=len, reverse=True))
    # up to the next special token, lazily: looking behind at every character costs far more
    return F.regexp_extract_all(col_of(text), F.lit(f"(?s){either}|.+?(?={either}|\\z)"), 0)


def _nfkc_parts_udf(specials: tuple[str, ...], nested: bool = False):
    """NFKC between special tokens: text to pieces (``nested``: array of texts to arrays of pieces)."""
    cut = "(" + "|".join(re.escape(t) for t in sorted(specials, key=len, reverse=True)) + ")"

    def parts(x):
        return [p if p in specials else unicodedata.normalize("NFKC", p) for p in re.split(cut, x) if p]

    kind = ArrayType(StringType())

    @F.pandas_udf(ArrayType(kind) if nested else kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else [parts(y) for y in x] if nested else parts(x))
    return run


def word_symbols(word) -> Column:
    """T-3: a word's UTF-8 bytes as alphabet ids (one id per byte)."""
    lut = int_array(BYTE_IDS)

    def body(h):
        n = F.length(h) / 2
        idx = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(idx, lambda i: F.get(lut, F.conv(F.substring(h, i * 2 + 1, 2), 16, 10).cast("int")))
    return let(F.hex(F.encode(col_of(word), "UTF-8")), body)


_COUNTED = 2_000  # texts whose words are counted at once


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """T-4: frequency of each pre-token over the corpus (NFKC first); a partial aggregation, begun batch by batch."""
    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _COUNTED):
                words, _ = pretokens.words(batch.column(0).slice(at, _COUNTED))
                found = words.dictionary_encode()
                n = np.bincount(found.indices.to_numpy(zero_copy_only=False), minlength=len(found.dictionary))
                yield pa.RecordBatch.from_arrays([found.dictionary.cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    n = nfkc(df.select(text), text)
    return n.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("cnt"))


def whitespace_word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """T-4 whitespace variant (SQL-checkable): words split on runs of space, tab, CR, LF."""
    words = F.filter(F.split(F.col(text), "[ \\t\\n\\r]+"), lambda w: F.length(w) > 0)
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def pair_counts(words: DataFrame, symbols: str = "symbols", cnt: str = "cnt") -> DataFrame:
    """A-9: adjacent-symbol pair counts weighted by word frequency."""
    n = F.size(symbols)
    z = F.arrays_zip(F.slice(symbols, 1, F.greatest(n - 1, F.lit(0))).alias("left"),
                     F.slice(symbols, 2, F.greatest(n - 1, F.lit(0))).alias("right"))
    p = words.select(F.explode(z).alias("p"), F.col(cnt).alias("_c"))
    return p.groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(
        F.sum("_c").alias("cnt"))


# ---------------------------------------------------------------- model
@dataclass
class BpeModel:
    """A trained byte-level BPE model: ``vocab[id] = token``, ``merges[rank] = (left, right)``."""

    vocab: list[str]
    merges: list[tuple[str, str]]
    special_tokens: tuple[str, ...] = SPECIAL_TOKENS
    rounds: int = 0
    round_sizes: list[int] = field(default_factory=list)

    @property
    def token_to_id(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.vocab)}

    def vocab_df(self, spark: SparkSession) -> DataFrame:
        rows = [(t, i, i < len(self.special_tokens)) for i, t in enumerate(self.vocab)]
        return spark.createDataFrame(rows, "token string, id int, is_special boolean")

    def merges_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r, a, b) for r, (a, b) in enumerate(self.merges)],
                                     "rank int, left string, right string")

    # T-6 / T-7 as column functions
    def _lookup(self, spark: SparkSession, nested: bool):
        bc = spark.sparkContext.broadcast((self.vocab, self.merges, tuple(self.special_tokens)))

        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            codec = _Codec(*bc.value)
            for texts, parts in batches:
                if nested:  # the pieces of a row's texts, by the text's number in the batch
                    ends, given = _row_ends(texts).tolist(), _pieces(parts)
                    pieces = {ends[i] + k: p for i, row in given.items() for k, p in enumerate(row)}
                    yield _relist(texts, codec.encode_texts(texts.flatten(), pieces))
                else:
                    yield codec.encode_texts(texts, _pieces(parts))
        ids = ArrayType(IntegerType())
        return F.arrow_udf(run, ArrayType(ids) if nested else ids)

    def encoder(self, spark: SparkSession):
        """Function of a text column giving its ids. Texts that NFKC may change come in pieces as well."""
        lookup = self._lookup(spark, False)

        def encode(c) -> Column:
            c = col_of(c)
            return lookup(c, _nfkc_parts_udf(tuple(self.special_tokens))(F.when(~c.rlike(_NFKC_STABLE), c)))
        return encode

    def array_encoder(self, spark: SparkSession):
        """As ``encoder``, from an array of texts to an array of id arrays (B-ROW-6)."""
        lookup = self._lookup(spark, True)

        def encode(c) -> Column:
            c = col_of(c)
            stable = F.forall(c, lambda x: x.rlike(_NFKC_STABLE))
            return lookup(c, _nfkc_parts_udf(tuple(self.special_tokens), True)(F.when(~stable, c)))
        return encode

    def decoder(self, spark: SparkSession, skip_special_tokens: bool = False):
        bc = spark.sparkContext.broadcast((self.vocab, tuple(self.special_tokens)))

        @F.arrow_udf(StringType())
        def _decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            dec = _Decoder(*bc.value, skip_special_tokens)
            for rows in batches:
                yield dec.decode_lists(rows)
        return lambda c: _decode(col_of(c))

    def header_ids(self, text: str = "<|im_start|>assistant\n") -> list[int]:
        """Ids of a text of special tokens and ASCII words parted by them (the template's headers)."""
        parts = [p for p in re.split("(" + "|".join(map(re.escape, self.special_tokens)) + ")", text) if p]
        words = [w for p in parts for w in ([p] if p in self.special_tokens else re.findall(r" ?[A-Za-z]+|\s", p))]
        if "".join(words) != text:
            raise ValueError(f"not a plain header: {text!r}")
        return _Codec(self.vocab, self.merges, tuple(self.special_tokens)).words_to_ids(words)

    # T-8
    def files(self) -> dict[str, dict]:
        """The three JSON files by name."""
        tok = {"model": {"type": "BPE", "vocab": self.token_to_id, "merges": [[a, b] for a, b in self.merges]},
               "added_tokens": [{"id": i, "content": t, "special": True} for i, t in enumerate(self.special_tokens)]}
        return {"tokenizer.json": tok, "tokenizer_config.json": TOKENIZER_CONFIG, "special_tokens_map.json": SPECIAL_TOKENS_MAP}

    def save(self, spark: SparkSession, directory: str) -> None:
        """Vocabulary and merges as Parquet, and the JSON files, in a folder on any file system."""
        base = directory.rstrip("/")
        self.vocab_df(spark).coalesce(1).write.mode("overwrite").parquet(f"{base}/vocab")
        self.merges_df(spark).coalesce(1).write.mode("overwrite").parquet(f"{base}/merges")
        for name, content in self.files().items():
            write_file(spark, f"{base}/{name}", json.dumps(content, ensure_ascii=False, indent=None if name == "tokenizer.json" else 4))

    @classmethod
    def load(cls, spark: SparkSession, directory: str) -> "BpeModel":
        """A saved model, from its Parquet tables."""
        base = directory.rstrip("/")
        vocab = spark.read.parquet(f"{base}/vocab").orderBy("id").collect()  # the model's own size
        merges = spark.read.parquet(f"{base}/merges").orderBy("rank").collect()
        return cls([r["token"] for r in vocab], [(r["left"], r["right"]) for r in merges],
                   tuple(r["token"] for r in vocab if r["is_special"]))


    @classmethod
    def from_tokenizer_file(cls, path: str, special_tokens: tuple[str, ...] = SPECIAL_TOKENS, spark: SparkSession | None = None,
                            sha256: str | None = None) -> "BpeModel":
        """The merges of a published byte-level ``tokenizer.json`` under our own special tokens: ids 0.. are
        the special tokens, the file's tokens follow in their order.

        With ``spark`` the path may be on any file system that the session knows; without, it is on the driver. A
        path that is not there raises ``FileNotFoundError``; a file whose content has another
        ``sha256`` than the one asked for, ``ValueError``."""
        if spark is not None:
            raw = read_file(spark, path)
        else:
            with open(path, "rb") as f:
                raw = f.read()
        found = hashlib.sha256(raw).hexdigest()
        if sha256 is not None and found != sha256.lower():
            raise ValueError(f"{path}: content has sha256 {found}, not {sha256}")
        model = json.loads(raw.decode("utf-8"))["model"]
        tokens = sorted(model["vocab"], key=model["vocab"].get)
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls([*special_tokens, *(t for t in tokens if t not in special_tokens)], merges, tuple(special_tokens))


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """One small UTF-8 file through the file system that the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_file(spark: SparkSession, path: str) -> bytes:
    """One small file's bytes, through the file system that the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


class _Codec:
    """Per-task word lookup (small helper behind the UDFs)."""

    WORDS = 300_000  # words remembered; beyond them all are forgotten
    SHORT = 256  # symbols; longer words keep their pairs in a heap
    SIDE_BY_SIDE = 64  # bytes; shorter words are merged many at once
    CHARS = 1 << 22  # bytes of text encoded at once

    def __init__(self, vocab, merges, specials):
        self.tok2id = {t: i for i, t in enumerate(vocab)}
        self.specials = tuple(specials)
        self.special_ids = {t: self.tok2id[t] for t in specials}
        self.ranks, self.made = {}, []  # the rank of a pair of ids, the id that a rank makes
        for r, (a, b) in enumerate(merges):
            self.ranks.setdefault((self.tok2id[a], self.tok2id[b]), r)
            self.made.append(self.tok2id[a + b])
        self.byte_ids = [self.tok2id[c] for c in BYTE_CHARS]
        # the same for arrays: pairs in order as one number each
        self.width = len(vocab)
        order = sorted((a * self.width + b, r) for (a, b), r in self.ranks.items())
        self.pairs = np.array([k for k, _ in order], np.int64)
        self.pair_ranks = np.array([r for _, r in order], np.int32)
        self.made_by = np.array(self.made, np.int32)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # a word's number; where its ids are and how many
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def word(self, w: str) -> tuple[int, ...]:
        return tuple(self._found(pa.array([w], pa.large_string()))[1].tolist())

    def _word(self, w: str) -> tuple[int, ...]:
        if w in self.special_ids:
            return (self.special_ids[w],)
        ids = [self.byte_ids[b] for b in w.encode("utf-8")]
        if len(ids) > self.SHORT:
            return self._long_word(ids)
        ranks, made, none = self.ranks, self.made, len(self.made)
        # the rank of every neighbouring pair, mended where a pair has merged
        places = [ranks.get(p, none) for p in zip(ids, ids[1:])]
        while places and (rank := min(places)) < none:
            while rank in places:  # all of the round's pairs, from left to right
                i = places.index(rank)
                ids[i] = made[rank]
                del ids[i + 1], places[i]
                if i:
                    places[i - 1] = ranks.get((ids[i - 1], ids[i]), none)
                if i < len(places):
                    places[i] = ranks.get((ids[i], ids[i + 1]), none)
        return tuple(ids)

    def _long_word(self, ids: list[int]) -> tuple[int, ...]:
        """As ``_word``, round by round, for a word of many symbols: every round takes the places of its pair off a heap."""
        ranks, end = self.ranks, len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(ranks[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heapify(heap)
        while heap:
            rank, made = heap[0][0], []
            while heap and heap[0][0] == rank:  # from left to right
                _, i = heappop(heap)
                j = after[i]
                found = ranks.get((ids[i], ids[j])) if j < end else None
                if found != rank:  # one of the two has merged since
                    continue
                ids[i], ids[j] = self.made[rank], -1
                after[i] = after[j]
                if after[i] < end:
                    before[after[i]] = i
                    made.append(i)
                if before[i] >= 0:
                    made.append(before[i])
            for i in made:
                found = ranks.get((ids[i], ids[after[i]])) if after[i] < end else None
                if found is not None:
                    heappush(heap, (found, i))
        return tuple(i for i in ids if i >= 0)

    def words_to_ids(self, words) -> list[int]:
        return [i for w in words for i in self.word(w)]

    def _pair_ranks(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the pair that begins at each place; beyond all ranks if it has none. -1 parts words."""
        none = len(self.made)
        if not len(self.pairs):
            return np.full(len(at), none, np.int32)
        left, right = ids[at], ids[at + 1]
        key = left.astype(np.int64) * self.width + right
        k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[k] == key) & (left >= 0) & (right >= 0), self.pair_ranks[k], none)

    def _merged(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word) of ``_word`` for many words at once: a round takes in every word all places of its
        least rank. Every word ends in -1."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ids = np.full(int(sizes.sum()) + len(raw), -1, np.int32)
        owner = np.repeat(np.arange(len(raw)), sizes + 1)
        inside = np.arange(len(ids)) - owner  # its byte, for all places but the -1s
        ends = np.cumsum(sizes + 1) - 1
        body = np.ones(len(ids), bool)
        body[ends] = False
        ids[body] = np.array(self.byte_ids, np.int32)[np.frombuffer(b"".join(raw), np.uint8)[inside[body]]]
        none = len(self.made)
        rank = np.full(len(ids), none, np.int32)
        rank[:-1] = self._pair_ranks(ids, np.arange(len(ids) - 1))
        done = []
        while len(ids):
            ends = np.flatnonzero(ids < 0)
            n = np.diff(ends, prepend=-1)
            least = np.minimum.reduceat(rank, np.append(0, ends[:-1] + 1))
            over = least == none
            if over.any():
                stay = np.repeat(over, n)
                done.append((owner[stay], ids[stay]))
                ids, owner, rank, least, n = ids[~stay], owner[~stay], rank[~stay], least[~over], n[~over]
                if not len(ids):
                    break
            at = np.flatnonzero((rank == np.repeat(least, n)) & (rank < none))
            follows = np.diff(at, prepend=-2) == 1  # of overlapping places every second one, from the first of each run
            if follows.any():
                starts = np.flatnonzero(~follows)
                at = at[(np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))) % 2 == 0]
            ids[at] = self.made_by[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # their places once the right halves are gone
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            around = np.concatenate((moved, moved[moved > 0] - 1))
            rank[around] = self._pair_ranks(ids, around)
        owner, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        owner, ids = owner[order], ids[order]
        return ids[ids >= 0], np.bincount(owner, minlength=len(raw)) - 1

    def _learn(self, fresh: list[str]) -> None:
        raw = [w.encode("utf-8") for w in fresh]
        alone = {i: self._word(w) for i, w in enumerate(fresh) if w in self.special_ids or len(raw[i]) >= self.SIDE_BY_SIDE or not raw[i]}
        many = [i for i in range(len(fresh)) if i not in alone]
        parts = [np.array(x, np.int32) for x in alone.values()]
        sizes = [len(x) for x in parts]
        if many:
            ids, n = self._merged([raw[i] for i in many])
            parts.append(ids)
            sizes = np.concatenate((np.array(sizes, np.int64), n))
        sizes = np.asarray(sizes, np.int64)
        for k, i in enumerate([*alone, *many], len(self.known)):
            self.known[fresh[i]] = k
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.ids = np.concatenate((self.ids, *parts))

    def _found(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids per word, all ids) of words one after the other; every distinct word is looked up once."""
        words = words.dictionary_encode()
        at = words.indices.to_numpy(zero_copy_only=False)
        spelled = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > self.WORDS:
            self._forget()
        fresh = [w for w in spelled if w not in self.known]
        if fresh:
            self._learn(fresh)
        slots = np.fromiter(map(self.known.__getitem__, spelled), np.int64, len(spelled))
        n = self.sizes[slots][at]
        return n, self.ids[_spans(self.starts[slots][at], n)]

    def encode_lists(self, rows: pa.ListArray) -> pa.ListArray:
        """Rows of words to rows of ids."""
        n, ids = self._found(rows.flatten())
        ends = np.concatenate(([0], np.cumsum(n)))
        return _lists(ends[_row_ends(rows)], pa.array(ids), rows)

    def encode_texts(self, texts: pa.Array, pieces: dict[int, list[str]] | None = None) -> pa.ListArray:
        """Texts to rows of ids, null for null (``pieces`` as in ``pretokens.words``)."""
        pieces = pieces or {}
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // self.CHARS, prepend=0)).tolist()  # a text that ends a stretch
        ends, ids = [np.zeros(1, np.int64)], []
        for a, b in zip([0, *(c + 1 for c in cuts)], [*(c + 1 for c in cuts), len(texts)]):
            if a < b:
                words, at = pretokens.words(texts.slice(a, b - a), self.specials, {i - a: p for i, p in pieces.items() if a <= i < b})
                n, found = self._found(words)
                ends.append(ends[-1][-1] + np.concatenate(([0], np.cumsum(n)))[at[1:]])
                ids.append(found)
        return _lists(np.concatenate(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)), texts)


class _Decoder:
    """Per-task bytes of every id (small helper behind the UDF)."""

    def __init__(self, vocab, specials, skip_special_tokens: bool):
        byte = {c: bytes([b]) for b, c in enumerate(BYTE_CHARS)}
        special = set(specials)
        spelled = [(b"" if skip_special_tokens else t.encode("utf-8")) if t in special
                   else b"".join(byte[c] for c in t) if all(c in byte for c in t) else None for t in vocab]
        self.unknown = np.array([x is None for x in spelled], dtype=bool)  # no byte symbols: an error where used
        self.pieces = pa.array([x or b"" for x in spelled], pa.large_binary())

    def decode_lists(self, rows: pa.ListArray) -> pa.Array:
        flat = rows.flatten()
        if flat.null_count:
            raise ValueError("a null among the ids")
        ids = flat.to_numpy(zero_copy_only=False)
        if len(ids) and self.unknown[ids].any():
            raise KeyError(f"id {ids[self.unknown[ids]][0]} is not spelled in byte symbols")
        if not len(ids):
            return pa.array([None if x else "" for x in rows.is_null().to_pylist()], pa.string())
        spelled = self.pieces.take(flat)
        _, at, data = spelled.buffers()
        data = bytes(data or b"")
        ends = np.frombuffer(at, np.int64)[:len(ids) + 1][_row_ends(rows)].tolist()
        null = rows.is_null().to_pylist()
        return pa.array([None if x else data[a:b].decode("utf-8", errors="replace") for a, b, x in zip(ends, ends[1:], null)], pa.string())


def _pieces(parts: pa.Array) -> dict[int, list]:
    """The rows that are not null, by number."""
    at = np.flatnonzero(parts.is_valid().to_numpy(zero_copy_only=False))
    return dict(zip(at.tolist(), parts.take(pa.array(at)).to_pylist())) if len(at) else {}


def _row_ends(rows: pa.ListArray) -> np.ndarray:
    """Where the rows begin and end in ``rows.flatten()``, from 0; a null row is empty."""
    n = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate(([0], np.cumsum(n)))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions ``start .. start + size - 1`` of all spans, one span after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _lists(ends: np.ndarray, values: pa.Array, like: pa.ListArray) -> pa.ListArray:
    """Lists of ``values``, null where ``like`` is."""
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values, mask=like.is_null() if like.null_count else None)


def _relist(rows: pa.ListArray, values: pa.Array) -> pa.ListArray:
    """``values``, one for each item of the rows' lists, in lists as the rows'."""
    return _lists(_row_ends(rows), values, rows)


# ---------------------------------------------------------------- T-5
def train_bpe(df: DataFrame, text: str = "text", vocab_size: int = 6144, min_frequency: int = 2,
              special_tokens: tuple[str, ...] = SPECIAL_TOKENS, candidates: int = 256, exact: bool = True,
              checkpoint_every: int = 4, word_table: DataFrame | None = None, log_dir: str | None = None,
              stop_after: int | None = None) -> BpeModel:
    """T-5: train a byte-level BPE model on the ``text`` column (see ``bpe_training``).

    ``exact=False`` accepts every symbol-disjoint pair of the top-K in a round without proof (fewer
    rounds; merges may then differ from the one-at-a-time order). Special tokens take ids 0..4 in
    the listed order and are verified. ``log_dir`` makes the job resumable; ``stop_after`` ends it after
    so many rounds.
    """
    from quire.operators import bpe_training
    vocab = list(special_tokens) + ALPHABET
    for i, t in enumerate(special_tokens):
        if vocab.index(t) != i:
            raise ValueError(f"special token {t!r} must have id {i}")
    wc = word_table if word_table is not None else word_counts(df, text)
    vocab, merges, sizes = bpe_training.train(wc, vocab, BYTE_IDS, vocab_size, min_frequency, candidates, exact, checkpoint_every,
                                              log_dir, stop_after)
    return BpeModel(vocab, merges, tuple(special_tokens), len(sizes), sizes)


# ---------------------------------------------------------------- Q-1, Q-2, Q-3
def roundtrip_report(df: DataFrame, model: BpeModel, text: str = "text", group: list[str] | None = None,
                     max_length: int | None = None) -> DataFrame:
    """Q-1: share of rows with ``decode(encode(x)) == x``, over whole texts.

    ``max_length`` cuts the ids first, as a model's input is cut; cut texts then
    compare unequal.
    """
    spark = df.sparkSession
    enc, dec = model.encoder(spark), model.decoder(spark)
    ids = enc(F.col(text))
    staged = df.withColumn("_ids", ids if max_length is None else F.slice(ids, 1, max_length))
    ok = (dec(F.col("_ids")) == F.col(text)).cast("double")
    out = staged.withColumn("_ok", ok)
    aggs = [F.avg("_ok").alias("roundtrip_rate"), F.count(F.lit(1)).alias("n")]
    return out.groupBy(*group).agg(*aggs) if group else out.agg(*aggs)


def special_tokens_preserved(df: DataFrame, model: BpeModel, text: str = "text") -> DataFrame:
    """Q-2: among texts that spell a special token, how many decode back unchanged."""
    spark = df.sparkSession
    enc, dec = model.encoder(spark), model.decoder(spark)
    cond = F.lit(False)
    for s in model.special_tokens:
        cond = cond | F.col(text).contains(s)
    sub = df.filter(cond)
    same = (dec(enc(F.col(text))) == F.col(text)).cast("int")
    return sub.agg(F.count(F.lit(1)).alias("n_with_special"), F.coalesce(F.sum(same), F.lit(0)).alias("n_preserved"))


def vocab_usage(encoded: DataFrame, vocab: DataFrame, ids: str = "ids") -> DataFrame:
    """Q-3: per vocabulary id its special flag and how often the encoded corpus uses it (0 if never).

    An id that the corpus uses but the vocabulary lacks has a row of its own,
    with a null token. The usage counts are a partial aggregation; the
    vocabulary side is bounded by the vocabulary size.
    """
    # the outer form with its empty rows dropped: for the inner one Spark adds a filter on the ids, which encodes all texts again
    each = encoded.select(F.explode_outer(F.transform(ids, lambda i: F.struct(i.alias("id")))).alias("x")).where("x is not null")
    uses = each.groupBy(F.col("x.id").alias("id")).agg(F.count(F.lit(1)).alias("uses"))
    return (vocab.join(uses, "id", "full_outer")
            .select("id", "token", "is_special", F.coalesce("uses", F.lit(0)).cast("bigint").alias("uses")))
