"""T-2 on whole Arrow batches: the words of the byte-level splitter, found by arrays of character classes.

``words`` cuts texts as ``tokenizer.pretokenize`` does on the JVM, with special tokens as words of their
own. The pattern needs no search: words are runs of one class (letters, numbers, white space, others); the
last white space before a word stands alone or, if it is a blank, goes to the word; an apostrophe that begins
a word takes its contraction. Letters and numbers are Unicode categories, of Python's Unicode version here.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ENDINGS = {1: [ord(c) for c in "stmd"], 2: [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]}


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    of = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((of.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[_WHITE] = _SPACE
    return table


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which code points begin a word; ``first`` marks those that begin a stretch, which no word crosses."""
    kind = _classes()[points]
    new = first.copy()
    new[1:] |= kind[1:] != kind[:-1]
    starts = new.copy()
    last = np.flatnonzero(new[1:] & ~first[1:] & (kind[:-1] == _SPACE))  # white space, before something else
    starts[last] = True
    starts[last[points[last] == 0x20] + 1] = False
    q = np.flatnonzero(points[:-1] == 0x27)
    q = q[starts[q] & new[q + 1] & ~first[q + 1]]
    if len(q):
        one, two = points[q + 1], points[np.minimum(q + 2, len(points) - 1)]
        inside = (q + 2 < len(points)) & ~first[np.minimum(q + 2, len(points) - 1)]
        pair = np.zeros(len(q), bool)
        for a, b in _ENDINGS[2]:
            pair |= (one == a) & (two == b) & inside
        end = q + 1 + np.where(np.isin(one, _ENDINGS[1]), 1, np.where(pair, 2, 0))
        hit = end > q + 1
        starts[q[hit] + 1] = False
        end = end[hit]
        starts[end[end < len(points)]] = True
    return starts


@lru_cache(8)
def special_pattern(specials: tuple[str, ...]) -> re.Pattern | None:
    return re.compile("|".join(re.escape(t) for t in sorted(specials, key=len, reverse=True))) if specials else None


def words(texts: pa.Array, specials: tuple[str, ...] = (), pieces: dict[int, list[str]] | None = None) -> tuple[pa.Array, np.ndarray]:
    """(all words, where each text's words begin and end among them). A null text has none.

    ``pieces``: for some texts, by number, the pieces that they were cut into already; a piece that is a special
    token is a word of its own, and other texts are cut at special tokens here.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    pieces = pieces or {}
    if pieces:
        texts = pa.array(["".join(pieces[i]) if i in pieces else t for i, t in enumerate(texts.to_pylist())], pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = bytes(texts.buffers()[2] or b"")[ends[0]:ends[-1]] if len(texts) else b""
    ends = ends - ends[:1] if len(texts) else np.zeros(1, np.int64)
    if not raw:
        return pa.array([], pa.large_string()), np.zeros(len(texts) + 1, np.int64)
    text = raw.decode("utf-8")
    if len(text) == len(raw):
        points, at = np.frombuffer(raw, np.uint8), None
    else:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        at = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # the byte where each code point begins
        ends = np.searchsorted(at, ends)
    first = np.zeros(len(points) + 1, bool)
    first[ends] = True
    whole = []  # the special tokens' places
    pattern = special_pattern(specials)
    if pieces or pattern and pattern.search(text):
        bounds = ends.tolist()
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if i in pieces:
                for p in pieces[i]:
                    first[a] = True
                    if p in specials:
                        whole.append((a, a + len(p)))
                    a += len(p)
            elif pattern:
                whole += [m.span() for m in pattern.finditer(text, a, b)]
    if whole:
        a, b = np.array(whole, np.int64).T
        first[a] = first[b] = True
    starts = word_starts(points, first[:-1])
    if whole:
        n = b - a - 1
        starts[np.repeat(a + 1 - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = False
    begin = np.flatnonzero(starts)
    offsets = np.append(begin if at is None else at[begin], len(raw)).astype(np.int64)
    return (pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(raw)), np.searchsorted(begin, ends))
