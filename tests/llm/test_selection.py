"""Importance resampling, substring dedup and the conversation trie: brute force, edge rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import resampling, substrings, trie


# ------------------------------------------------------------------ importance resampling
def brute_words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def brute_draw(docs, target, percent, least, buckets, longest=1):
    def feats(t):
        w = brute_words(t)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in feats(x)), Counter(b for x in target for b in feats(x))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (S + buckets)) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for k, (i, x) in enumerate(docs):
        f = feats(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(brute_words(x)), k))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    place = {r[5]: n + 1 for n, r in enumerate(able[:len(able) * percent // 100])}
    return sorted(((*r[:4], place.get(r[5])) for r in rows), key=str)


@pytest.mark.parametrize("last,longest", [(1, 1), (4096, 2)])
def test_draws_match_brute_force(spark, last, longest):
    rnd = random.Random(11)
    vocab = ["Éa", "b", "C3", "dd", "ee", "日本"] + [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(0, 30)))) for i in rnd.sample(range(-500, 5000), 700)]
    docs += [(5001 + i, "same words here " * 7) for i in range(30)]
    target = [" ".join(rnd.choices(vocab[:10], k=12)) for _ in range(20)]
    src = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    tgt = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resample(src, tgt, percent=23, least_words=10, buckets=97, longest=longest, last=last).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_draw(docs, target, 23, 10, 97, longest)


def test_draw_edges(spark, odd, none):
    tgt = spark.createDataFrame([("plain words",), (None,)], "text string")
    rows = resampling.resample(odd, tgt, percent=100, least_words=1).collect()
    assert len(rows) == odd.count() and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, sum(r.n_features > 0 for r in rows) + 1))
    assert all(r.weight == 0 and r["rank"] is None for r in rows if r.n_features == 0)
    assert resampling.resample(none, tgt).count() == 0
    assert all(r["rank"] is None for r in resampling.resample(odd, tgt.limit(0), percent=0).collect())


def test_cutoff_is_exact_and_rounds_discard_a_quarter(spark):
    rnd = random.Random(3)
    scores = [rnd.choice([rnd.randint(0, 50), rnd.randint(0, 10 ** 6)]) for _ in range(6000)] + [7] * 3000
    rows = spark.createDataFrame([(i if i % 9 else None, s, i) for i, s in enumerate(scores)], "id long, score long, row long").repartition(9)
    keys = rows.select(*resampling.draw_key()).checkpoint()
    order = sorted((-s, i % 9 == 0, i if i % 9 else 0, i) for i, s in enumerate(scores))
    for k in (1, 2, 4000, 6001, 8999, 9000):
        stats = {}
        assert tuple(resampling.cutoff_key(keys, k, last=1, stats=stats)) == order[k - 1]
        assert stats["rounds"] <= math.log(9000) / math.log(4 / 3) + 1
    assert resampling.cutoff_key(keys, 0) is None and resampling.cutoff_key(keys, 9001) is None


# ------------------------------------------------------------------ substring dedup
def brute_kept(docs, k):
    """docs: (id or None, text) -> sorted (id, n_words, kept)."""
    split = [(i, (t or "").encode().split()) for i, t in docs]
    rank = lambda i: math.inf if i is None else i
    least = {}
    for i, w in split:
        for j in range(len(w) - k + 1):
            g = tuple(w[j:j + k])
            least[g] = min(least.get(g, math.inf), rank(i))
    out = []
    for i, w in split:
        stay = [True] * len(w)
        for j in range(len(w) - k + 1):
            if least[tuple(w[j:j + k])] < rank(i):
                stay[j:j + k] = [False] * k
        out.append((i, len(w), b" ".join(x for x, y in zip(w, stay) if y).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,k", [(1, 13), (2, 5), (3, 6)])
def test_removal_matches_brute_force(spark, seed, k):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(rnd.choice([3, 30]))] + ["é", "x\x0bY", "Ǆ"]
    passages = [" ".join(rnd.choices(vocab, k=rnd.randint(k - 2, 4 * k))) for _ in range(6)]
    docs = []
    for i in rnd.sample(range(1000), 150):
        parts = [rnd.choice([rnd.choice(passages), " ".join(rnd.choices(vocab, k=rnd.randint(0, 20))), "\n", "  \t"]) for _ in range(rnd.randint(0, 6))]
        docs.append((i, " ".join(parts)))
    docs += [(docs[0][0], docs[0][1]), (docs[3][0], docs[4][1]), (None, passages[0]), (None, passages[0]), (2000, None), (2001, "a " * 300), (2002, "a " * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = substrings.remove_repeats(df, k=k, batch_docs=20).collect()
    assert sorted(((r.doc_id, r.n_words, r.kept) for r in got), key=str) == brute_kept(docs, k)
    assert all(r.n_removed == r.n_words - len(r.kept.split()) and (r.n_spans > 0) == (r.n_removed > 0) for r in got)


def test_paths_span_several_sources(spark):
    """A passage whose halves have different first documents is one path."""
    w = [f"p{i}" for i in range(40)]
    docs = [(1, " ".join(w[:25])), (2, " ".join(w[13:])), (3, " ".join(["u", *w, "v"]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.remove_repeats(df, k=13).collect()}
    assert got[3].kept == "u v" and got[3].n_removed == 40 and got[1].n_removed == 0 and got[2].n_removed == 0
    _, spans = substrings.repeated_spans(df, k=13)
    rows = spans.collect()
    assert {r.n for r in rows} and all(r.path is not None for r in rows) and sum(r.n - 12 for r in rows) == 28


def test_substrings_edges(spark, odd, none):
    rows = substrings.remove_repeats(odd).collect()
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(((r.doc_id, r.n_words, r.kept) for r in rows), key=str) == brute_kept(docs, 13)
    assert substrings.remove_repeats(none).count() == 0


def test_word_hashes_do_not_depend_on_pieces():
    import numpy as np
    rnd = random.Random(4)
    text = "".join(rnd.choice(["a", "bc", "é", " ", "\n", "\x0b", "long" * 9]) for _ in range(3000)).encode()
    cuts = sorted(rnd.sample([i for i in range(len(text) + 1) if i == len(text) or text[i] & 0xC0 != 0x80], 20))
    offsets = np.array([0, *cuts, len(text)])
    data = np.frombuffer(text, np.uint8)
    h, doc = substrings.word_hashes(data, offsets)
    small, again = substrings.word_hashes(data, offsets, piece=7)
    assert (h == small).all() and (doc == again).all()
    words = [(d, w) for d, (a, b) in enumerate(zip(offsets, offsets[1:])) for w in text[a:b].split()]
    assert [d for d, _ in words] == doc.tolist()
    names = defaultdict(set)
    for (_, w), x in zip(words, h.tolist()):
        names[w].add(x)
    assert all(len(x) == 1 for x in names.values()) and len({x for v in names.values() for x in v}) == len(names)


# ------------------------------------------------------------------ conversation trie
def brute_trie(turns):
    """turns: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, n, r, t in turns:
        if c is not None:
            r, t = r or "", t or ""
            own[c].append((n is not None, n or 0, hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest(), (r, t)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    kids = Counter(p[:-1] for p in members if p)
    rows = []
    for p, m in members.items():
        under = [q for q in members if q[:len(p)] == p]
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], sum(kids[q] == 0 for q in under),
                     sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q),
                     hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()))
    return sorted(rows, key=str)


TURNS = "conv_id long, turn long, role string, text string"


def test_trie_matches_brute_force(spark):
    rnd = random.Random(13)
    turns = []
    for c in [*rnd.sample(range(-150, 700), 120), 0, 100, 200]:
        n = rnd.randint(0, 7)
        turns += [(c, rnd.choice([k, k, None]), rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "é", "", None, "long text"])) for k in range(n)]
    turns += [(300, k, "user", f"turn {k}") for k in range(60)] + [(306, k, "user", f"turn {k}") for k in range(50)]  # long unary chains
    turns += [turns[0], turns[0], (None, 0, "user", "nobody's")]
    df = spark.createDataFrame(turns, TURNS).repartition(5)
    assert sorted((tuple(r) for r in trie.conversation_trie(df).collect()), key=str) == brute_trie(turns)


def test_prefix_names_do_not_depend_on_blocks(spark):
    turns = spark.createDataFrame([(c, d, bytes([d % 3, c % 2])) for c in range(4) for d in range(1, 30)], "c long, depth long, digest binary") \
        .withColumn("chars", F.lit(1).cast("long"))
    convs = turns.groupBy("c").agg(F.count("*").alias("n"))
    a, b = (sorted(map(tuple, trie.memberships(turns, convs, k).select("c", "depth", "k1", "k2", "p1", "p2").collect()), key=str) for k in (4, 4096))
    assert a == b and len({x[2:4] for x in a}) == 2 * 29 + 1


@pytest.mark.parametrize("shape", ["chain", "star", "random", "forest"])
def test_contraction_gives_subtree_totals(spark, shape):
    rnd = random.Random(5)
    n = 300
    parent = {"chain": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: rnd.randrange(max(0, i - 20), i), "forest": lambda i: rnd.choice([None, rnd.randrange(i)])}[shape]
    rows = [(0, None, 5, 1)] + [(i, parent(i), rnd.randint(0, 9), 1) for i in range(1, n)]
    stats = {}
    got = trie.subtree_totals(spark.createDataFrame(rows, "id long, parent long, x long, y long"), ["x", "y"], stats=stats).collect()
    total = {i: [x, y] for i, _, x, y in rows}
    for i, p, _, _ in reversed(rows):
        if p is not None:
            total[p] = [a + b for a, b in zip(total[p], total[i])]
    assert {r.id: [r.x, r.y] for r in got} == total and len(got) == n
    assert stats["rounds"] <= 30  # a chain of 300 falls by a share a round


def test_trie_edges(spark):
    empty = spark.createDataFrame([], TURNS)
    assert trie.conversation_trie(empty).count() == 0
    clash = spark.createDataFrame([(1, 0, "user", "a", "x", "x", "x")], TURNS + ", c string, at string, id string")
    assert len(trie.conversation_trie(clash).collect()) in (1, 2)
    assert trie.conversation_trie(spark.createDataFrame([(None, 0, "user", "a")], TURNS)).count() == 0
