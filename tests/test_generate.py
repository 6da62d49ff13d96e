"""Next-token table against plain-Python counts; context keys."""

import math
from collections import Counter, defaultdict

import pytest

from quire.operators import generate as G

SEQS = [[1, 2, 3, 2, 3, 4], [1, 2, 4, 2, 3, 3], [5, 2, 3, 9], [1, 5, 2, 9], [2, 2, 2, 3]]


def py_table():
    c = Counter((s[i - 1], s[i]) for s in SEQS for i in range(1, len(s)))
    tot = Counter()
    for (a, _), n in c.items():
        tot[a] += n
    t = defaultdict(list)
    for (a, b), n in c.items():
        t[a].append((b, math.log(n / tot[a]), n))
    return t


def test_next_token_table(spark):
    df = spark.createDataFrame([(s,) for s in SEQS], "ids array<int>")
    got = {(r.context[0], r.next): (r.cnt, round(r.logprob, 12)) for r in G.next_token_table(df, "ids", 1).collect()}
    want = {(a, b): (n, round(lp, 12)) for a, lst in py_table().items() for b, lp, n in lst}
    assert got == want


def test_context_keys_tell_lengths_and_ids_apart(spark):
    rows = [([5],), ([0, 5],), ([7, 0, 5],), ([],), ([G.ID_MAX],)]
    df = spark.createDataFrame(rows, "ids array<int>").withColumn("k", G.context_key("ids", 2))
    got = {tuple(r.ids): r.k for r in df.collect()}
    assert got[(5,)] != got[(0, 5)] == got[(7, 0, 5)] and len(set(got.values())) == 4
    back = df.select("ids", G.unpack_context("k", 2).alias("c")).where("size(ids) > 1")
    assert all(r.c == r.ids[-2:] for r in back.collect())


def test_ids_out_of_range_stop_the_job(spark):
    for ids in ([1, G.ID_MAX + 1, 2], [-1, 3]):
        with pytest.raises(Exception, match="token id outside"):
            G.next_token_table(spark.createDataFrame([(ids,)], "ids array<int>"), "ids", 1).collect()
