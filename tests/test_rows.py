"""Training rows, masks, batches and logits: FIXTURES.md cases plus randomised
comparisons with plain-Python restatements of the rules (written here)."""

import math
import random

from pyspark.sql import functions as F

from quire.functions import ids as I
from quire.functions import logits as L
from quire.operators import logits as LO
from quire.operators import rows as B
from quire.operators import split as S


def py_assistant_mask(ids, header, eos):
    """The rule, position by position: p is marked if a header ends at or before p, no eos lies
    between that header's end and p, and an eos stands at p or later."""
    ends = [e for e in range(len(header), len(ids) + 1) if ids[e - len(header):e] == header]
    return [int(any(e <= p and eos not in ids[e:p] for e in ends) and eos in ids[p:]) for p in range(len(ids))]


def test_pad_mask_shift(spark):
    df = spark.createDataFrame([([3, 9, 8],)], "ids array<int>")
    p = df.select(I.pad_ids("ids", 6, 4).alias("p"), I.length_mask("ids", 6).alias("m")).first()
    assert p.p == [3, 9, 8, 4, 4, 4] and p.m == [1, 1, 1, 0, 0, 0]
    x, y, m = I.shift(F.array(*map(F.lit, p.p)), F.array(*map(F.lit, p.m)))
    r = df.select(x.alias("x"), y.alias("y"), m.alias("m")).first()
    assert (r.x, r.y, r.m) == ([3, 9, 8, 4, 4], [9, 8, 4, 4, 4], [1, 1, 0, 0, 0])


def test_assistant_mask_fixtures(spark):
    cases = [([3, 9, 8, 5, 4, 8, 3, 7, 8, 5, 6, 4, 8, 4, 4], [0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 0, 0, 0]),
             ([3, 7, 8, 5, 6], [0, 0, 0, 0, 0]),
             ([3, 7, 8, 5, 6, 4, 4], [0, 0, 0, 1, 1, 1, 0]),
             ([3, 7, 8, 4], [0, 0, 0, 1]),
             ([3, 7, 8, 5, 3, 7, 8, 6, 4], [0, 0, 0, 1, 1, 1, 1, 1, 1])]
    df = spark.createDataFrame([(c, w) for c, w in cases], "ids array<int>, want array<int>")
    for r in df.select(I.assistant_mask("ids", [3, 7, 8], 4).alias("got"), "want").collect():
        assert r.got == r.want


def test_assistant_mask_random(spark):
    random.seed(7)
    header = [3, 7, 8]
    data = []
    for _ in range(600):
        n = random.randint(0, 40)
        seq = [random.choice([3, 7, 8, 4, 5, 6, 9]) for _ in range(n)]
        for _ in range(random.randint(0, 3)):
            if n > 3:
                k = random.randint(0, n - 3)
                seq[k:k + 3] = header
        data.append((seq,))
    df = spark.createDataFrame(data, "ids array<int>")
    for r in df.select("ids", I.assistant_mask("ids", header, 4).alias("m")).collect():
        assert r.m == py_assistant_mask(list(r.ids), header, 4), r.ids


def test_sft_rows_codepoint_shapes(spark):
    msgs = [("system", "s"), ("user", "hi"), ("assistant", "ok")]
    df = spark.createDataFrame([(1, msgs)], "id int, messages array<struct<role:string,content:string>>")
    r = B.sft_rows(df, "messages", I.codepoint_ids, None, 64, keep=["id"]).first()
    assert len(r.X) == len(r.Y) == len(r.loss_mask) == 63
    # the answer "ok" and its eos are trained on (shifted by one)
    full = list(r.X) + [r.Y[-1]]
    h = I.codepoint_header()
    start = next(i for i in range(len(full)) if full[i:i + len(h)] == h) + len(h)
    assert r.loss_mask[start - 1:start + 2] == [1, 1, 1] and sum(r.loss_mask) >= 3


def test_left_pad_pack(spark):
    df = spark.createDataFrame([(0, [5, 6, 4], [True, True, False]), (0, [7, 8, 9], [True, True, True]),
                                (1, [1, 2], [True, True])], "batch_id int, ids array<int>, mask array<boolean>")
    out = {tuple(r.ids0): (r.ids, r.mask) for r in
           B.left_pad_pack(df.withColumn("ids0", F.col("ids")), "ids", "mask", "batch_id", 4).collect()}
    assert out[(5, 6, 4)] == ([4, 5, 6], [False, True, True])
    assert out[(7, 8, 9)] == ([7, 8, 9], [True, True, True])
    assert out[(1, 2)] == ([1, 2], [True, True])  # all-true batch unchanged


def test_stop_fill_topk_greedy(spark):
    df = spark.createDataFrame([([1, 9, 7, 8], [1.0, 3.0, 2.0, 2.0])], "ids array<int>, l array<double>")
    r = df.select(I.stop_fill("ids", 9, 4).alias("a"), I.stop_fill(F.array(*map(F.lit, [1, 4, 7])), 4, 4).alias("b"),
                  L.topk_filter("l", 2).alias("t"), L.greedy_next(F.array(*map(F.lit, [1.0, 3.0, 3.0]))).alias("g")).first()
    assert r.a == [1, 9, 4, 4] and r.b == [1, 4, 4]
    assert r.t == [float("-inf"), 3.0, 2.0, 2.0] and r.g == 1


def test_cross_entropy_rules(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], 1), (0, [0.0] * 5, 4), (1, [1.0, 2.0], 1), (1, [0.0, 0.0], -100)],
                               "batch_id int, logits array<double>, target int")
    out = LO.token_cross_entropy(df, "logits", "target", "batch_id", pad_id=4).collect()
    got = sorted((r.batch_id, r.target, round(r.xent, 9)) for r in out)
    # batch 1 holds a -100 target, so -100 is ignored there and the pad id is not
    assert got == sorted([(0, 1, round(math.log(2), 9)), (0, 4, 0.0),
                          (1, 1, round(math.log(math.exp(1) + math.exp(2)) - 2, 9)), (1, -100, 0.0)])


def test_softmax_and_sample(spark):
    df = spark.createDataFrame([(i, [0.1 * i, 1.0, -2.0, 0.5]) for i in range(50)], "id int, l array<double>")
    r = df.select("l", L.softmax("l").alias("p"), L.seeded_sample("l", 1.0, 2, 42, F.col("id")).alias("s")).collect()
    assert all(abs(sum(x.p) - 1.0) < 1e-12 for x in r)
    for x in r:  # the draw lands on a logit kept by the top-2 filter (ties with the 2nd kept)
        thr = sorted(x.l, reverse=True)[1]
        assert x.l[x.s] >= thr


def test_lr_schedule(spark):
    df = spark.createDataFrame([(0,), (50,), (100,), (101,)], "it int")
    got = [round(r.lr, 12) for r in df.select(S.lr_at("it", F.lit(100), 2e-4, 0).alias("lr")).collect()]
    assert got == [2e-4, 1.1e-4, 2e-5, 2e-5]


def test_eval_size_and_batches(spark):
    assert [S.eval_size(n) for n in (5, 10, 75, 320, 1000)] == [1, 1, 7, 32, 32]
    df = spark.range(130).withColumnRenamed("id", "k")
    b = S.assign_batches(df, ["k"], 64, num_partitions=5)
    sizes = sorted((r.batch_id, r["count"]) for r in b.groupBy("batch_id").count().collect())
    assert sizes == [(0, 64), (1, 64), (2, 2)]
    assert all(r.batch_id == r.k // 64 and r.pos_in_batch == r.k % 64 for r in b.collect())


def test_global_index_matches_sort(spark):
    random.seed(11)
    keys = random.sample(range(10 ** 6), 3000)
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r.idx for r in S.with_global_index(df, ["k"], "idx", num_partitions=7).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_exact_split_is_partition(spark):
    df = spark.range(75).withColumnRenamed("id", "doc_id")
    sp = S.exact_split(df, "doc_id", 42, 32)
    assert sp.filter(F.col("split") == "test").count() == 7
    v = S.split_is_partition(df, sp.filter("split = 'train'"), sp.filter("split = 'test'"), "doc_id").collect()
    assert all(r.violations == 0 for r in v)


def test_rows_from_turns_equal_rows_from_whole_conversations(spark):
    from quire.operators import reshape as R
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(600)]
    turns += [(2, t, ["system", "user", "assistant"][t % 3], "x" * (t % 7)) for t in range(300)]
    turns += [(3, 0, "tool", "only unknown roles"), (4, 0, "user", None), (4, 1, "assistant", "")]
    long = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    full = R.collect_messages(long, sender_map={"user": "human"})
    cols = ["conv_id", "n_tokens", "text_len", "dropped_turns", "X", "Y", "loss_mask"]
    a = sorted(B.sft_rows(full, keep=["conv_id", "dropped_turns"]).select(cols).collect())
    b = sorted(B.sft_rows_from_turns(long, sender_map={"user": "human"}).select(cols).collect())
    assert a == b and a[0].n_tokens == 8608 and [r.dropped_turns for r in a] == [0, 100, 1, 0]


def test_left_pad_pack_with_absent_masks(spark):
    df = spark.createDataFrame([(0, [5, 6], None), (0, [7], None), (1, [1, 2, 3], [True, False, True]), (1, [4], None)],
                               "batch_id int, ids array<int>, mask array<boolean>")
    got = sorted((r.batch_id, r.ids, r.mask) for r in B.left_pad_pack(df, pad_id=4).collect())
    assert got == [(0, [5, 6], [True, True]), (0, [7], [True]), (1, [1, 3], [True, True]), (1, [4, 4], [False, True])]


def test_exact_split_with_repeated_and_null_ids(spark):
    ids = [i for i in range(20) for _ in range(1 + i % 3)] + [None, None]
    sp = S.exact_split(spark.createDataFrame([(i,) for i in ids], "doc_id int"), "doc_id", 42, 32).collect()
    assert sorted(str(r.doc_id) for r in sp) == sorted(map(str, ids))
    test = {r.doc_id for r in sp if r.split == "test"}
    assert len(test) == 2 and not test & {r.doc_id for r in sp if r.split == "train"}


def test_global_index_carries_other_columns_and_nulls(spark):
    df = spark.createDataFrame([(k, k % 7, "x" * k) for k in range(50)] + [(None, 1, "n")], "k long, j long, t string")
    got = {r.k: (r.idx, r.t) for r in S.with_global_index(df, ["k"], "idx", num_partitions=5).collect()}
    assert got == {None: (0, "n"), **{k: (k + 1, "x" * k) for k in range(50)}}


def test_positions_with_repeated_keys_nulls_memory_and_joined_tables(spark):
    import pandas as pd
    rows = [("a", 1), ("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)] + [("hot", k) for k in range(400)]
    memory = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "v"]))
    joined = memory.alias("l").join(spark.range(3).withColumnRenamed("id", "n"), F.lit(True), "cross")
    for df, times in ((memory, 1), (joined, 3), (memory.limit(4), 1), (memory.limit(0), 1)):
        want = sorted(("" if r.k is None else r.k) for r in df.collect())
        got = S.with_global_index(df, ["k"]).collect()
        assert sorted(r.idx for r in got) == list(range(len(want)))
        assert [("" if r.k is None else r.k) for r in sorted(got, key=lambda r: r.idx)] == want
        b = S.assign_batches(df, ["k"], 4).collect()
        assert sorted((r.batch_id, r.pos_in_batch) for r in b) == [(i // 4, i % 4) for i in range(len(want))]
    four = spark.createDataFrame([("x", "q1"), ("x", "q2"), ("x", "q3"), ("y", "q4")], "k string, _idx string")
    from quire.operators import reshape as R
    numbered = sorted((r.number, r.k, r._idx) for r in R.number_rows(four, ["k"]).collect())
    assert [(n, k) for n, k, _ in numbered] == [(1, "x"), (2, "x"), (3, "x"), (4, "y")]
    assert sorted(q for *_, q in numbered) == ["q1", "q2", "q3", "q4"]


def test_a_hot_key_is_spread_over_many_ranges_and_ranges_are_bounded(spark):
    from quire.operators import split
    df = spark.range(4000).select(F.lit("hot").alias("k"), "id")
    assert sorted(r.idx for r in S.with_global_index(df, ["k"], num_partitions=8).collect()) == list(range(4000))
    spread = (df.withColumn("_id", F.monotonically_increasing_id()).repartitionByRange(8, "k", "_id")
              .groupBy(F.spark_partition_id()).count().collect())
    assert len(spread) == 8 and max(r["count"] for r in spread) < 1500
    assert split.index_partitions(0, 200) == 1 and split.index_partitions(5, 200) == 5
    assert split.index_partitions(10 ** 9, 200) == 954 and split.index_partitions(10 ** 15, 200) == split.MAX_INDEX_PARTITIONS
