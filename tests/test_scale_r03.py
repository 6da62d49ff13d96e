"""What the queries of the third round's findings hold in a row, encode and read; each built on rows of its own."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions.ids import SPECIAL_TOKENS
from quire.operators import rows as B
from quire.operators import tokenizer as TK
from quire.plans import all_queries

TEXTS = ["Hello world, <|im_start|>it is", "", None, "ａ1 ﬁne " * 90, "été <s></s><<|im_end|>\n\n  x"]


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Tables as folders of several files, with nulls and an empty text."""
    d = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, "en" if i % 2 else None, "web", t) for i, t in enumerate(TEXTS * 3)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").repartition(3).write.parquet(f"{d}/documents.parquet")
    turns = [(c, t, ("user", "assistant")[t % 2], f"text {c} of {t}") for c in range(7) for t in range(c)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(3).write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.mark.parametrize("name", ["bpe_segment_rows", "bpe_sft_answers", "bpe_pretrain_rows"])
def test_rows_that_wait_for_the_decoder_hold_no_padding(spark, tables, name):
    evals = [x for x in executed(all_queries()[name](spark, tables)) if "ArrowEvalPython" in x]
    assert len(evals) >= 4 and not [x for x in evals if "loss_mask" in x or ".X" in x or ".Y" in x]


@pytest.mark.parametrize("name", ["documents", "events"])
def test_a_streamed_table_may_be_a_folder(spark, tables, tmp_path, name):
    from quire.streaming import corpus as ST
    rows = spark.range(40)
    rows.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    rows.write.parquet(f"{tmp_path}/other.parquet")
    ST.run_append(ST.read_stream(spark, str(tmp_path), "id long", f"{name}.parquet"), f"{tmp_path}/out", f"{tmp_path}/check")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(40))


def test_streams_over_folders_equal_batch(spark, tables):
    qs = all_queries()
    for stream, batch in (("stream_chunk_text", "chunk_text"), ("stream_pretrain_length_report", "pretrain_length_report")):
        got, want = ([tuple(r) for r in qs[q](spark, tables).collect()] for q in (stream, batch))
        assert got and sorted(got, key=str) == sorted(want, key=str)


def test_vocab_usage_encodes_once(spark, tables):
    df = spark.createDataFrame([([1, None, 300],), ([],), (None,), ([1],)], "ids array<int>")
    vocab = spark.createDataFrame([("<s>", 1, True), ("x", 7, False)], "token string, id int, is_special boolean")
    assert sorted((r.id, r.uses) for r in TK.vocab_usage(df, vocab).collect() if r.id is not None) == [(1, 2), (7, 0), (300, 1)]
    assert [(r.token, r.uses) for r in TK.vocab_usage(df, vocab).collect() if r.id is None] == [(None, 1)]
    assert len([x for x in executed(all_queries()["bpe_vocab_usage"](spark, tables)) if "ArrowEvalPython" in x]) == 2


def test_words_merge_as_by_the_plain_rounds():
    def plain(codec, w):
        ids = [codec.byte_ids[b] for b in w.encode("utf-8")]
        while found := [codec.ranks[p] for p in zip(ids, ids[1:]) if p in codec.ranks]:
            rank, out, i = min(found), [], 0
            while i < len(ids):
                hit = i + 1 < len(ids) and codec.ranks.get((ids[i], ids[i + 1])) == rank
                out.append(codec.made[rank] if hit else ids[i])
                i += 1 + hit
            ids = out
        return tuple(ids)

    for seed in range(20):
        r = random.Random(seed)
        pool, vocab, merges = ["a", "b", "c"], [*SPECIAL_TOKENS, *TK.ALPHABET], []
        for _ in range(25):  # tokens made by two merges too
            a, b = r.choice(pool), r.choice(pool)
            merges.append((a, b))
            if a + b not in vocab:
                vocab.append(a + b)
                pool.append(a + b)
        short, long = (TK._Codec(vocab, merges, SPECIAL_TOKENS) for _ in range(2))
        long.SHORT = 1
        for _ in range(60):
            w = "".join(r.choice("abcé") for _ in range(r.randrange(1, 40)))
            assert short._word(w) == long._word(w) == plain(short, w)
    w = "ab" * 40_000  # a search of the whole word for every merge would take minutes
    assert "".join(vocab[i] for i in short._word(w)) == w


def test_texts_are_cut_at_special_tokens(spark):
    texts = ["", "a<b", "<s>", "<s><s>x</s>", "a\n<|im_end|>\n", "<|im_start|><|im_start", None, "<" * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.p for r in df.orderBy("i").select(TK.split_special("t").alias("p")).collect()]
    assert got == [[], ["a<b"], ["<s>"], ["<s>", "<s>", "x", "</s>"], ["a\n", "<|im_end|>", "\n"], ["<|im_start|>", "<|im_start"], None, ["<" * 20_000]]


def test_lists_of_a_slice_with_nulls():
    import pyarrow as pa
    vocab = [*SPECIAL_TOKENS, *TK.ALPHABET]
    codec = TK._Codec(vocab, [], SPECIAL_TOKENS)
    rows = pa.array([["ab"], None, [], ["é", "<s>", "ab"]], pa.list_(pa.string()))
    for k in range(4):
        ids = codec.encode_lists(rows.slice(k))
        assert ids.to_pylist() == [None if x is None else codec.words_to_ids(x) for x in rows.slice(k).to_pylist()]
        back = TK._Decoder(vocab, SPECIAL_TOKENS, True).decode_lists(ids).to_pylist()
        assert back == [None if x is None else "".join(x).replace("<s>", "") for x in rows.slice(k).to_pylist()]


def test_the_system_message_is_encoded_once(spark):
    turns = spark.createDataFrame([(c, 0, "human", "hi") for c in range(5)], "conv_id long, turn int, role string, text string")
    rows = B.sft_rows_from_turns(turns)
    assert any("Range (0, 1" in x for x in executed(rows)) and rows.count() == 5


def test_batches_are_dealt_before_the_arrays_are_made(spark, tables, monkeypatch):
    from quire.plans import sources
    seen, deal = [], sources.S.assign_batches
    monkeypatch.setattr(sources.S, "assign_batches", lambda df, *a: seen.append(df.columns) or deal(df, *a))
    got = all_queries()["path_corpus_to_batches"](spark, tables).collect()
    assert seen == [["idx", "chunk_id", "text"]]
    n = all_queries()["chunk_text"](spark, tables).count()
    assert sum(r.n_rows for r in got) == n and max(r.last_pos for r in got) == min(n, 64) - 1


def test_packed_numbers_take_little_room():
    """op12: what batches and groups send is compressed before Spark writes it to a checkpoint as it is."""
    import numpy as np

    from quire.llm.substrings import pack, unpack
    ids, slots = np.arange(5000, dtype=np.int64) % 700, np.arange(5000, dtype=np.int32)
    blob = pack(ids, slots)
    assert len(blob) < 5000 * 12 // 3
    assert all((a == b).all() for a, b in zip(unpack(blob, "<i8", "<i4"), (ids, slots)))
    assert [len(c) for c in unpack(pack(ids[:0], slots[:0]), "<i8", "<i4")] == [0, 0]


@pytest.mark.parametrize("seed", range(20))
def test_blocks_of_words_are_rewritten_and_their_grams_follow(seed):
    """train_bpe: whole blocks of words in arrays, against one word after the other."""
    from collections import Counter

    import numpy as np

    from quire.operators import bpe_training as BT
    from test_bpe_training import rewrite
    rnd = random.Random(seed)
    words = [(tuple(rnd.randrange(3) for _ in range(rnd.randint(2, 9))), rnd.choice([1, 7, 300, 1 << 40])) for _ in range(60)]
    batch = rnd.choice([[(0, 0, 3)], [(1, 1, 3), (3, 3, 4), (4, 0, 5)], [(0, 1, 70_000), (2, 70_000, 70_001)], [(8, 9, 10)]])

    def block(words):
        return (np.array([s for w, _ in words for s in (*(i + 1 for i in w), 0)], "<u4"), np.array([c for _, c in words], np.int64))

    def grams(words):
        out = Counter()
        for w, c in words:
            for i in range(len(w) - 1):
                out[(*w[i:i + 3], -1)[:3]] += c
        return out

    after = []
    for w, c in words:
        for m in batch:
            w = rewrite(w, *m)
        after.append((w, c))
    x, cnt, g, d = BT.rewrite_block(*block(words), batch)
    got = [tuple(int(s) - 1 for s in w) for w in np.split(x, np.flatnonzero(x == 0) + 1)[:-1]]
    assert Counter((w[:-1], c) for w, c in zip(got, cnt.tolist())) == Counter((w, c) for w, c in after if len(w) > 1 or (w, c) in words)
    want = grams(after)
    want.subtract(grams(words))
    assert {BT.gram_symbols(k): c for k, c in zip(g.tolist(), d.tolist())} == {k: c for k, c in want.items() if c}


def test_a_round_reads_blocks_not_words(spark):
    """train_bpe: thousands of words a row, symbols beyond 16 bits too, and back to the log's spelling."""
    from quire.operators import bpe_training as BT
    words = spark.createDataFrame([(f"wort{i}", i) for i in range(3000)] + [("a", 5), (None, 2)], "word string, cnt long")
    for wide in ("<u2", "<u4"):
        made = BT.blocks_of_words(words.selectExpr("cast(word as binary)", "cnt").where("octet_length(word) > 1").coalesce(1), list(range(256)), wide)
        assert made.count() == 1
        spelled = BT.strings_of_blocks(made, wide)
        again = BT.blocks_of_strings(spelled.coalesce(1), wide)
        assert {("".join(chr(BT.symbol_id(s)) for s in r.s), r.cnt) for r in spelled.collect()} == {(f"wort{i}", i) for i in range(3000)}
        assert sorted(BT.changed_grams(made).collect()) == sorted(BT.changed_grams(again).collect())


def test_prompts_share_states(spark, tmp_path):
    """stream_reward_groups: calls of the Python function follow the buckets, not the prompts."""
    from quire.streaming import groups as SG
    schema = "prompt_id string, completion_id long, reward double"
    rows = [(f"p{p}", c, float((p + c) % 3)) for p in range(200) for c in range(3)]
    log = f"file://{tmp_path}/log"
    for k in range(2):
        spark.createDataFrame(rows[k::2], schema).coalesce(1).write.parquet(f"{log}/f{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(log)
    got = SG.run_once_each(SG.stream_reward_groups(stream, 3, buckets=2), f"file://{tmp_path}/o", f"file://{tmp_path}/ck").collect()
    assert sorted((r.prompt_id, r.n, round(r.group_mean, 9), r.complete) for r in got) == sorted((f"p{p}", 3, 1.0, True) for p in range(200))
