"""Vocabulary training: batches of merges against the one-at-a-time rule, resumed jobs, the library."""

import json
import random
from collections import Counter

import pytest

from quire.operators import bpe_training as BT
from quire.operators import tokenizer as TK


def rewrite(word, a, b, n):
    out, i = [], 0
    while i < len(word):
        if word[i:i + 2] == (a, b):
            out.append(n)
            i += 2
        else:
            out.append(word[i])
            i += 1
    return tuple(out)


def one_at_a_time(words, first_id, steps):
    words, merges = dict(words), []
    for n in range(first_id, first_id + steps):
        pairs = Counter()
        for w, c in words.items():
            for p in zip(w, w[1:]):
                pairs[p] += c
        best = min(pairs, key=lambda p: (-pairs[p], p), default=None)
        if best is None or pairs[best] < 2:
            break
        merges.append((*best, n))
        new = Counter()
        for w, c in words.items():
            new[rewrite(w, *best, n)] += c
        words = new
    return merges


def in_batches(words, first_id, steps, candidates):
    words, merges, sizes = dict(words), [], []
    while len(merges) < steps:
        pairs, triples = Counter(), Counter()
        for w, c in words.items():
            for p in zip(w, w[1:]):
                pairs[p] += c
            for t in zip(w, w[1:], w[2:]):
                triples[t] += c
        best = sorted(((a, b, c) for (a, b), c in pairs.items() if c >= 2), key=lambda x: (-x[2], x[0], x[1]))[:candidates]
        if not best:
            break
        names = {(a, b) for a, b, _ in best}
        inner = {t: c for t, c in triples.items() if t[:2] in names and t[1:] in names}
        batch = BT.plan_batch(best, inner, best[-1][2] if len(best) == candidates else 1, first_id + len(merges), steps - len(merges))
        merges += batch
        sizes.append(len(batch))
        for a, b, n in batch:
            new = Counter()
            for w, c in words.items():
                new[rewrite(w, a, b, n)] += c
            words = new
    return merges, sizes


@pytest.mark.parametrize("seed", range(60))
def test_batches_are_the_merges_of_the_one_at_a_time_trainer(seed):
    rnd = random.Random(seed)
    letters = rnd.choice([2, 3, 5, 12])
    stems = [tuple(rnd.randrange(letters) for _ in range(rnd.randint(1, 6))) for _ in range(12)]
    words = Counter()
    for _ in range(rnd.choice([5, 40, 200])):
        w = sum((rnd.choice(stems) for _ in range(rnd.randint(1, 3))), ())
        words[w] += rnd.randint(1, 30)
    want = one_at_a_time(words, 100, 40)
    got, sizes = in_batches(words, 100, 40, rnd.choice([3, 10, 64]))
    assert got == want and sum(sizes) == len(want)


def test_batches_chain_merges_and_share_symbols():
    words = {(0, 1, 2): 100, (3, 1): 40, (4, 5): 20, (4, 6): 10}
    got, sizes = in_batches(words, 100, 6, 64)
    assert got == one_at_a_time(words, 100, 6) and sizes[0] >= 4


def test_symbols_keep_their_order_and_words_are_rewritten(spark):
    from pyspark.sql import functions as F
    chars = [BT.symbol_char(i) for i in (0, 5, 260, 6143, 50_000, 55_039, 55_040, 70_000)]
    assert sorted(chars) == chars and [BT.symbol_id(c) for c in chars] == [0, 5, 260, 6143, 50_000, 55_039, 55_040, 70_000]
    word = "".join(BT.symbol_char(i) for i in (7, 7, 7, 8, 9, 8, 9))
    df = spark.createDataFrame([(word,)], "s string").select(BT.apply_merges(F.col("s"), [(7, 7, 100), (8, 9, 101), (101, 101, 102)]).alias("n"))
    assert [BT.symbol_id(c) for c in df.first().n] == [100, 7, 102]


def test_a_stopped_job_goes_on_and_ends_with_the_same_merges(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(40)
    words = TK.word_counts(docs).checkpoint()
    whole = TK.train_bpe(docs, vocab_size=330, word_table=words)
    folder = f"file://{tmp_path}/log"
    first = TK.train_bpe(docs, vocab_size=330, word_table=words, log_dir=folder, checkpoint_every=2, stop_after=3)
    assert 0 < len(first.merges) < len(whole.merges) and first.merges == whole.merges[:len(first.merges)]
    # what was written after the last complete round does not count
    spark.range(1).write.parquet(f"{folder}/words/round=9")
    rest = TK.train_bpe(docs, vocab_size=330, word_table=words, log_dir=folder)
    assert rest.merges == whole.merges and rest.vocab == whole.vocab and rest.rounds < whole.rounds
    again = TK.train_bpe(docs, vocab_size=330, word_table=words, log_dir=folder)
    assert again.merges == whole.merges and again.rounds == 0


def test_hundreds_of_merges_match_the_library(spark):
    pytest.importorskip("tokenizers")
    from test_tokenizer import hf_train
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    model = TK.train_bpe(docs, vocab_size=600)
    want = json.loads(hf_train([r.text for r in docs.collect()], 600).to_str())["model"]["merges"]
    assert model.merges == [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in want]
    assert sum(model.round_sizes) / model.rounds >= 10
