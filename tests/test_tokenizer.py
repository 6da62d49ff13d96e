"""BPE training, encoding and decoding against the ``tokenizers`` package (test-only)."""

import json

import pytest
from pyspark.sql import functions as F

from quire.operators import tokenizer as TK
from quire.sources.tables import load_table

tokenizers = pytest.importorskip("tokenizers")


def hf_train(texts, vocab):
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers
    from tokenizers.normalizers import NFKC
    tok = Tokenizer(models.BPE(unk_token="<unk>"))
    tok.normalizer = NFKC()
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tr = trainers.BpeTrainer(vocab_size=vocab, special_tokens=list(TK.SPECIAL_TOKENS), min_frequency=2,
                             show_progress=False, initial_alphabet=pre_tokenizers.ByteLevel.alphabet())
    tok.train_from_iterator(texts, trainer=tr)
    return tok


@pytest.fixture(scope="module")
def corpus(spark):
    docs = load_table(spark, "/root/testdata/sf0.001", "documents", ["doc_id", "text"]).orderBy("doc_id").limit(60)
    extra = spark.createDataFrame([("Ａ１ ﬁne café, don't stop 12 times",), ("<|im_start|>user\nHello<|im_end|>",)],
                                  "text string")
    return docs.select("text").unionByName(extra)


@pytest.fixture(scope="module")
def trained(spark, corpus):
    return TK.train_bpe(corpus, "text", vocab_size=290)


def test_merges_match_library(spark, corpus, trained):
    tok = hf_train([r.text for r in corpus.collect()], 290)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in json.loads(tok.to_str())["model"]["merges"]]
    assert trained.merges == merges
    vocab = json.loads(tok.to_str())["model"]["vocab"]
    assert all(vocab[t] == i for i, t in enumerate(trained.vocab))
    assert trained.vocab[:5] == list(TK.SPECIAL_TOKENS)


def test_encode_decode_match_library(spark, corpus, trained):
    texts = [r.text for r in corpus.collect()]
    tok = hf_train(texts, 290)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    enc, dec = trained.encoder(spark), trained.decoder(spark)
    got = df.select("text", enc(F.col("text")).alias("ids")).select("text", "ids", dec(F.col("ids")).alias("back")).collect()
    for r in got:
        assert list(r.ids) == tok.encode(r.text).ids
    # round trip holds where NFKC leaves the text unchanged
    import unicodedata
    assert all(r.back == r.text for r in got if unicodedata.normalize("NFKC", r.text) == r.text)


def test_special_tokens_and_reports(spark, trained):
    df = spark.createDataFrame([("<|im_start|>user\nHello<|im_end|>",), ("plain",)], "text string")
    ids = df.select(trained.encoder(spark)(F.col("text")).alias("ids")).first().ids
    assert ids[0] == 3 and ids[-1] == 4
    r = TK.special_tokens_preserved(df, trained, "text").first()
    assert (r.n_with_special, r.n_preserved) == (1, 1)
    rep = TK.roundtrip_report(df, trained, "text").first()
    assert rep.roundtrip_rate == 1.0
    usage = TK.vocab_usage(df.select(trained.encoder(spark)(F.col("text")).alias("ids")), trained.vocab_df(spark))
    assert usage.count() == len(trained.vocab)
    assert usage.filter("id = 3").first().uses == 1


def test_save_load(spark, tmp_path, trained):
    for where in (str(tmp_path / "a"), f"file://{tmp_path}/b"):
        trained.save(spark, where)
        back = TK.BpeModel.load(spark, where)
        assert back.vocab == trained.vocab and back.merges == trained.merges and back.special_tokens == trained.special_tokens
    cfg = json.loads((tmp_path / "b" / "tokenizer_config.json").read_text())
    assert cfg["bos_token"] == "<|im_start|>" and cfg["pad_token"] == "<|im_end|>"
    assert cfg["model_max_length"] == 1000000000000000019884624838656 and "add_generation_prompt" in cfg["chat_template"]
    tok = json.loads((tmp_path / "a" / "tokenizer.json").read_text())
    assert len(tok["model"]["vocab"]) == len(trained.vocab) and len(tok["model"]["merges"]) == len(trained.merges)


def test_array_encoder_and_skipped_specials(spark, trained):
    texts = ["Hello <|im_start|>user\n", "Ａ１ ﬁne<|im_end|>", "", "x  y\n\nz"]
    df = spark.createDataFrame([(texts,)], "t array<string>")
    many = df.select(trained.array_encoder(spark)(F.col("t")).alias("ids")).first().ids
    one = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", trained.encoder(spark)(F.col("t")).alias("ids"))
    assert many == [r.ids for r in one.orderBy("k").collect()]
    back = spark.createDataFrame([(k, ids) for k, ids in enumerate(many)], "k int, ids array<int>").select(
        "k", trained.decoder(spark)("ids").alias("all"), trained.decoder(spark, True)("ids").alias("plain")).orderBy("k").collect()
    assert [r["all"] for r in back] == ["Hello <|im_start|>user\n", "A1 fine<|im_end|>", "", "x  y\n\nz"]
    assert [r.plain for r in back] == ["Hello user\n", "A1 fine", "", "x  y\n\nz"]


def test_engine_does_not_import_regex():
    import pathlib
    root = pathlib.Path(TK.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "import regex" in p.read_text()]


def test_one_scan_for_nfkc(spark):
    docs = load_table(spark, "/root/testdata/sf0.001", "documents", ["text"])
    plan = TK.nfkc(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_word_symbols_and_pretokenize(spark):
    df = spark.createDataFrame([("Hello  world's é!",)], "text string")
    words = [r.w for r in df.select(F.explode(TK.pretokenize("text")).alias("w")).collect()]
    import regex
    assert words == regex.findall(TK.PRETOKEN_PATTERN, "Hello  world's é!")
    syms = spark.createDataFrame([("é",)], "w string").select(TK.word_symbols("w").alias("s")).first().s
    assert syms == [TK.BYTE_IDS[b] for b in "é".encode("utf-8")]


def test_approximate_rounds_fill_the_vocabulary(spark, corpus):
    m = TK.train_bpe(corpus, "text", vocab_size=300, exact=False)
    assert len(m.vocab) == 300 and len(m.merges) >= 39
    assert m.rounds < 39  # several merges per round
    tok2id = m.token_to_id
    assert all(a + b in tok2id for a, b in m.merges)
