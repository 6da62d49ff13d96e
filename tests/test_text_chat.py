"""FIXTURES.md section 3: chunking, messages, answers, rewards, previews, NFKC."""

from pyspark.sql import functions as F

from quire.functions import chat as C
from quire.functions import text as T
from quire.operators import reshape as R
from quire.operators import scoring as A
from quire.operators import tokenizer as TK


def test_chunk_text_size4(spark):
    df = spark.createDataFrame([(1, ""), (2, "abcd"), (3, "abcde"), (4, "a😀bcd"), (5, None)], "id int, text string")
    out = R.chunk_text(df, "text", 4).orderBy("id", "chunk_id").collect()
    assert [(r.id, r.chunk_id, r.text) for r in out] == [
        (2, 0, "abcd"), (3, 0, "abcd"), (3, 1, "e"), (4, 0, "a😀bc"), (4, 1, "d")]


def test_chunk_text_matches_python_rule(spark):
    import random
    random.seed(3)
    texts = ["".join(random.choice("ab\n é😀\r") for _ in range(random.randint(0, 40))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = sorted((r.id, r.chunk_id, r.text) for r in R.chunk_text(df, "text", 7).collect())
    want = sorted((i, k, t[s:s + 7]) for i, t in enumerate(texts) for k, s in enumerate(range(0, len(t), 7)))
    assert got == want


def test_to_messages(spark):
    df = spark.createDataFrame([
        (1, []), (2, [("human", "q"), ("assistant", "a")]), (3, [("human", "q"), ("tool", "t"), ("assistant", "a")])],
        "id int, turns array<struct<from:string,value:string>>")
    out = {r.id: [(m.role, m.content) for m in r.m] for r in df.select("id", C.to_messages("turns").alias("m")).collect()}
    sys_msg = ("system", "你是一个AI助手")
    assert out[1] == [sys_msg]
    assert out[2] == [sys_msg, ("user", "q"), ("assistant", "a")]
    assert out[3] == [sys_msg, ("user", "q"), ("assistant", "a")]
    drops = {r.id: r.d for r in df.select("id", C.dropped_turns("turns").alias("d")).collect()}
    assert drops == {1: 0, 2: 0, 3: 1}


def test_build_prompt_skips_empty_system(spark):
    df = spark.createDataFrame([("q", "s"), ("q", ""), ("q", None)], "q string, s string")
    out = [[m.role for m in r.p] for r in df.select(C.build_prompt("q", F.col("s")).alias("p")).collect()]
    assert out == [["system", "user"], ["user"], ["user"]]


def test_ground_truth(spark):
    cases = [("x #### 72", "72"), ("####-5", "-5"), ("#### 1,234", "1"), ("#### 2.5", "2"), ("none", None)]
    df = spark.createDataFrame(cases, "a string, want string")
    assert all(r.got == r.want for r in df.select(T.extract_ground_truth("a").alias("got"), "want").collect())


def test_boxed_answer(spark):
    cases = [("\\boxed{72}", "72"), ("\\boxed{ 7 }", "7"), ("\\boxed{1} \\boxed{2}", "1"),
             ("\\boxed{\\frac{1}{2}}", "\\frac{1"), ("72", ""), ("\\boxed{7\n}", ""), ("\\boxed{a\rb}", "a\rb")]
    df = spark.createDataFrame(cases, "t string, want string")
    got = [(r.got, r.want) for r in df.select(T.boxed_answer("t").alias("got"), "want").collect()]
    assert all(g == w for g, w in got), got


def test_reward_and_accuracy(spark):
    df = spark.createDataFrame([("72", "72"), ("71", "72"), ("", None)], "p string, g string")
    assert [r.r for r in df.select(A.reward("p", "g").alias("r")).collect()] == [1.0, 0.0, 0.0]
    empty = spark.createDataFrame([], "reward double")
    assert A.accuracy(empty).first().accuracy == 0.0
    # the reference's own smoke: \boxed{71} against 72 scores 0
    smoke = spark.createDataFrame([([("assistant", r"The answer is \boxed{71}.")], "72")],
                                  "c array<struct<role:string,content:string>>, g string")
    assert A.score_completions(smoke, "c", "g", as_messages=True).first().reward == 0.0


def test_accuracy_delta_matches_reported_numbers(spark):
    before = spark.createDataFrame([(i, 1.0 if i < 23 else 0.0) for i in range(50)], "question_id int, reward double")
    after = spark.createDataFrame([(i, 1.0 if i < 27 else 0.0) for i in range(50)], "question_id int, reward double")
    s = A.accuracy_delta(A.compare_runs(before, after)).first()
    assert (round(s.acc_before, 2), round(s.acc_after, 2), s.delta_text) == (0.46, 0.54, "+8.00%")


def test_preview(spark):
    df = spark.createDataFrame([(1, "x" * 80), (2, "y" * 81), (3, " a\n\n b "), (4, "z")], "id int, t string")
    out = R.preview(df, {"t": "t"}, n=3, max_chars=80, order=["id"]).collect()
    assert [r.t for r in out] == ["x" * 80, "y" * 77 + "...", "a b"]


def test_nfkc(spark):
    df = spark.createDataFrame([("Ａ１",), ("ﬁ",), ("plain é",)], "text string")
    assert sorted(r.text for r in TK.nfkc(df, "text").collect()) == sorted(["A1", "fi", "plain é"])


def test_render_chatml_and_plain(spark):
    msgs = [("system", "s"), ("user", "u"), ("assistant", "a"), ("tool", "x")]
    df = spark.createDataFrame([(msgs,)], "m array<struct<role:string,content:string>>")
    r = df.select(C.render_chatml("m", True).alias("c"), C.render_plain("m", "</e>").alias("p")).first()
    assert r.c == ("<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n"
                   "<|im_start|>assistant\na<|im_end|>\n<|im_start|>assistant\n")
    assert r.p == "System: s\nUser: u\nAssistant: a</e>\n"
