"""Readers (S-1..S-9), line index, and batch = stream (ST-1, ST-2)."""

import bz2
import random

import pytest

from quire.sources import jsonl as J

FIXTURE_LINES = ['{"text":"a"}', 'not json', '{"x":1}', '{"text":null}', '', '{"text":"d","text":"e"}', '[1]', '5']


def test_lenient_reader_fixture(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text("\n".join(FIXTURE_LINES) + "\n")
    good, rej = J.read_jsonl_text(spark, str(p))
    assert sorted((r.text or "") for r in good.collect()) == ["", "a", "e"]
    assert [(r.line_no, r.reason) for r in rej.orderBy("line_no").collect()] == [
        (2, "bad_json"), (3, "missing_text"), (5, "bad_json"), (7, "missing_text"), (8, "not_object")]
    rep = {r.reason: r.n_lines for r in J.load_report(rej).collect()}
    assert rep == {"bad_json": 2, "missing_text": 2, "not_object": 1}


def test_lenient_reader_rejects_what_is_not_one_object(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    bad = ['{"text":"a"} trailing', '{"text":"a"}{"text":"b"}', "{'text':'a'}", '{"text":"a"},{"text":"b"}', '{"text":"a"', '[{"text":"a"}', '{"text":"a"}],[{"b":1}',
           '{"text":"a"}},{"b":{}', '{"text":"a"},"b":{"c":1}']
    p.write_text("\n".join(['{"text":"ok"}', *bad, ' {"text":"sp"} ', '{"text":{"x":1}}']) + "\n")
    good, rej = J.read_jsonl_text(spark, str(p))
    assert sorted(r.text for r in good.collect()) == sorted(["ok", "sp", '{"x":1}'])
    assert [(r.line_no, r.reason) for r in rej.orderBy("line_no").collect()] == [(k, "bad_json") for k in range(2, 11)]


def test_good_path_is_one_narrow_scan(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"text":"ok"}\n')
    good, _ = J.read_jsonl_text(spark, str(p))
    plan = good.select("text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "MapInPandas" not in plan and "Exchange" not in plan and "Python" not in plan


def test_bz2(spark, tmp_path):
    p = tmp_path / "c.jsonl.bz2"
    with bz2.open(p, "wt") as f:
        f.write("\n".join(FIXTURE_LINES) + "\n")
    good, rej = J.read_bz2_jsonl(spark, str(p))
    assert (good.count(), rej.count()) == (3, 5)


def test_line_index_matches_sequential_rule(spark, tmp_path):
    random.seed(5)
    txt = "".join(random.choice(["é", "a", " ", "\r"]) * random.randint(0, 20) + ("\n" if random.random() < 0.9 else "\r\n")
                  for _ in range(5000))
    p = tmp_path / "b.txt"
    p.write_bytes(txt.encode("utf-8"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")  # many splits
    try:
        idx = J.line_index(spark, str(p)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    offs, pos = [], 0
    with open(p, "rb") as f:
        for line in f:
            offs.append(pos)
            pos += len(line)
    assert [r.byte_offset for r in idx] == offs
    assert [r.line_no for r in idx] == list(range(1, len(offs) + 1))


def test_index_and_access_over_several_files(spark, tmp_path):
    texts = [f"line {k} \xe9" + "x" * (k % 17) for k in range(4000)]
    for k in range(4):
        (tmp_path / f"part-{k}.txt").write_text("".join(t + "\n" for t in texts[k * 1000:(k + 1) * 1000]), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        idx = {r.idx: r for r in J.line_index(spark, str(tmp_path)).collect()}
        got = J.fetch_lines(spark, str(tmp_path), spark.createDataFrame([(0,), (999,), (1000,), (3999,), (5000,), (999,), (None,)], "idx long")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    at = 0
    for k, t in enumerate(texts):
        assert (idx[k].position, idx[k].byte_len, idx[k].line_no) == (at, len(t.encode()) + 1, k % 1000 + 1)
        at += len(t.encode()) + 1
    assert sorted((r.idx, r.value) for r in got) == [(k, texts[k]) for k in (0, 999, 1000, 3999)]


def test_messages(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('[{"role":"user","content":"hi"}]\n[{"role":"assistant","content":"yo"}]\n')
    m = J.read_messages_jsonl(spark, str(p)).collect()
    assert [x.messages[0].role for x in m] == ["user", "assistant"]


def test_write_append_keeps_duplicates(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "text string")
    out = str(tmp_path / "o")
    J.write_jsonl(df, out, "overwrite")
    J.write_jsonl(df, out, "append")
    good, _ = J.read_jsonl_text(spark, out)
    assert sorted(r.text for r in good.collect()) == ["a", "a", "b", "b"]


def test_resolve_prompts(spark, tmp_path):
    a, b = tmp_path / "p+1 %.txt", tmp_path / "q.txt"
    a.write_text("hello\nworld")
    b.write_text("")
    rows = [f"FILE:{a}", f"FILE:{a}", f"FILE:file://{a}", "plain", None, f"FILE:{b}"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, prompt string")
    want = {0: "hello\nworld", 1: "hello\nworld", 2: "hello\nworld", 3: "plain", 4: None, 5: ""}
    assert {r.k: r.prompt for r in J.resolve_prompts(spark, df).collect()} == want
    got = {r.k: r.prompt for r in J.resolve_prompts(spark, df.where("k < 5"), str(tmp_path)).collect()}
    assert got == {k: want[k] for k in range(5)}
    gone = spark.createDataFrame([("FILE:/nowhere/x.txt",)], "prompt string")
    with pytest.raises(Exception, match="not found"):
        J.resolve_prompts(spark, gone, str(tmp_path)).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        J.resolve_prompts(spark, gone).collect()


def test_splits_on_any_file_system(spark, tmp_path):
    from quire.sources.tables import load_split
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    df.write.parquet(f"file://{tmp_path}/train")
    df.write.json(f"file://{tmp_path}/test")
    df.write.json(f"file://{tmp_path}/dev.jsonl")
    for name, fmt in (("train", None), ("test", "json"), ("dev", None)):
        for root in (f"file://{tmp_path}", str(tmp_path)):
            assert load_split(spark, root, name, fmt).count() == 2
    with pytest.raises(FileNotFoundError):
        load_split(spark, f"file://{tmp_path}", "none")


def test_stream_equals_batch(spark):
    from quire.plans import all_queries
    qs = all_queries()
    d = "/root/testdata/sf0.001"
    batch = sorted(tuple(r) for r in qs["chunk_text"](spark, d).collect())
    stream = sorted(tuple(r) for r in qs["stream_chunk_text"](spark, d).collect())
    assert batch == stream
    b2 = sorted(tuple(r) for r in qs["loss_by_batch"](spark, d).collect())
    s2 = sorted(tuple(r) for r in qs["stream_loss_by_batch"](spark, d).collect())
    assert b2 == s2


def test_lines_that_are_no_utf8_are_rejected(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_bytes(b'{"text":"a"}\n{"text":"\xff\xfe"}\n\xc3\n{"text":"\xc3\xa9"}\n{"text":"\xed\xa0\x80"}\n{"text":"b"}\n')
    good, rej = J.read_jsonl_text(spark, str(p))
    assert sorted(r.text for r in good.collect()) == ["a", "b", "\u00e9"]
    assert [(r.line_no, r.reason) for r in rej.orderBy("line_no").collect()] == [(2, "bad_utf8"), (3, "bad_utf8"), (5, "bad_utf8")]
    assert [r.byte_len for r in J.line_index(spark, str(p)).orderBy("idx").collect()] == [13, 14, 2, 14, 15, 13]


def test_seek_reads_only_the_wanted_ranges(spark, tmp_path):
    random.seed(6)
    lines = {}
    folder = tmp_path / "a b"  # a name that addresses spell differently
    folder.mkdir()
    for name in ("x.txt", "y.txt"):
        lines[name] = [random.choice(["", "\u00e9t\u00e9", "z" * random.randint(0, 300), "a\rb"]) for _ in range(2000)]
        (folder / name).write_bytes("".join(x + "\n" for x in lines[name]).encode())
    every = lines["x.txt"] + lines["y.txt"]
    index = J.write_line_index(spark, str(folder), f"file://{tmp_path}/index")
    picks = random.sample(range(4000), 10)
    wanted = spark.createDataFrame([(i,) for i in picks * 2] + [(None,), (10 ** 9,)], "k long")
    # all other bytes are overwritten: they cannot have been read
    keep = {"x.txt": [i for i in picks if i < 2000], "y.txt": [i - 2000 for i in picks if i >= 2000]}
    for name, own in keep.items():
        raw = [(x + "\n").encode() for x in lines[name]]
        (folder / name).write_bytes(b"".join(r if i in own else b"#" * len(r) for i, r in enumerate(raw)))
    got = J.seek_lines(index, wanted, "k").collect()
    assert sorted((r.idx, r.value) for r in got) == sorted((i, every[i]) for i in picks)
    assert all(r.line_no == (r.idx % 2000) + 1 for r in got)
    assert J.seek_lines(index, wanted.where("k is null"), "k").count() == 0
    (folder / "y.txt").write_bytes(b"")
    with pytest.raises(Exception, match="line index and file differ"):
        J.seek_lines(index, spark.createDataFrame([(3999,)], "k long"), "k").collect()
