"""Streamed reward groups, length sketches and tokenizer files from any file system."""

import hashlib
import json
import random
from datetime import datetime

import pytest

from quire.operators import length_sketches as L
from quire.operators import scoring as A
from quire.operators import tokenizer as TK
from quire.streaming import groups as SG

ROW = "prompt_id long, completion_id long, reward double"


def write_log(spark, folder, files, schema):
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/f{k}")


def read_log(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_groups_survive_a_killed_query_and_leave_once(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(p, c, float(rnd.random() < 0.5)) for p in range(30) for c in range(4)]
    rows += [(99, c, 1.0) for c in range(3)]  # never whole
    rnd.shuffle(rows)
    files = [rows[k::5] for k in range(5)]
    files[3] = files[3] + files[0][:10] + [(None, 1, 1.0), (1, None, 1.0), (1, 2, None)]  # sent again, and broken rows
    log, out = f"file://{tmp_path}/log", f"file://{tmp_path}/out"
    write_log(spark, log, files, ROW)

    lost = []

    def kill(batch_id):
        if batch_id in (1, 3) and batch_id not in lost:
            lost.append(batch_id)
            raise RuntimeError("executor and driver lost")

    for k in range(3):
        groups = SG.stream_reward_groups(read_log(spark, log, ROW), 4)
        try:
            got = SG.run_once_each(groups, f"{out}/data", f"{out}/ck", kill)
            break
        except Exception as e:
            assert "lost" in str(e)
    assert lost == [1, 3]
    got = sorted(tuple(r) for r in got.collect())
    batch = A.reward_groups(spark.createDataFrame([r for r in rows if r[0] != 99], ROW), "prompt_id", "reward")
    want = sorted({(r.prompt_id, r.group_size, r.group_mean, r.group_std, r.no_signal, True) for r in batch.collect()})
    assert len(got) == 30 and [g[:2] + g[4:] for g in got] == [w[:2] + w[4:] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-12 and abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want))


def test_more_completions_than_the_group_takes_and_timeouts(spark, tmp_path):
    schema = ROW + ", at timestamp"
    at = lambda h: datetime(2024, 1, 1, h)
    files = [[(1, c, float(c), at(0)) for c in (5, 3, 9, 1, 1, 7)] + [(2, 1, 1.0, at(0))],
             [(1, 20, 8.0, at(1)), (2, 1, 5.0, at(1)), (3, 1, 1.0, at(1))],
             [(4, 1, 1.0, at(9))],
             [(2, 2, 1.0, at(0)), (5, 1, 0.0, at(9)), (5, 2, 0.0, at(9)), (4, 2, 2.0, at(9))]]
    log = f"file://{tmp_path}/log"
    write_log(spark, log, files, schema)
    groups = SG.stream_reward_groups(read_log(spark, log, schema), 2, time="at", delay="1 hour", delay_ms=3_600_000)
    got = {r.prompt_id: tuple(r)[1:] for r in SG.run_once_each(groups, f"file://{tmp_path}/o", f"file://{tmp_path}/ck").collect()}
    assert got[1][:2] == (2, 2.0) and got[1][4]  # completions 1 and 3: the smallest ids of the batch
    assert got[2] == (1, 1.0, None, True, False) and got[3] == (1, 1.0, None, True, False)  # timed out; the late row is dropped
    assert got[5][:2] == (2, 0.0) and got[4][:2] == (2, 1.5) and len(got) == 5
    none = SG.stream_reward_groups(read_log(spark, log, schema).where("false"), 2)
    assert SG.run_once_each(none, f"file://{tmp_path}/o2", f"file://{tmp_path}/ck2").count() == 0


def test_sketches_of_runs_merge_within_the_error(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(["en", "de", None][i % 3], ["a", "b"][i % 7 % 2], int(rnd.lognormvariate(6, 1.5))) for i in range(30_000)]
    rows += [("en", "a", None), ("xx", None, 7)]
    group = ["lang", "source"]
    path = f"file://{tmp_path}/runs"
    for part in (rows[:9000], rows[9000:]):  # two runs, each stored
        L.length_sketches(spark.createDataFrame(part, "lang string, source string, n int"), group, "n").write.mode("append").parquet(path)
    merged = L.merge_sketches(spark.read.parquet(path), group)
    got = L.quantiles(L.roll_up(merged, group), {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()
    assert len(got) == 7 + 4 + 1
    for r in got:
        own = sorted(n for a, b, n in rows if n is not None and (r.level < 1 or a == r.lang) and (r.level < 2 or b == r.source))
        assert (r.n_rows, r.sum_length, r.max_length) == (len(own), sum(own), max(own))
        for q, v in ((0.1, r.p10), (0.5, r.p50), (0.99, r.p99)):
            off = L.RANK_ERROR * len(own) + 1
            assert sum(x < v for x in own) - off <= q * len(own) <= sum(x <= v for x in own) + off
    empty = L.length_sketches(spark.createDataFrame([], "lang string, source string, n int"), group, "n")
    assert L.roll_up(empty, group).count() == 0


def test_tokenizer_file_on_any_file_system(spark, tmp_path):
    p = tmp_path / "a b" / "tokenizer.json"
    p.parent.mkdir()
    p.write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 1, "é": 2, "ab": 3}, "merges": ["a b"]}}, ensure_ascii=False), encoding="utf-8")
    digest = hashlib.sha256(p.read_bytes()).hexdigest()
    plain = TK.BpeModel.from_tokenizer_file(str(p))
    there = TK.BpeModel.from_tokenizer_file(f"file://{p}", spark=spark, sha256=digest.upper())
    assert list(plain.vocab) == list(there.vocab) and plain.merges == there.merges == [("a", "b")]
    with pytest.raises(FileNotFoundError):
        TK.BpeModel.from_tokenizer_file(f"file://{tmp_path}/none.json", spark=spark)
    with pytest.raises(ValueError, match="sha256"):
        TK.BpeModel.from_tokenizer_file(f"file://{p}", spark=spark, sha256="0" * 64)
