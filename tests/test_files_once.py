"""Bounded file reads, writes that leave one copy, keys that are never NULL."""

import os

import pytest

from textloom.sources import heads
from textloom.sources import sinks as S
from textloom.sources.inputs import read_text_corpus, resolve_inputs


def test_a_large_file_costs_the_limit(spark, tmp_path):
    with open(tmp_path / "huge.bin", "wb") as f:
        f.write(b"start")
        f.truncate(3 << 30)  # 3 GB, most of it a hole
    (tmp_path / "small.txt").write_bytes("né".encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "blank.txt").write_bytes(b" ")
    (tmp_path / "exact.txt").write_bytes(b"x" * 1000)
    got = {os.path.basename(r["path"]): (r["length"], bytes(r["head"])) for r in heads.file_heads(spark, str(tmp_path), 1000).collect()}
    assert got == {"huge.bin": (3 << 30, b"start" + b"\0" * 995), "small.txt": (3, "né".encode()), "exact.txt": (1000, b"x" * 1000), "blank.txt": (1, b" ")}
    rows = {os.path.basename(r["source"]): r["ok"] for r in read_text_corpus(spark, str(tmp_path)).collect()}
    assert rows == {"huge.bin": True, "small.txt": True, "blank.txt": False, "exact.txt": True}


def test_failed_writes_are_replaced_and_whole_ones_kept(spark, tmp_path):
    df = spark.createDataFrame([("# Report", "openai")], "body string, provider string")
    left = tmp_path / "left"
    left.mkdir()
    (left / "part-00000-failed.txt").write_text("half a rep")  # no _SUCCESS: a write that failed
    S.write_report(spark, df, "body", "left", base=str(tmp_path))
    assert [r["value"] for r in spark.read.text(str(left)).collect()] == ["# Report"]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        S.write_report(spark, df, "body", "left", base=str(tmp_path))
    for path in ("../out", "/etc/report", ".ssh/report"):
        with pytest.raises(ValueError, match="rejected"):
            S.write_report(spark, df, "body", path, base=str(tmp_path))
    S.write_requests(df, str(tmp_path / "req"))
    assert [tuple(r) for r in spark.read.text(str(tmp_path / "req")).collect()] == [("# Report", "openai")]


def test_replayed_batches_leave_one_copy(spark, tmp_path):
    out = str(tmp_path / "out")
    one, two = (spark.createDataFrame([(i,)], "x int") for i in (1, 2))
    assert S.read_batches(spark, out, one.schema).count() == 0
    assert S.write_batch_once(one, 0, out) and not S.write_batch_once(two, 0, out)  # a replay
    os.makedirs(f"{out}/batch_id=1")
    open(f"{out}/batch_id=1/part-0-dead.parquet", "w").write("not parquet")  # a write that failed: not read, and replaced
    assert [(r["x"], r["batch_id"]) for r in S.read_batches(spark, out, one.schema).collect()] == [(1, 0)]
    assert S.write_batch_once(two, 1, out)
    assert sorted((r["x"], r["batch_id"]) for r in S.read_batches(spark, out, one.schema).collect()) == [(1, 0), (2, 1)]


def test_requests_without_a_key_spread(spark):
    files = spark.createDataFrame([("a.txt", "text of a", True, None)], "path string, content string, ok boolean, reason string")
    requests = spark.createDataFrame([(i, ["two", f"words {i}"], None) for i in range(50)] + [(90, ["a.txt"], None), (91, [], "piped"), (92, None, None)],
                                     "request_id int, args array<string>, piped string")
    got = {r["request_id"]: (r["kind"], r["content"], r["ok"]) for r in resolve_inputs(requests, files=files).collect()}
    assert len(got) == 53 and got[90] == ("file", "text of a", True) and got[91] == ("stdin", "piped", True) and got[7] == ("argument", "two words 7", True)
    assert not got[92][2]
