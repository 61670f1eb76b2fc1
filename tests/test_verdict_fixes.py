"""Faults found in review: each case failed before its fix."""

import pandas as pd
from pyspark.sql import functions as F

from textloom.functions.url import ipv4_address
from textloom.operators.answers import recover_one
from textloom.operators.catalogue import detect_tools, known_tools_table
from textloom.operators.routing import js_number
from textloom.sources.inputs import resolve_inputs
from textloom.streaming.assemble import parse_stream


def test_json_recovery_survives_surrogates_depth_and_open_braces():
    assert recover_one('{"a":"\\ud800"}') == ('{"a":"\\ud800"}', "whole", None)
    recover_one('{"a":"\\ud800"}')[0].encode()
    assert recover_one('{"a":' * 100_000 + "1" + "}" * 100_000)[0] is None
    assert recover_one("{ " * 20_000 + '{"a":1}')[:2] == ('{"a":1}', "braces")
    assert recover_one('x {bad} y {"a": "}"} z')[:2] == ('{"a":"}"}', "braces")
    assert recover_one("```json\n{\"k\": [1]}\n```")[:2] == ('{"k":[1]}', "fenced")


def test_long_digit_runs_are_read_whole(spark):
    hosts = ["0x" + "0" * 70 + "7f000001", "0" * 80 + "17700000001", "0" * 40 + "1.1"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert [r[0] for r in df.select(ipv4_address("h")).collect()] == [2130706433, 2130706433, 16777217]
    df = spark.createDataFrame([("0x" + "0" * 30 + "1",), ("0b" + "1" * 70,), ("0o0",)], "h string")
    got = [r[0] for r in df.select(js_number(F.col("h"))).collect()]
    assert got[0] == 1.0 and got[2] == 0.0 and abs(got[1] / 2 ** 70 - 1) < 1e-12


def test_empty_argument_list_reads_the_pipe(spark):
    df = spark.createDataFrame([([], "hello"), (["-"], "there")], "args array<string>, piped string")
    got = resolve_inputs(df).select("kind", "content").collect()
    assert sorted((r["kind"], r["content"]) for r in got) == [("stdin", "hello"), ("stdin", "there")]


def test_tool_listed_twice_is_found_once(spark):
    known = known_tools_table(spark)
    name = known.orderBy("ord").first()["command"]
    found = detect_tools(spark.createDataFrame([(1, name), (1, name)], "config_id int, command_name string"), known)
    assert found.count() == 1


def test_end_lines_are_recognised_by_value(spark):
    rows = [("ollama", '{"model":"m","done":true,"total_duration":5}', True), ("ollama", '{"message":{"content":"done"},"done":false}', False),
            ("anthropic", 'data: {"type": "message_stop"}', True), ("openrouter", "data: [DONE]\r", True), ("openai", "data: {}", False)]
    df = spark.createDataFrame([(1, 1, i, p, line, False) for i, (p, line, _) in enumerate(rows)],
                               "conv_id long, turn long, seq long, provider string, line string, is_tail boolean")
    got = {r["seq"]: r["is_end"] for r in parse_stream(df).collect()}
    assert [got[i] for i in range(len(rows))] == [e for *_, e in rows]


def test_line_delivered_again_changes_nothing():
    from textloom.streaming.assemble import _assemble_state

    class State:
        exists = hasTimedOut = False

        def remove(self):
            pass
    pdf = pd.DataFrame({"seq": [0, 0, 1], "delta": ["A", "A", None], "is_end": [False, False, True], "ts": pd.to_datetime([0, 0, 0])})
    assert next(_assemble_state((1, 1), iter([pdf]), State()))["text"].tolist() == ["A"]
