"""Wire formats, re-framing, assembly and JSON recovery."""

from pyspark.sql import functions as F

from textloom.operators.answers import recover_one, typed_summaries
from textloom.operators.responses import assemble, json_conf, reframe, wire_deltas


def _deltas(spark, provider, lines, tail_last=False):
    json_conf(spark)
    rows = [(1, provider, i, ln, tail_last and i == len(lines) - 1) for i, ln in enumerate(lines)]
    df = spark.createDataFrame(rows, "rid int, provider string, seq int, line string, is_tail boolean")
    return [r["delta"] for r in wire_deltas(df).orderBy("seq").collect()]


def test_anthropic_lines(spark):
    lines = ["event: content_block_delta",
             'data: {"type":"content_block_delta","delta":{"type":"text_delta","text":"Hello "}}',
             'data: {"type":"content_block_delta","delta":{"type":"text_delta","text":"world"}}',
             'data: {"type":"message_stop"}',
             'data: {"type":"content_block_delta","delta":{"type":"text_delta","text":"tail"}}']
    assert _deltas(spark, "anthropic", lines, tail_last=True) == [None, "Hello ", "world", None, None]


def test_openai_lines(spark):
    lines = ['data: {"choices":[{"delta":{"content":"a"}}]}', "data: [DONE]", "data:{}", "data: not json",
             'data: {"choices":[{"delta":{"content":5}}]}', 'data: {"choices":[{"delta":{"content":""}}]}',
             '  data: {"choices":[{"delta":{"content":"t"}}]}  ']
    assert _deltas(spark, "openai", lines, tail_last=True) == ["a", None, None, None, None, None, "t"]


def test_ollama_lines(spark):
    lines = ['{"message":{"content":"x"},"done":false}', "", '{"message":{"content":"y"},"done":true}',
             '{"message":{"content":"z"},"done":true}']
    assert _deltas(spark, "ollama", lines, tail_last=True) == ["x", None, None, "z"]


def test_reframe_and_assemble(spark):
    text = 'data: {"choices":[{"delta":{"content":"é€"}}]}\ndata: {"choices":[{"delta":{"content":"!"}}]}\ndata: [DONE]'
    b = text.encode()
    chunks = [(1, "openai", i, bytearray(b[i * 7:(i + 1) * 7])) for i in range((len(b) + 6) // 7)]
    df = spark.createDataFrame(chunks, "rid int, provider string, chunk_no int, bytes binary")
    json_conf(spark)
    out = assemble(wire_deltas(reframe(df, ["rid", "provider"])), ["rid"]).collect()
    assert out[0]["text"] == "é€!"


def test_recover_json_cases():
    assert recover_one('  {"summary": "hello"}  ')[:2] == ('{"summary":"hello"}', "whole")
    assert recover_one('```json\n{"summary": "hello"}\n```')[1] == "fenced"
    assert recover_one('Here is the JSON: {"summary": "hello"} Done.')[1] == "braces"
    assert recover_one('Here is the result {as requested}: {"summary": "hello"}. Done!')[0] == '{"summary":"hello"}'
    assert recover_one("no json here")[2] == "No valid JSON object found in response"
    assert recover_one('{"a": {"b": 1}, bad} {"c": 2}')[0] == '{"c":2}'
    assert recover_one('{"x": NaN}')[0] is None


def test_typed_summary(spark):
    good = '{"title":"T","summary":"S","key_points":["a"],"action_items":[],"category":"article","importance":"low","extra":1}'
    bad = '{"summary":123,"key_points":["a",2],"action_items":[],"category":"blog","importance":"low"}'
    df = spark.createDataFrame([(1, good, None), (2, bad, None), (3, None, "No valid JSON object found in response")],
                               "id int, json string, reason string")
    json_conf(spark)
    out = {r["id"]: r for r in typed_summaries(df).collect()}
    assert out[1]["ok"] and out[1]["key_points"] == ["a"] and out[1]["title"] == "T"
    assert out[2]["reason"] == ("summary: Expected string, received number; key_points.1: Expected string, received "
                                "number; category: Invalid enum value. Expected 'article' | 'email' | 'newsletter' | "
                                "'unknown', received 'blog'")
    assert out[3]["reason"] == "No valid JSON object found in response"
