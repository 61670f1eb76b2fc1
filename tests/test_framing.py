"""Lines from byte chunks by a prefix scan, and JSON as the grammar has it, against plain Python."""

import json
import re

import pytest
from pyspark.sql import functions as F

from textloom.operators import responses as R

KEYS = ["conv_id", "turn"]


def brute(chunks):
    whole = {}
    for c, t, _, b in sorted(chunks, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        whole[c, t] = whole.get((c, t), b"") + (b or b"")
    return sorted(((c, t, k, x.decode("utf-8", "replace"), k == n) for (c, t), raw in whole.items()
                   for n in [raw.count(b"\n")] for k, x in enumerate(raw.split(b"\n"))), key=repr)


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_reframe(spark, monkeypatch, block):
    monkeypatch.setattr(R, "SCAN_BLOCK", block)
    raws = [b"", b"\n", b"\n\n\n", "né\n🙂日本\nend".encode(), b"no line feed at all " * 9, b"bad \xff\xe2\x82\nrest \xf0\x9f", b"hot\n" * 500, b"x\n" + b"y" * 3000 + b"\nz"]
    chunks = [(i, i % 2, k, raw[at:at + size]) for i, raw in enumerate(raws) for size in [1 + i % 4] for k, at in enumerate(range(0, max(1, len(raw)), size))]
    chunks += [(90, 0, 7, b"gaps\n"), (90, 0, -5, b"in "), (90, 0, 1 << 40, b"!"), (91, 0, 0, None), (None, 1, 0, b"null\nkey")]
    df = spark.createDataFrame(chunks, "conv_id long, turn long, chunk_no long, bytes binary").repartition(5)
    got = R.reframe(df, KEYS)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(chunks)
    assert R.reframe(df.limit(0), KEYS).count() == 0
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "bigint", "string", "boolean"]


def test_no_row_holds_a_response(spark):
    """The largest group that is collected is a line's, not a response's."""
    df = spark.range(4000).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.col("id").alias("chunk_no"), F.lit(b"ab\ncd\nef").alias("bytes"))
    plan = R.reframe(df, KEYS)._jdf.queryExecution().executedPlan().toString()
    groups = re.findall(r"ObjectHashAggregate\(keys=\[([^\]]*)\]", plan)
    assert groups and all("seq" in g for g in groups)
    assert R.reframe(df, KEYS).count() == 8001


BAD = ["{'a':1}", "{a:1}", '{"a":1} x', '{"a":1} x}', '{"a":1},{"b":2}', '{"a":1},0]}', '{"a":1}]', '{"a":01}', '{"a":NaN}', '{"a":1,}', "{", "", '{"a":"\t"}',
       '{"a":"\\x"}', " {}", "{} ", '{"a" 1}', "[1,2", "tru", '{"a":1}//', "1,2", "1 2"]
GOOD = ["{}", ' {"a":1}\r\n', '{"a":{"b":[1,"]",{"c":"}"}]}}', '"x"', "1", "null", "[1,2]", '{"a":"\\u00e9\\n"}', '{"a":1e3}']


def test_strict_json(spark):
    R.json_conf(spark)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(BAD + GOOD)], "i int, t string")
    got = {r["i"]: r["v"] for r in df.select("i", F.to_json(R.strict_json(F.col("t"))).alias("v")).collect()}
    for i, t in enumerate(BAD + GOOD):
        if i < len(BAD):
            assert got[i] is None, t
        else:
            assert json.loads(got[i])[0] == json.loads(t), t
    dup = spark.createDataFrame([('{"a":1,"b":0,"a":2}',)], "t string")
    assert dup.select(F.try_variant_get(R.strict_json(F.col("t")), "$[0].a", "int")).first()[0] == 2


def test_wire_lines_with_faults(spark):
    R.json_conf(spark)
    say = '{"message":{"content":"hi"}}'
    lines = [(say, False, "hi"), (say + " }", False, None), (say + say, False, None), (" " + say, False, None), (" " + say, True, "hi"), (" " + say + "\r", False, "hi"),
             ('{"message":{"content":"no"},"message":{"content":"hi"}}', False, "hi"), ('{"message":{"content":"x"},"done":true}', False, None),
             ('{"message":{"content":"x"},"done":true}', True, "x"), ("{'message':{'content':'x'}}", False, None)]
    df = spark.createDataFrame([(i, "ollama", line, tail) for i, (line, tail, _) in enumerate(lines)], "i int, provider string, line string, is_tail boolean")
    assert {r["i"]: r["delta"] for r in R.wire_deltas(df).collect()} == {i: d for i, (*_, d) in enumerate(lines)}
