"""Screens and argv building, with the reference's accept/reject lists."""

from pyspark.sql import functions as F

from textloom.functions import screens as S
from textloom.operators.audit import expand_templates


def _eval(spark, expr, values, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r["r"] for r in df.select(expr(F.col("v")).alias("r")).collect()]


def test_commands(spark):
    bad = ["a && b", "a || b", "a; b", "echo $(whoami)", "echo `whoami`", "sudo ls", "rm -rf x", "echo > /dev/null", "",
           "x" * 501]
    good = ["claude -p 'Review: $@'", "amp -x \"Explain: ` $@ `\"", "gemini --prompt 'What is $@?'"]
    assert _eval(spark, S.is_safe_command, bad) == [False] * len(bad)
    assert _eval(spark, S.is_safe_command, good) == [True] * len(good)


def test_arguments(spark):
    ok = [["src/file.ts", "--flag=value", "@scope/pkg", "[a]", "{b}"], [], ["x" * 200]]
    bad = [[";"], ["a|b"], ["x" * 201]]
    got = _eval(spark, lambda c: F.size(S.argument_rules(c)) == 0, ok + bad, "v array<string>")
    assert got == [True] * 3 + [False] * 3


def test_paths(spark):
    cases = {"out.md": None, "./out.md": None, "docs/out.md": None, "/etc/x": "absolute", "C:/x": "absolute",
             "C:x": "absolute", "a/.git/x": "hidden", "../x": "escape", "a/../b": "escape", "etc/x": "protected",
             "Home/x": "protected", "con.txt": "protected", "a/lpt1": "protected", "  ": "escape", ".": "escape",
             "project/etc/x": None}
    got = _eval(spark, S.path_reason, list(cases))
    assert dict(zip(cases, got)) == cases


def test_refs(spark):
    got = _eval(spark, lambda c: F.size(S.ref_rules(c)) == 0, ["HEAD~1", "origin/main", "main;rm", "-rf", "a..b"])
    assert got == [True, True, False, False, False]


def test_tokens(spark):
    got = _eval(spark, S.command_tokens, ["amp -x \"a b\" c'd e'f  g", "'open", ""])
    assert got == [["amp", "-x", "\"a b\"", "c'd e'f", "g"], ["'open"], []]


def test_expand(spark):
    rows = [("fake-ai --mode plan", [], "hello world"), ("fake-ai --help", [], ""),
            ("fake-ai -x 'Review: $@'", [], "a b\nc"), ('amp -x "Explain: $@"', ["x"], None),
            ("tool --flag 'value with spaces'", [], "payload"), ("claude -p 'Review $@ and $@'", ["f.ts"], None),
            ("$@", ["printf-value"], None), ("fake-ai $@", [], None)]
    df = spark.createDataFrame(rows, "command string, args array<string>, piped string")
    out = [(r["cmd"], r["argv"], r["reason"]) for r in expand_templates(df).collect()]
    assert out[0] == ("fake-ai", ["--mode", "plan", "hello world"], None)
    assert out[1] == ("fake-ai", ["--help"], None)
    assert out[2] == ("fake-ai", ["-x", "Review: a b\nc"], None)
    assert out[3] == ("amp", ["-x", "Explain: x"], None)
    assert out[4] == ("tool", ["--flag", "value with spaces", "payload"], None)
    assert out[5][2].startswith("Template command should contain at most one $@")
    assert out[6] == ("printf-value", [], None)
    assert out[7][2] == "This template requires input."
