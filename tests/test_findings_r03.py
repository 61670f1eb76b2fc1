"""Work a row or a core that the third round's findings are about: plans and files, not clocks."""

import glob
import os

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import screens as S
from textloom.functions.text import utf16_length
from textloom.operators.answers import recover_json
from textloom.operators.audit import audit_log, rule_counts
from textloom.plans import derive
from textloom.session import ensure_checkpoint_dir
from textloom.streaming.assemble import replay_chunks, replay_wire_lines


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abZ09 .,;&|$(`>/-\n éЖ\U0001F642sudormf", max_size=40), min_size=1, max_size=60))
def test_guards_and_named_classes_decide_as_the_plain_patterns(spark, texts):
    texts += ["", " ", "x" * 500, "x" * 501, "\U0001F642" * 250, "\U0001F642" * 251, "Ж" * 500, "a sudo b", "pseudo", "rm  -rf x", "> /dev", "`ls`", "`", None]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    t = F.col("text")
    plain = F.array_compact(F.array(
        F.when(F.length(t) == 0, F.lit("empty")), F.when(utf16_length(t) > S.MAX_COMMAND_LENGTH, F.lit("too_long")),
        F.when((F.length(t) > 0) & ~t.rlike(S.SAFE_COMMAND), F.lit("characters")), *[F.when(t.rlike(p), F.lit(n)) for n, p in S.DANGEROUS]))
    same_text = F.regexp_replace("text", derive.NOT_LETTERS_OR_SPACE, "").eqNullSafe(F.regexp_replace("text", "[^A-Za-z ]", ""))
    same_words = F.regexp_replace("text", derive.NOT_LETTERS, "/").eqNullSafe(F.regexp_replace("text", "[^A-Za-z]+", "/"))
    args = F.array(t, F.lit("ok"))
    plain_args = F.array_compact(F.array(F.when(~t.rlike(S.SAFE_ARGUMENT), F.lit("characters")), F.when(utf16_length(t) > S.MAX_ARGUMENT_LENGTH, F.lit("too_long"))))
    trimmed = d.where("text is null or text = '' or text rlike '^[!-~][^\\\\s\\\\u00a0]*$'")  # command_rules trims first
    assert trimmed.where(~S.command_rules("text").eqNullSafe(plain)).count() == 0
    assert d.where(~same_text | ~same_words | ~S.argument_rules(args).eqNullSafe(plain_args)).count() == 0


def test_commands_are_cut_with_the_fast_class(spark, tmp_path):
    spark.createDataFrame([(1, "Ab, c1. dЖe")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    log = derive.command_log(spark, str(tmp_path))
    assert "[^A-Za-z" not in plan(log) and "[^A-Za-z" not in plan(derive.template_requests(spark, str(tmp_path)))
    assert [r["command"] for r in log.orderBy("piece").collect()] == ["Ab c || true", " de || true"]


def test_rules_are_checked_once_a_row(spark):
    d = spark.createDataFrame([("ls; rm -rf x",), ("ls",)], "command string")
    counts = rule_counts(audit_log(d, S.command_rules("command")))
    filters = [line for line in plan(counts.select("rule")).splitlines() if "Filter" in line]
    assert not [line for line in filters if "RLIKE" in line]
    assert {r["rule"]: r["n"] for r in counts.collect()} == {"separator": 1, "rm_rf": 1, "characters": 1}


def test_answers_pass_through_python_in_small_batches(spark):
    d = spark.createDataFrame([(1, '{"a":"\U0001F642\\ud800"}'), (2, None), (3, 'x {"b":1}')], "doc_id long, raw string")
    out = recover_json(d)
    assert "BatchEvalPython" in plan(out) and "ArrowEvalPython" not in plan(out)
    got = {r["doc_id"]: (r["json"], r["route"]) for r in out.collect()}
    assert got == {1: ('{"a":"\U0001F642\\ud800"}', "whole"), 2: (None, None), 3: ('{"b":1}', "braces")}


def test_replays_are_written_and_read_by_all_cores(spark):
    rows = spark.range(4000).select((F.col("id") % 40).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("openai").alias("provider"), F.col("id").alias("seq"))
    cores = spark.sparkContext.defaultParallelism
    for replay, name, rename in ((replay_wire_lines, "wire", "seq"), (replay_chunks, "chunks", "chunk_no")):
        folder = os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-*")
        before = set(glob.glob(folder))
        replay(spark, rows.withColumnRenamed("seq", rename), files=3)
        new, = set(glob.glob(folder)) - before
        assert len(glob.glob(os.path.join(new, "*.parquet"))) == 3 * cores
