"""Results must not depend on partitioning, row order or micro-batch boundaries."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from textloom.operators.responses import assemble, json_conf, wire_deltas
from textloom.plans import derive
from textloom.plans.queries import QUERIES
from textloom.streaming.assemble import assemble_stream, replay_wire_lines, run_to_table


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_partitioning_does_not_change_results(spark):
    base = _rows(QUERIES["content_category"](spark, SF_SMALL))
    docs = derive.mixed_documents(spark, SF_SMALL).repartition(7).orderBy(F.desc("doc_id"))
    from textloom.functions.text import bound_text, content_category, js_trim
    again = docs.select("doc_id", "lang", "source", content_category(bound_text(js_trim("text"))).alias("category"))
    assert _rows(again) == base


def test_assembly_ignores_line_order(spark):
    json_conf(spark)
    lines = derive.wire_lines(spark, SF_SMALL)
    a = _rows(assemble(wire_deltas(lines), ["conv_id", "turn"]))
    b = _rows(assemble(wire_deltas(lines.repartition(5).orderBy(F.rand(7))), ["conv_id", "turn"]))
    assert a == b


def test_stream_batches_do_not_change_results(spark):
    lines = derive.wire_lines(spark, SF_SMALL).withColumn(
        "ts", F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 100 + F.col("turn") * 10 + F.col("seq")))
    one = run_to_table(spark, assemble_stream(replay_wire_lines(spark, lines, files=1), watermark="1 day"), "one")
    three = run_to_table(spark, assemble_stream(replay_wire_lines(spark, lines, files=3), watermark="1 day"), "three")
    assert _rows(one) == _rows(three)
    assert one.where(~F.col("complete")).count() == 0
