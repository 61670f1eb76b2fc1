"""Exact dedup by a tree-merge of digest runs, in DataFrame operations only.

Rows are dealt to runs by a hash of their identifier, so the copies of one text
spread over all runs. Each run keeps one entry per text: digest, length, second
hash, smallest identifier and count. Rounds then merge ``fan_in`` neighbouring
runs until one is left; a key meets at most ``fan_in`` entries per round,
however many copies there are. The verdict returns down the same tree, again by
joins in which a key has few rows. Only digests travel, never texts.

Null texts count as empty. Rows that share the smallest identifier of their text
all stay. Null identifiers rank last; a group of them alone has keep_id null and
all of it stays. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import WS, cut, partitions

KEY = ["digest", "length", "check"]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 4,
                runs: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row per row of ``docs``.

    Texts are equal when identical after each run of ASCII white space became
    one space; entries merge only where SHA-256, length and a second hash all
    agree. ``runs`` defaults to the session's shuffle partitions, rounded up to
    a power of ``fan_in``.
    """
    spark = docs.sparkSession
    runs, depth = runs or partitions(spark), 0
    while fan_in ** depth < runs:
        depth += 1
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WS, " ")
    rows = cut(docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
               .select("id", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"), F.length("norm").alias("length"),
                       F.xxhash64("norm").alias("check"),
                       F.pmod(F.xxhash64("id"), F.lit(fan_in ** depth)).alias("run")), "runs")
    levels = [cut(rows.groupBy(*KEY, "run").agg(F.min("id").alias("keep"), F.count("*").alias("n")), "runs")]
    for _ in range(depth):
        merged = levels[-1].withColumn("run", F.expr(f"run div {fan_in}"))
        levels.append(cut(merged.groupBy(*KEY, "run").agg(F.min("keep").alias("keep"), F.sum("n").alias("n")), "runs"))
    verdict = levels.pop()
    while levels:
        child = levels.pop().select(*KEY, "run", F.expr(f"run div {fan_in}").alias("up"))
        verdict = child.join(verdict.withColumnRenamed("run", "up"), [*KEY, "up"]).select(*KEY, "run", "keep", "n")
    return rows.join(verdict, [*KEY, "run"]).select(
        F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
