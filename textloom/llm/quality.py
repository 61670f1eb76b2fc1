"""Quality rules: hard limits, then importance scoring with hashed n-grams. DataFrame operations only.

Score of a text: the log-likelihood ratio between two multinomials over hashed
words and word pairs, one counted over trusted documents and one over the whole
raw corpus, divided by the number of n-grams. Documents below a threshold go.
Ratios are rounded to whole millionths and summed as integers, so the verdict
does not depend on partitioning or order.

The raw counts cover every document. The trusted sample is bounded: at most
``max_trusted`` identifiers with quality 1 (those with the smallest hashes),
which is what is broadcast. A fifth of it is held out: the threshold is ``MARGIN`` below the score
that all but a share ``LOWEST`` of these documents reach, so documents like the trusted ones
stay at every corpus size. With no trusted document every ratio and threshold is 0.

Words are runs of anything but ASCII white space in whole texts. Null texts have
no words: all counts are 0, and they fail the base rule. Repeated rows count each
time. Null identifiers are never trusted. An empty table gives no rows.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.stage import pin
from textloom.llm.common import WS

BUCKETS = 1 << 16
MAX_TRUSTED = 20_000
LOWEST, MARGIN = 0.005, 0.05
HELD_OUT = 5  # one fold in so many
SCALE = 1_000_000
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5


def _words(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """(doc_id, carried columns, text, words): words split at ASCII white space."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carry)
    return pin(d.withColumn("words", F.filter(F.split(F.regexp_replace("text", WS, " "), " "), lambda w: w != "")), ["words"])


def base_features(words: DataFrame) -> DataFrame:
    """Adds the base counts and base_failed to (doc_id, text, words, hashes)."""
    n = F.size("words")
    five = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]))
    d = pin(words.withColumn("five", F.when(n >= WINDOW, five).otherwise(F.array().cast("array<bigint>"))), ["five"])
    # Only texts with a repeated window pay for the sort that finds where they are.
    found = F.sort_array(F.transform("five", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    none = F.expr("cast(array() as array<struct<x:bigint,i:int>>)")
    d = pin(d.withColumn("found", F.when(F.size(F.array_distinct("five")) < F.size("five"), found).otherwise(none)), ["found"])
    same = lambda s, j, k: F.get("found", j + k)["x"].eqNullSafe(s["x"])
    d = pin(d.withColumn("at", F.sort_array(F.transform(
        F.filter("found", lambda s, j: same(s, j, -1) | same(s, j, 1)), lambda s: s["i"]))), ["at"])
    covered = F.aggregate(F.transform("at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - p, F.lit(WINDOW)))),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = pin(d.withColumn("lines", lines), ["lines"])
    out = d.select(
        "*", n.cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                          | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _hashed(words: DataFrame) -> DataFrame:
    """Adds hashes (per word) and grams (buckets of words and word pairs)."""
    d = pin(words.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))), ["hashes"])
    grams = F.concat(F.transform("hashes", lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")),
                     F.transform(F.slice("hashes", 2, F.greatest(F.size("hashes"), F.lit(1))),
                                 lambda h, i: F.pmod(F.xxhash64(F.get("hashes", i), h), F.lit(BUCKETS)).cast("int")))
    return pin(d.withColumn("grams", grams), ["grams"])


def _scored(grams: DataFrame, ratios: list[int]) -> DataFrame:
    """Adds score_sum and n_grams."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")  # folds to one literal
    return (grams.withColumn("score_sum", F.aggregate("grams", F.lit(0).cast("long"), lambda a, g: a + F.get(table, g)))
            .withColumn("n_grams", F.size("grams").cast("long")))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        max_trusted: int = MAX_TRUSTED) -> tuple[list[int], int]:
    """Fixed-point log ratio per bucket (BUCKETS integers, whatever the corpus size) and fixed-point threshold."""
    fold = F.pmod(F.xxhash64("trusted_id", F.lit(HELD_OUT)), F.lit(HELD_OUT))
    trusted = (labels.where("quality = 1").select(F.col("doc_id").alias("trusted_id")).distinct()
               .orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(max_trusted).withColumn("fold", fold))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    mine = lambda how: d.join(F.broadcast(trusted), d["doc_id"] == trusted["trusted_id"], how)
    good = mine("left").withColumn("good", F.coalesce((F.col("fold") > 0).cast("int"), F.lit(0)))
    grams = _hashed(_words(good, "doc_id", "text", ["good"])).select("good", F.explode("grams").alias("b"))
    rows = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("good").alias("good")).collect()  # at most BUCKETS rows
    raw, liked = [0] * BUCKETS, [0] * BUCKETS
    for r in rows:
        raw[r["b"]], liked[r["b"]] = r["raw"], r["good"]
    n_raw, n_liked = sum(raw) + BUCKETS, sum(liked) + BUCKETS
    if n_liked == BUCKETS:
        return [0] * BUCKETS, 0
    ratios = [round(SCALE * log(((g + 1) / n_liked) / ((r + 1) / n_raw))) for g, r in zip(liked, raw)]
    held = _scored(_hashed(_words(mine("inner").where("fold = 0"), "doc_id", "text", [])), ratios)
    mean = F.expr("score_sum div n_grams")
    low = held.where(f"size(words) >= {MIN_WORDS}").agg(F.percentile(mean, LOWEST).alias("low")).first()["low"]
    return ratios, round((low or 0) - MARGIN * SCALE)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  max_trusted: int = MAX_TRUSTED, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_grams, score, kept)
    per row of ``docs``; ``carry`` adds columns of ``docs`` whose names do not clash with these."""
    carry = carry or []
    ratios, threshold = fit(docs, labels, id_col, text_col, max_trusted)
    d = pin(_scored(base_features(_hashed(_words(docs, id_col, text_col, carry))), ratios), ["score_sum", "n_grams", "base_failed"])
    good = F.col("score_sum") >= F.lit(threshold) * F.col("n_grams")
    return d.select("doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    "n_grams", (F.col("score_sum") / F.greatest("n_grams", F.lit(1)) / SCALE).alias("score"),
                    (~F.col("base_failed") & good).alias("kept"))
