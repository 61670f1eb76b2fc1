"""Input resolution and input-side gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import MAX_DOWNLOAD_SIZE, bound_text, js_trim
from textloom.functions.url import REASON_PRIVATE, with_url_screen
from textloom.sources.heads import file_heads

# Limits and messages of the reference.
MAX_STDIN_BYTES = 10 * 1024 * 1024
MAX_DIFF_BYTES = 10 * 1024 * 1024
WARN_DIFF_BYTES = 8 * 1024 * 1024
NO_INPUT = "No input provided"
NO_STDIN = "No input provided via stdin"
NO_CHANGES = "No changes found in diff"
MISSING_REF = "Missing required ref for commit diff"


def byte_gate(df: DataFrame, column: str, limit: int = MAX_STDIN_BYTES, reason: str | None = None) -> DataFrame:
    """Flag rows whose UTF-8 size exceeds ``limit`` (kept, with a reason)."""
    msg = reason or f"Input exceeds {limit} bytes"
    over = F.coalesce(F.octet_length(F.col(column)) > limit, F.lit(False))
    return df.withColumn("gate_reason", F.when(over, F.lit(msg))).withColumn("gate_ok", ~over)


def read_text_corpus(spark: SparkSession, path: str, glob: str = "*", limit: int = MAX_DOWNLOAD_SIZE) -> DataFrame:
    """Files as items. The first ``limit`` bytes are decoded leniently
    (malformed bytes become U+FFFD), blank files are rejected, the rest is
    trimmed and bounded. One row per file; of a larger file no more than the limit is read
    (``file_heads``)."""
    raw = file_heads(spark, path, limit, glob)
    # Lenient UTF-8: malformed bytes become U+FFFD (``decode`` would fail).
    text = F.make_valid_utf8(F.col("head").cast("string"))
    return (raw.select(F.col("path").alias("source"), text.alias("_t"))
            .withColumn("ok", F.length(js_trim("_t")) > 0)
            .withColumn("reason", F.when(~F.col("ok"), F.concat(F.lit("File is empty: "), F.col("source"))))
            .withColumn("content", F.when(F.col("ok"), bound_text(js_trim("_t"))))
            .drop("_t"))


def _or_nothing(key: str, by: Column) -> Column:
    """A join key that is never NULL: rows without one get one of many that nothing bears, so they spread over all partitions."""
    return F.coalesce(F.col(key), F.concat(F.lit("\x00"), F.pmod(F.xxhash64(by), F.lit(1 << 16)).cast("string")))


def resolve_inputs(requests: DataFrame, snapshots: DataFrame | None = None, files: DataFrame | None = None,
                   args: str = "args", piped: str = "piped") -> DataFrame:
    """S3: the reference's input precedence, per request row.

    ``args`` is the argument list (array<string>), ``piped`` the piped text.
    Order: no arguments -> piped text; first argument ``-`` -> piped text; an
    http(s) URL -> the page snapshot with that URL (``page_snapshots`` output,
    joined on ``source``); a single argument naming a row of ``files`` (path,
    content, ok, reason) -> that file; otherwise the arguments joined by a
    space. Output: ``kind``, ``source``, ``content``, ``ok``, ``reason``.
    """
    a = F.col(args)
    first = F.try_element_at(a, F.lit(1))  # NULL for an empty argument list
    n = F.coalesce(F.size(a), F.lit(0))
    piped_text = F.col("_piped_t")
    joined = F.col("_joined_t")
    looks_url = (F.col("_first").isNotNull()
                 & F.coalesce(F.col("_f_ok") | (F.col("_f_reason") == REASON_PRIVATE), F.lit(False)))
    kind = (F.when(n <= 0, F.lit("stdin"))
            .when(first == "", F.lit("empty"))
            .when(first == "-", F.lit("stdin"))
            .when(looks_url, F.lit("url")))
    # Only a value that starts with a scheme can be a URL; the full screen
    # (several regexes) runs on those alone, not on long argument texts.
    df = (requests.withColumn("_first", F.when(first.rlike(r"^[\x00-\x20]*[A-Za-z][A-Za-z0-9+.\-]*:"), first))
          .withColumn("_piped_t", js_trim(F.coalesce(F.col(piped), F.lit(""))))
          .withColumn("_joined_t", js_trim(F.array_join(a, " ")))
          .transform(lambda d: with_url_screen(d, "_first", prefix="_f_"))
          .withColumn("kind", kind).withColumn("_key", F.when(F.col("kind") == "url", first))
          .drop("_first", "_f_scheme", "_f_host", "_f_ok", "_f_reason"))
    if files is not None:
        f = files.select(F.col("path").alias("_fpath"), F.col("content").alias("_fcontent"),
                         F.col("ok").alias("_fok"), F.col("reason").alias("_freason"))
        df = (df.withColumn("_fkey", F.when(F.col("kind").isNull() & (n == 1), first))
              .join(f, _or_nothing("_fkey", F.col("_joined_t")) == F.col("_fpath"), "left")
              .withColumn("kind", F.coalesce(F.col("kind"), F.when(F.col("_fpath").isNotNull(), F.lit("file")))))
    else:
        df = df.withColumn("_fpath", F.lit(None).cast("string")).withColumn("_fcontent", F.lit(None).cast("string")) \
            .withColumn("_fok", F.lit(None).cast("boolean")).withColumn("_freason", F.lit(None).cast("string"))
    if snapshots is not None:
        s = snapshots.select(F.col("source").alias("_ukey"), F.col("content").alias("_ucontent"),
                             F.col("ok").alias("_uok"), F.col("reason").alias("_ureason"))
        df = df.join(s, _or_nothing("_key", F.col("_joined_t")) == F.col("_ukey"), "left")
    else:
        df = df.withColumn("_ucontent", F.lit(None).cast("string")).withColumn("_uok", F.lit(None).cast("boolean")) \
            .withColumn("_ureason", F.lit(None).cast("string")).withColumn("_ukey", F.lit(None).cast("string"))
    df = df.withColumn("kind", F.coalesce(F.col("kind"), F.lit("argument")))
    k = F.col("kind")
    reason = (F.when(k == "empty", F.lit(NO_INPUT))
              .when((k == "stdin") & (n > 0) & (F.length(piped_text) == 0), F.lit(NO_STDIN))
              .when((k == "stdin") & (F.length(piped_text) == 0), F.lit(NO_INPUT))
              .when(k == "url", F.when(F.col("_ukey").isNull(), F.lit("Failed to fetch URL: no snapshot"))
                    .otherwise(F.col("_ureason")))
              .when(k == "file", F.col("_freason"))
              .when((k == "argument") & (F.length(joined) == 0), F.lit(NO_INPUT)))
    content = (F.when(k == "stdin", bound_text(piped_text))
               .when(k == "url", F.col("_ucontent"))
               .when(k == "file", F.col("_fcontent"))
               .when(k == "argument", bound_text(joined)))
    source = (F.when(k == "stdin", F.lit("stdin")).when(k.isin("url", "file"), first)
              .when(k == "argument", F.lit("argument")))
    return (df.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())
            .withColumn("content", F.when(F.col("ok"), content))
            .withColumn("source", F.when(F.col("ok"), source))
            .drop("_key", "_ukey", "_ucontent", "_uok", "_ureason", "_fkey", "_fpath", "_fcontent", "_fok",
                  "_freason", "_piped_t", "_joined_t"))


def transcripts(turns: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """One transcript per conversation, lines joined by newline in turn
    order, trimmed; empty transcripts are rejected. Partial aggregation runs
    map-side; only one conversation's lines meet in a group."""
    agg = (turns.groupBy(key)
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text)))),
                                         lambda s: s[text]), "\n").alias("_t")))
    return (agg.withColumn("transcript", js_trim("_t"))
            .withColumn("ok", F.length("transcript") > 0)
            .withColumn("reason", F.when(~F.col("ok"), F.lit("No meeting notes provided.")))
            .drop("_t"))


def patches(df: DataFrame, kind: str = "kind", ref: str = "ref", diff: str = "diff") -> DataFrame:
    """Trim, reject empty, warn above 8 MiB, reject above 10 MiB, commit needs a ref."""
    df = df.withColumn("_d", js_trim(F.coalesce(F.col(diff), F.lit(""))))
    d = F.col("_d")
    size = F.octet_length(F.col(diff))
    reason = (F.when((F.col(kind) != "staged") & (F.coalesce(F.col(ref), F.lit("")) == ""), F.lit(MISSING_REF))
              .when(size > MAX_DIFF_BYTES,
                    F.lit("Diff too large (exceeds 10MB limit). Consider analyzing specific files or commits separately."))
              .when(F.length(d) == 0, F.lit(NO_CHANGES)))
    status = F.when(reason.isNotNull(), "reject").when(F.octet_length(d) > WARN_DIFF_BYTES, "warn").otherwise("ok")
    return (df.withColumn("reason", reason).withColumn("patch", F.when(F.col("reason").isNull(), d))
            .withColumn("status", F.when(F.col("reason").isNotNull(), "reject")
                        .when(F.octet_length(d) > WARN_DIFF_BYTES, "warn").otherwise("ok")).drop("_d"))
