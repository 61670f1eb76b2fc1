"""Streamed answers in batch: re-frame byte chunks into lines (T1), pull the
text deltas out of each provider's wire format (T2-T4) and assemble them per
response (A1).

Lines are parsed with ``try_parse_json`` into VARIANT and read with
``try_variant_get``; ``schema_of_variant`` gives the JSON type test that
JavaScript's ``typeof x === "string"`` makes. All JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.text import js_trim

# Wire prefixes and markers of the three stream formats.
SSE_PREFIX = "data: "
OPENAI_DONE = "[DONE]"


def json_conf(spark: SparkSession) -> None:
    """JSON.parse keeps the last of duplicate keys; make VARIANT parsing do the same."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def strict_json(data: Column) -> Column:
    """``data`` as a VARIANT array whose first element is its value, or NULL where ``data`` is not exactly one JSON value.

    Spark's parser keeps to the grammar but stops after the first value, so what follows it would pass. Here the value is parsed as the first of two
    array elements, and the second is a hash of ``data``: if the text closes the array itself, or holds several values, the second
    element is not that hash. With ``json_conf`` the last of duplicate keys counts."""
    mark = F.xxhash64(data)
    pair = F.try_parse_json(F.concat(F.lit("["), data, F.lit(","), mark.cast("string"), F.lit("]")))
    return F.when(F.try_variant_get(pair, "$[1]", "bigint") == mark, pair)


def _string_at(v: Column, path: str) -> Column:
    """The value at ``path`` if it is a JSON string, else NULL."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x) == "STRING", x.cast("string"))


def _nonempty(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def _truthy(v: Column, path: str) -> Column:
    """JavaScript truthiness of the JSON value at ``path``."""
    x = F.try_variant_get(v, path, "variant")
    t = F.schema_of_variant(x)
    return (F.when(x.isNull() | (t == "VOID"), F.lit(False))
            .when(t == "BOOLEAN", x.cast("boolean"))
            .when(t == "STRING", F.length(x.cast("string")) > 0)
            .when(t.startswith("DECIMAL") | t.isin("BIGINT", "DOUBLE", "INT", "FLOAT"), x.cast("double") != 0)
            .otherwise(F.lit(True)))


SSE_PROVIDERS = ["openai", "openrouter", "anthropic"]


def wire_deltas(lines: DataFrame, provider: str = "provider", line: str = "line",
                is_tail: str = "is_tail") -> DataFrame:
    """Add ``delta`` to a table of wire lines, by the provider's wire rules.

    openai/openrouter (T2): ``data: `` lines; ``[DONE]``, empty and bad JSON
    skipped; choices[0].delta.content when a non-empty string; the
    unterminated tail is trimmed first and parsed the same way.
    anthropic (T3): ``data: `` lines holding a content_block_delta with a
    text_delta; the tail is dropped.
    ollama (T4): one JSON object per line; blank and ``done`` lines skipped;
    message.content when a non-empty string; the tail is parsed without the
    done test.

    JSON is taken only as the grammar has it (``strict_json``): white space around it is what JSON allows. Each line is trimmed and parsed
    once (staged projections), then the provider's fields are read from the parsed value.
    """
    p, ln = F.col(provider), F.col(line)
    tail = F.coalesce(F.col(is_tail), F.lit(False))
    sse = p.isin(*SSE_PROVIDERS)
    df = (lines
          .withColumn("__probe", F.when(sse & tail & p.isin("openai", "openrouter"), js_trim(ln)).otherwise(ln))
          .withColumn("__sse", F.col("__probe").startswith(SSE_PREFIX))
          .withColumn("__data", F.when(sse, js_trim(F.substring(F.col("__probe"), len(SSE_PREFIX) + 1, 1 << 30)))
                      .otherwise(F.when(tail, js_trim(ln)).otherwise(ln)))
          # Only an object can hold a delta; anything else need not be parsed.
          .withColumn("__v", F.when(F.ltrim(F.col("__data"), F.lit(" \t\r\n")).startswith("{"), strict_json(F.col("__data")))))
    v, data = F.col("__v"), F.col("__data")
    openai = F.when(F.col("__sse") & (data != OPENAI_DONE) & (data != ""),
                    _nonempty(_string_at(v, "$[0].choices[0].delta.content")))
    anthropic = F.when(~tail & F.col("__sse") & (data != "")
                       & (_string_at(v, "$[0].type") == "content_block_delta")
                       & (_string_at(v, "$[0].delta.type") == "text_delta"),
                       _nonempty(_string_at(v, "$[0].delta.text")))
    ollama = F.when((data != "") & ~(~tail & _truthy(v, "$[0].done")),
                    _nonempty(_string_at(v, "$[0].message.content")))
    delta = (F.when(p.isin("openai", "openrouter"), openai).when(p == "anthropic", anthropic)
             .when(p == "ollama", ollama))
    return df.withColumn("delta", delta).drop("__probe", "__sse", "__data", "__v")


def assemble(deltas: DataFrame, keys: list[str], order: str = "seq", delta: str = "delta",
             out: str = "text") -> DataFrame:
    """A1: concatenate each response's deltas in order. Responses with no
    delta give the empty string. Partial aggregation runs map-side."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(delta).alias("d"))))
    return deltas.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda s: s["d"]), "").alias(out))


SCAN_BLOCK = 1024


def reframe(chunks: DataFrame, keys: list[str], order: str = "chunk_no", data: str = "bytes") -> DataFrame:
    """Each response's byte chunks, cut anywhere, to its lines: keys + seq, line, is_tail. The last piece is the unterminated tail.

    A prefix scan in place of a gathered response. A chunk's line feeds cut it into pieces; the line number of a piece is the
    number of line feeds before it, in the chunk and in all earlier chunks of the response. Those are summed in two levels, inside
    blocks of ``SCAN_BLOCK`` chunk numbers and over the blocks' totals, so one very long response is many groups. Pieces between two line feeds
    of a chunk are whole lines and never move; only the first and last piece of each chunk are grouped, by line. No
    row holds more than one line.

    Bytes are split as Latin-1 text, one character a byte, and decoded line by line: a line feed is never part of
    another character. Malformed bytes become U+FFFD. A null chunk is empty; chunk numbers may have gaps."""
    raw = F.decode(F.coalesce(F.col(data), F.lit(b"")), "ISO-8859-1")
    cut = chunks.select(*keys, F.col(order).cast("long").alias("_o"), F.split(raw, "\n", -1).alias("_p"))
    # One exchange serves the scan in the blocks and their totals, so chunks are read once (both sides take the same columns).
    cut = cut.withColumn("_b", F.floor(F.col("_o") / SCAN_BLOCK).cast("long")).repartition(*keys, "_b").withColumn("_n", (F.size("_p") - 1).cast("long"))
    by_block = Window.partitionBy(*keys, "_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    by_key = Window.partitionBy(*keys)
    totals = cut.groupBy(*keys, "_b").agg(F.sum("_n").alias("_lines"), F.max("_o").alias("_hi"))
    earlier = F.sum("_lines").over(by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_tb"), "_hi", F.coalesce(earlier, F.lit(0)).alias("_before"),
                           F.sum("_lines").over(by_key).alias("_all"))
    same = (F.col("_b") == F.col("_tb")) & (F.col("_o") <= F.col("_hi"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = cut.withColumn("_first", F.coalesce(F.sum("_n").over(by_block), F.lit(0))).join(totals, same)
    pieces = placed.select(*keys, "_o", "_all", "_n", (F.col("_before") + F.col("_first")).alias("_at"), F.posexplode("_p").alias("_j", "_piece"))
    number = (F.col("_at") + F.col("_j")).alias("seq")
    inner = (F.col("_j") > 0) & (F.col("_j") < F.col("_n"))
    text = lambda c: F.make_valid_utf8(c.cast("string"))
    whole = pieces.where(inner).select(*keys, number, text(F.encode("_piece", "ISO-8859-1")).alias("line"), F.lit(False).alias("is_tail"))
    ends = pieces.where(~inner).select(*keys, number, "_all", F.struct(F.col("_o").alias("o"), F.hex(F.encode("_piece", "ISO-8859-1")).alias("h")).alias("_e"))
    joined = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list("_e")), lambda e: e["h"]), ""))
    edges = ends.groupBy(*keys, "seq").agg(text(joined).alias("line"), F.first("_all").alias("_all"))
    return edges.select(*keys, "seq", "line", (F.col("seq") == F.col("_all")).alias("is_tail")).unionByName(whole)


def to_wire_lines(deltas: DataFrame | None, provider: Column, delta: str = "delta") -> Column:
    """Wrap one delta as a provider wire line (the inverse of the parsers;
    used to replay stored answers and in round-trip tests)."""
    d = F.col(delta)
    openai = F.concat(F.lit(SSE_PREFIX), F.to_json(F.struct(F.array(F.struct(
        F.struct(d.alias("content")).alias("delta"))).alias("choices"))))
    anthropic = F.concat(F.lit(SSE_PREFIX), F.to_json(F.struct(F.lit("content_block_delta").alias("type"),
                                                               F.struct(F.lit("text_delta").alias("type"),
                                                                        d.alias("text")).alias("delta"))))
    ollama = F.to_json(F.struct(F.struct(F.lit("assistant").alias("role"), d.alias("content")).alias("message"),
                                F.lit(False).alias("done")))
    return (F.when(provider.isin("openai", "openrouter"), openai).when(provider == "anthropic", anthropic)
            .when(provider == "ollama", ollama))


END_MARKERS = {"openai": SSE_PREFIX + OPENAI_DONE, "anthropic": SSE_PREFIX + '{"type":"message_stop"}',
               "ollama": '{"done":true}'}
