"""Property test: JavaScript trim, UTF-16 length and the 12,000-unit bound,
checked against a direct Python statement of the JavaScript semantics on
random strings (one Spark job for all examples)."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions.text import JS_WS_CHARS, bound_text, js_trim, utf16_length

ALPHABET = list("ab \t\n\r") + [" ", "\u0085", " ", "﻿", "é", "\U0001F600", "\x0b"]


def js_len(s: str) -> int:
    return len(s.encode("utf-16-le")) // 2


def js_bound(s: str, limit: int) -> str:
    if js_len(s) <= limit:
        return s
    units = s.encode("utf-16-le")[: 2 * limit]
    if len(units) >= 2 and 0xD8 <= units[-1] <= 0xDB:  # high surrogate left alone at the end
        units = units[:-2]
    return units.decode("utf-16-le").rstrip(JS_WS_CHARS)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, min_size=0, max_size=40), min_size=150, max_size=150))
def test_text_primitives(spark, samples):
    limit = 7  # small limit so cuts (and split surrogate pairs) occur often
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    out = df.select("i", js_trim("s").alias("t"), utf16_length("s").alias("n"),
                    bound_text(F.col("s"), limit).alias("b")).collect()
    for r in out:
        s = samples[r["i"]]
        assert r["t"] == s.strip(JS_WS_CHARS), repr(s)
        assert r["n"] == js_len(s), repr(s)
        assert r["b"] == js_bound(s, limit), repr(s)
