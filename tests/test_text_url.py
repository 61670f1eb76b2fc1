from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import url as U


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


def test_js_trim_and_collapse(spark):
    assert _one(spark, T.js_trim, "  a  b ﻿\n") == "a  b"
    assert _one(spark, T.collapse_ws, "a  b\n\nc") == "a b c"
    assert _one(spark, T.js_trim_end, "  x \u0085") == "  x \u0085"


def test_utf16_length_and_bound(spark):
    assert _one(spark, T.utf16_length, "a\U0001F600b") == 4
    assert _one(spark, T.bound_text, "x" * 12000) == "x" * 12000
    assert _one(spark, T.bound_text, "x" * 11999 + " " + "y" * 10) == "x" * 11999
    # a supplementary character straddling the cut is dropped whole
    s = "x" * 11999 + "\U0001F600" + "z"
    assert _one(spark, T.bound_text, s) == "x" * 11999


def test_html_to_text(spark):
    html = ("<html><head><style>p{}</style><SCRIPT>var a='<b>';</script></head>"
            "<body><p>A&amp;lt;B &nbsp; &quot;q&quot; &#39;s&#39;</p>\n<p>end</p></body></html>")
    assert _one(spark, T.page_text, html) == "A<B \"q\" 's' end"
    assert _one(spark, T.is_html, "  <!DOCTYPE html><p>x") is True
    assert _one(spark, T.is_html, "plain") is False


def test_category(spark):
    cases = [("From: a@b.c\nSubject: hi\n\nbody", "email"), ("x\nsubject: y", "email"),
             ("Click to Unsubscribe", "newsletter"), ("Issue #12 is out", "newsletter"),
             ("we subscribe now", "newsletter"), ("résubscribe", "newsletter"), ("xsubscribe", "unknown"),
             ("Dear team,", "email"), ("Plain text", "unknown"), ("xsubject: y", "unknown")]
    for text, want in cases:
        assert _one(spark, T.content_category, text) == want, text


URL_CASES = [
    ("https://example.com/a", True, None),
    ("http://127.0.0.1/secret", False, U.REASON_PRIVATE),
    ("http://localhost/secret", False, U.REASON_PRIVATE),
    ("http://169.254.169.254/", False, U.REASON_PRIVATE),
    ("http://2130706433/secret", False, U.REASON_PRIVATE),
    ("http://0x7f000001/secret", False, U.REASON_PRIVATE),
    ("http://0/secret", False, U.REASON_PRIVATE),
    ("http://2852039166/", False, U.REASON_PRIVATE),
    ("http://0x7f.0.0.1/secret", False, U.REASON_PRIVATE),
    ("http://10.1/", False, U.REASON_PRIVATE),
    ("http://8.8.8.8/", True, None),
    ("http://[::1]/", False, U.REASON_PRIVATE),
    ("http://metadata.google.internal/x", False, U.REASON_PRIVATE),
    ("http://a.metadata.google.internal/x", False, U.REASON_PRIVATE),
    ("http://fda.gov/", True, None),
    ("ftp://example.com/file", False, U.REASON_SCHEME),
    ("mailto:a@b.c", False, U.REASON_SCHEME),
    ("not a url", False, U.REASON_INVALID),
    ("http://", False, U.REASON_INVALID),
    ("http://256.256.256.256/", False, U.REASON_INVALID),
    ("http://09.1.1.1/", False, U.REASON_INVALID),
    ("http://user:pw@LOCALHOST:8080/", False, U.REASON_PRIVATE),
    ("http://example.com:99999/", False, U.REASON_INVALID),
]


def test_url_parts(spark):
    df = spark.createDataFrame([(u,) for u, _, _ in URL_CASES], "u string")
    got = {r["u"]: (r["p"]["ok"], r["p"]["reason"]) for r in df.select("u", U.url_parts("u").alias("p")).collect()}
    for u, ok, reason in URL_CASES:
        assert got[u] == (ok, reason), u
