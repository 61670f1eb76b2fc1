"""RFC 3986's examples, web spellings, and addresses by value."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import address as A
from textloom.functions.reference import resolve_reference
from textloom.functions.url import REASON_INVALID, REASON_PRIVATE, url_parts, with_url_screen

# RFC 3986, sections 5.4.1 and 5.4.2, against http://a/b/c/d;p?q
EXAMPLES = {
    "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g/", "?y": "http://a/b/c/d;p?y",
    "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x",
    "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/",
    "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g",
    "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..",
    "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
    "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x",
    "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http://a/b/c/g", "g:h": "g:h"}
WEB = {
    "HTTP://EX.Com": "http://ex.com/", "https://ex.com:443/a": "https://ex.com/a", "http://ex.com:080/": "http://ex.com/", "http://ex.com:443": "http://ex.com:443/",
    "https:ex.com/x": "https://ex.com/x", "http:/g": "http://g/", "\\g\\..\\h": "http://a/h", "//u:p@Ex.com/%2E%2e/x": "http://u:p@ex.com/x", "g h": "http://a/b/c/g%20h",
    "é?é": "http://a/b/c/%C3%A9?%C3%A9", " \tg\n": "http://a/b/c/g", "/a:b?c:d": "http://a/a:b?c:d", "./a:b": "http://a/b/c/a:b", "1a:b": "http://a/b/c/1a:b", "///x/y": "http://x/y",
    "mailto:a@b": "mailto:a@b", "?": "http://a/b/c/d;p?", "#": "http://a/b/c/d;p?q#"}


def test_references(spark):
    rows = [*EXAMPLES.items(), *WEB.items()]
    df = spark.createDataFrame(rows, "ref string, want string").withColumn("base", F.lit("http://a/b/c/d;p?q"))
    got = {r["ref"]: r["url"] for r in df.select("ref", resolve_reference(F.col("base"), F.col("ref")).alias("url")).collect()}
    assert got == dict(rows)
    one = spark.range(1).select(resolve_reference(F.lit("http://a"), F.lit("x")), resolve_reference(F.lit("http://a?q#f"), F.lit("")), resolve_reference(F.lit(None), F.lit("x")))
    assert tuple(one.first()) == ("http://a/x", "http://a/?q", None)


def some_values(n):
    """Addresses with runs of zero groups, mapped ones and any others."""
    g = random.Random(3)
    for k in range(n):
        yield sum((g.getrandbits(16) if g.random() < 0.5 else 0) << 16 * i for i in range(8)) if k % 3 else 0xFFFF00000000 + g.getrandbits(32)


def spellings(value):
    a = ipaddress.IPv6Address(value)
    v4 = str(ipaddress.IPv4Address(value & 0xFFFFFFFF))
    return [str(a), a.exploded, a.exploded.upper(), ":".join(a.exploded.split(":")[:6]) + ":" + v4, str(a).upper()]


BAD = ["", ":", ":::", "1", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8::", "::1:2:3:4:5:6:7:8", "12345::", "g::", "::1.2.3", "::1.2.3.256", "::1.2.3.04",
       "1.2.3.4", "::1%eth0", "1:2:3:4:5:6:7:1.2.3.4", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "::1.2.3.4:5", "::1.2.3.4.5", " ::1"]


def test_ipv6_values(spark):
    values = [*some_values(300), 0, 1, 0xFFFF0A000001]
    rows = [(s, f"{v:032x}") for v in values for s in spellings(v)] + [(b, None) for b in BAD] + [("1:2:3:4:5:6:7::", "00010002000300040005000600070000"), ("1::1.2.3.4", f"{(1 << 112) + 0x01020304:032x}")]
    got = spark.createDataFrame(rows, "t string, want string").withColumn("v", A.ipv6_hex(F.col("t")))
    assert [tuple(r) for r in got.where("not (v <=> want)").limit(5).collect()] == []


@pytest.mark.parametrize("block", ["::1/128", "fc00::/7", "fe80::/10", "ff00::/8", "::ffff:0:0/96", "2001:db8::/33", "::/0"])
def test_blocks(spark, block):
    net = ipaddress.IPv6Network(block)
    lo, hi = int(net.network_address), int(net.broadcast_address)
    some = {x for x in (lo, hi, lo - 1, hi + 1, (lo + hi) // 2, 0, 5, (1 << 128) - 1) if 0 <= x < 1 << 128}
    df = spark.createDataFrame([(f"{x:032x}", lo <= x <= hi) for x in some], "v string, want boolean")
    assert df.where(A.in_block(F.col("v"), block) != F.col("want")).count() == 0


PRIVATE = ["[::1]", "[0:0:0:0:0:0:0:1]", "[0000::0001]", "[::0.0.0.1]", "[::ffff:10.0.0.1]", "[::FFFF:0a00:1]", "[0:0:0:0:0:ffff:a00:0001]", "[fc00::1]", "[FDff:1::]", "[fe80::1]", "[ff02::1]",
           "%31%32%37.0.0.1", "127%2E0.0.1", "loc%61lhost", "１２７.0.0.1", "127。0。0。1", "0x7f.1", "%6Detadata.google.internal"]
PUBLIC = ["[2001:db8::1]", "[::ffff:8.8.8.8]", "[fc::1]", "[fbff::1]", "ex%61mple.com", "[::2]"]
INVALID = ["[::1%25eth0]", "[1:2]", "a%zz.com", "a%00b", "a%2fb.com", "[::ffff:10.0.0.256]", "%", "[::1"]


def test_hosts_by_value(spark):
    rows = [(h, k) for k, hosts in ((REASON_PRIVATE, PRIVATE), (None, PUBLIC), (REASON_INVALID, INVALID)) for h in hosts]
    df = spark.createDataFrame([(f"http://{h}/x", k) for h, k in rows], "url string, want string")
    staged = with_url_screen(df, "url").withColumn("single", url_parts("url")["reason"])
    got = staged.collect()
    assert [(r["url"], r["want"], r["u_reason"], r["single"]) for r in got if not r["want"] == r["u_reason"] == r["single"]] == []
    assert staged.where("u_ok").count() == len(PUBLIC)  # a filter on the verdict does not repeat the parse
    hosts = {r["url"]: r["u_host"] for r in got}
    assert hosts["http://ex%61mple.com/x"] == "example.com"


def test_a_page_fetched_twice_does_not_multiply_rows(spark):
    from textloom.operators.audit import redirect_chains
    hops = [("http://a.example.com/x/y", 302, "../z?q#f"), ("http://a.example.com/x/y", 302, "../z?q#f"), ("http://A.example.com:80/x/y#top", 500, None),
            ("http://a.example.com/z?q", 200, None), ("http://a.example.com/z?q", 404, None), ("http://a.example.com/loop", 301, "./loop"),
            ("http://a.example.com/in", 302, "//[::ffff:10.0.0.1]/"), ("http://a.example.com/none", 302, None)]
    starts = [(i, f"http://a.example.com/{p}") for i, p in enumerate(["x/y#part", "loop", "in", "none", "gone", "z?q"])]
    got = redirect_chains(spark.createDataFrame(starts, "start_id long, url string"), spark.createDataFrame(hops, "url string, status int, location string"))
    rows = sorted((r["start_id"], r["final_url"], r["redirects"], r["ok"], r["reason"]) for r in got.collect())
    a = "http://a.example.com/"
    assert rows == [(0, a + "z?q#f", 1, True, None), (1, a + "loop", 5, False, "Too many redirects"), (2, a + "in", 0, False, REASON_PRIVATE),
                    (3, a + "none", 0, False, "Redirect response without Location header"), (4, a + "gone", 0, False, "Failed to fetch URL: no snapshot"),
                    (5, a + "z?q", 0, True, None)]
