"""Exact dedup, chat formatting, WARC and quality rules: odd rows and brute force."""

import hashlib
import re
from collections import Counter


from textloom.llm import warc
from textloom.llm.chat import format_chats, loss_text, read_chats
from textloom.llm.common import components, scratch_path
from textloom.llm.exact_dedup import exact_dedup
from textloom.llm.quality import quality_rules

DOCS = "doc_id long, text string, digest int, run int"


def test_exact_dedup(spark):
    rows = [(5, "a  b"), (2, "a\tb"), (9, "a b"), (7, None), (1, ""), (3, "a b c"), (None, "solo"), (4, "x" * 200_000), (6, "x" * 200_000), (3, "a b c")]
    df = spark.createDataFrame([(i, t, 0, 1) for i, t in rows], DOCS).repartition(5)
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup(df, runs=20).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {(5, 2, 3, False, sha("a b")), (2, 2, 3, True, sha("a b")), (9, 2, 3, False, sha("a b")), (7, 1, 2, False, sha("")),
                   (1, 1, 2, True, sha("")), (3, 3, 2, True, sha("a b c")), (None, None, 1, True, sha("solo")),
                   (4, 4, 2, True, sha("x" * 200_000)), (6, 4, 2, False, sha("x" * 200_000))}
    assert exact_dedup(df.limit(0)).count() == 0


def test_chats(spark):
    odd = ["</s>[INST] ok [/INST]", "<s\\>", "<s\\\\> [/INST\\]", "", None, "a<", "/s>", "é🙂" * 50_000]
    rows = [(1, i, "assistant" if i % 3 else "user", t) for i, t in enumerate(odd)] + [(2, 0, None, "x"), (2, 0, None, "x"), (None, 1, "assistant", "n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, parts int").repartition(4)
    got = {r["conv_id"]: r for r in read_chats(format_chats(df)).withColumn("loss", loss_text()).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r[2], r[3] or "") for r in rows if r[0] == 1]
    assert got[1]["loss"] == "".join(r[3] or "" for r in rows if r[0] == 1 and r[2] == "assistant")
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", "x"), ("", "x")]
    assert got[None]["loss"] == "n"
    assert got[2]["formatted"] == "<s>[INST]x[/INST]x</s>"
    assert format_chats(df.limit(0)).count() == 0


def test_warc(spark):
    big, other = "é" * 600, "<p>\r\n\r\nWARC/1.1\r\n\r\n</p>" * 60
    rows = [(1, "http://a/", big), (3, None, big), (2, "http://b/\r\nX: y", other), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", big)]
    raw, out, again = (scratch_path(spark, "t") for _ in range(3))
    warc.write_archives(warc.page_records(spark.createDataFrame(rows, "page_id long, url string, html string")).repartition(3), raw)
    back = {r["record_id"]: r for r in warc.read_archives(spark, raw).collect()}
    assert {k: bytes(r["payload"]) for k, r in back.items()} == {f"urn:page:{i}": (t or "").encode() for i, _, t in rows}
    warc.dedup_archives(spark, raw, out)
    warc.dedup_archives(spark, out, again)  # archives with revisits come out the same
    for path in (out, again):
        got = {r["record_id"][9:]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archives(spark, path).collect()}
        assert got["1"] == got["3"] == ("revisit", "urn:page:7", 1200) and got["7"] == ("response", None, 1200)
        assert all(got[k][:2] == ("response", None) for k in "2456")


def test_warc_repeated_record_ids(spark, tmp_path):
    a, b, c, d = (x * 1500 for x in "abcd")
    rows = [(1, "u", a), (1, "u", b), (2, "v", a), (3, "w", c), (3, "w", d), (4, "x", c), (4, "x", d)]  # pages crawled again
    raw, out = f"{tmp_path}/raw", f"{tmp_path}/out"
    warc.write_archives(warc.page_records(spark.createDataFrame(rows, "page_id long, url string, html string")), raw)
    warc.dedup_archives(spark, raw, out)
    got = warc.read_archives(spark, out).collect()
    assert len(got) == len(rows)
    assert {bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"} == {a, b, c, d}
    assert sorted((r["record_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit") == [
        ("urn:page:1", "urn:page:2"), ("urn:page:3", "urn:page:4"), ("urn:page:3", "urn:page:4")]
    dated = spark.createDataFrame([("urn:page:1", "response", "u", f"2020-01-0{k}T00:00:00Z", "x", 1500) for k in (1, 2)],
                                  "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_bytes long")
    assert [r["at"] for r in warc.resolve_revisits(dated).collect()] == ["2020-01-01T00:00:00Z"]


def test_quality_base_counts_and_partitioning(spark, rng):
    from llm.conftest import make_words
    texts = [None, "", " \n\t", "one", "a b c d e " * 30, "# $ &\nx y\nx y\n \n"] + [" ".join(make_words(rng, 60, 12)) for _ in range(20)] + ["w " * 30_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, grams int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6, 20)], "doc_id long, quality int")
    one, two = ({r["doc_id"]: r for r in quality_rules(df.repartition(n), labels).collect()} for n in (1, 6))
    assert one == two
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        win = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        count = Counter(win)
        covered = {k + j for k, x in enumerate(win) if count[x] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        r = one[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r["kept"] and r["base_failed"])
    assert quality_rules(df.limit(0), labels).count() == 0


def test_components(spark, rng):
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
