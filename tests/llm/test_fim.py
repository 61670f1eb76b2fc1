"""Fill-in-middle against plain string slicing."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm.fim import BlockTree, fill_in_middle, restored

UNITS = {"char": r"(?s).", "word": r"(?a:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*)", "line": r"(?s)[^\n]*\n|[^\n]+\Z"}


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab é🙂\n\t ")) | st.text(), st.sampled_from(list(UNITS)), st.integers(1, 9))
def test_cuts(text, unit, block):
    raw = text.encode()
    tree = BlockTree(np.frombuffer(raw, np.uint8), unit, block)
    starts = [m.start() for m in re.finditer(UNITS[unit], text)]
    assert tree.units == len(starts) and tree.points == len(text)
    for k in range(len(starts) + 2):
        want = 0 if k == 0 else starts[k] if k < len(starts) else len(text)
        assert tree.cut(k) == (len(text[:want].encode()), want)


def brute(doc, text, plain=90):
    t, h = text or "", hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= plain:
        return n, "plain", None, None, t
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_fill_in_middle(spark):
    texts = [None, "", " ", "a", "<", "<P", "x<P>y", "<S<M", "<<<>>>" * 9, "é🙂日本" * 400, "line\nline\r\n\x00", "<M>", "long é " * 300_000]
    rows = [(i, texts[i % len(texts)]) for i in range(130)] + [(None, "no identifier"), (7, "again"), (7, "again")]
    df = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, form string, h1 int").repartition(5)
    done = fill_in_middle(df).withColumn("back", restored())
    got = sorted(((r["doc_id"], *tuple(r)[1:]) for r in done.collect()), key=repr)
    assert got == sorted(((i, *brute(i, t), t or "") for i, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(df.limit(0)).count() == 0
    assert fill_in_middle(df, carry=("h1",)).columns[:2] == ["doc_id", "h1"]
    with pytest.raises(ValueError, match="named like"):
        fill_in_middle(df, carry=("form",))


def test_other_units_and_sentinels(spark):
    marks = ("[pre]", "[suf]", "[mid]")
    rows = [(i, " \n".join(["one two", "drei", "日本 語"] * (i % 4)) + "\n") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for unit in ("word", "line"):
        done = fill_in_middle(df, unit=unit, plain_percent=0, spm_percent=50, sentinels=marks).withColumn("back", restored(sentinels=marks))
        for r in done.collect():
            text = dict(rows)[r["doc_id"]]
            starts = [0, *[m.start() for m in re.finditer(UNITS[unit], text)][1:], len(text)]
            assert r["back"] == text and r["n"] == len(re.findall(UNITS[unit], text)) and r["form"] != "plain"
            assert r["prefix_chars"] in starts and r["prefix_chars"] + r["middle_chars"] in starts
    with pytest.raises(ValueError, match="first character"):
        fill_in_middle(df, sentinels=("aba", "ac", "ad"))
