"""Cross-tokenizer alignment against the tokenizers' own libraries and plain loops."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm.conftest import make_words
from textloom.llm import token_align as T
from textloom.llm.queries import tokenizer_file

FILES = (tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
LIBRARY = Tokenizer.from_file(FILES[0])
LIBRARY.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def brute_tokens(text):
    """((id, bytes) of A, of B), or none where the bytes differ."""
    if not text:
        return [], []
    alphabet = T.byte_alphabet()
    one = LIBRARY.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(one.ids, one.tokens)]
    b = []
    for i in PIECES.encode(text):
        p = PIECES.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if PIECES.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def ranges(tokens):
    at, out = 0, []
    for i, b in tokens:
        out.append((i, at, at + len(b)))
        at += len(b)
    return out


def brute(texts):
    """What align_corpus gives for each text, by plain loops."""
    aligned = []
    for text in texts:
        a, b = map(ranges, brute_tokens(text))
        ends = {e for *_, e in a} & {e for *_, e in b}
        links = [(x[0], y[0]) for x in a for y in b if x[2] == y[2]] if len(a) < 3000 else [
            (x[0], y) for x in a if (y := {e: i for i, _, e in b}.get(x[2])) is not None]
        groups, lo = [], 0
        for hi in sorted(ends):
            groups.append("|".join(",".join(str(i) for i, _, e in side if lo < e <= hi) for side in (a, b)))
            lo = hi
        aligned.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    count = Counter(x for *_, links, _ in aligned for x in links)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [(n_a, n_b, n_groups, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha)
            for n_a, n_b, n_groups, links, sha in aligned]


ODD = [None, "", " ", "a", "  two  spaces ", "<|endoftext|> </s><s> <unk> <0x41>", "▁", "x▁y", "日本語のテキスト 🙂é", "tab\tline\n\r\n\x00\x01", "don't I'll 123,456.78",
       "a" * 400, " " * 300, " 　 x\u0085y", "é ‍"]


def test_align_corpus(spark, rng):
    texts = ODD + [" ".join(make_words(rng, int(rng.integers(1, 80)))) for _ in range(20)] + ["The cat sat on the mat, naïvely. " * 20] * 3
    rows = [(i if i else None, t, 1, "x") for i, t in enumerate(texts)] + [(5, texts[-1], 1, "x")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, pair int, links string").repartition(4)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted((tuple(r) for r in T.align_corpus(df, FILES).collect()), key=key)
    assert got == sorted(((r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows]))), key=key)
    assert T.align_corpus(df.limit(0), FILES).count() == 0


def test_segments_do_not_change_the_result(spark, rng, monkeypatch):
    text = "".join(f"{w}{s}" for w, s in zip(make_words(rng, 60), rng.choice([" ", ", ", " a ", "\n", "  ", " b c "], 60)))
    bad = text + " a b ▁ c d " + text
    monkeypatch.setattr(T, "SEGMENT", 20)
    monkeypatch.setattr(T, "RUN_BYTES", 50)
    monkeypatch.setattr(T, "_runs", lambda col, a, b, runs=T._runs: runs(col, a, b))
    monkeypatch.setattr(T.segments, "__defaults__", (20,))
    table = [(0, text), (1, bad), (2, "")]
    run = T._align(FILES)
    batch = T.pa.RecordBatch.from_arrays([T.pa.array([i for i, _ in table]), T.pa.array([t for _, t in table])], ["doc_id", "text"])
    out = T.pa.Table.from_batches(list(run(iter([batch])))).to_pylist()
    docs = [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["groups_sha256"]) for r in out if r["pair"] is None]
    assert docs == [(i, *w[:3], w[-1]) for (i, _), w in zip(table, brute([text, bad, ""]))]
    counts = {r["pair"]: r["times"] for r in out if r["pair"] is not None}
    a, b = map(ranges, brute_tokens(text))
    assert counts == Counter(x[0] * 32000 + y[0] for x in a for y in b if x[2] == y[2])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=12) | st.sampled_from(["the ", "cat ", "'s", " 12", "é", "\n\n"]), max_size=12).map("".join), st.integers(1, 30))
def test_runs(text, size):
    a, b = T.sides(FILES)
    raw = text.encode()
    parts = list(T.segments(raw, size))
    assert b" ".join(parts) == raw
    got = T.align_run(parts, a, b)
    want = [ranges(x) for x in brute_tokens(text)]
    if not got.good.all():
        assert want == [[], []]
        return
    if raw:
        assert [x.tolist() for x in got.ids] == [[i for i, *_ in x] for x in want]
        pairs = {(i, j) for i, x in enumerate(want[0]) for j, y in enumerate(want[1]) if x[1] < y[2] and y[1] < x[2]}
        assert sorted(zip(*(o.tolist() for o in got.overlap))) == sorted(pairs)
        assert set(zip(*(o.tolist() for o in got.link))) == {(i, j) for i, j in pairs if want[0][i][2] == want[1][j][2]}


def test_byte_side_equals_the_library(rng):
    a, _ = T.sides(FILES)
    texts = [t for t in ODD if t] + [" " * 50_000, "a" * 50_000, "a \n" * 20_000, " ".join(make_words(rng, 20_000))]
    assert a.encode.__qualname__.startswith("Encoding")
    assert [list(a.encode(t)) for t in texts] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_overlaps(spark):
    text = "naïve tokenizers' alignment, 1234567"
    df = spark.createDataFrame([(3, text, 0), (4, None, 0), (5, "▁", 0)], "doc_id int, text string, a_id int")
    a, b = map(ranges, brute_tokens(text))
    want = [(3, *x, *y) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
    assert sorted(tuple(r) for r in T.overlaps(df, FILES).collect()) == sorted(want)
    files = df.schema["doc_id"].dataType.simpleString()
    assert files == "int" and T.overlaps(df, FILES).schema["doc_id"].dataType.simpleString() == "int"


def test_pair_bound(rng):
    a, b = T.sides(FILES)
    bound = T.pair_bound(FILES)
    tokens = [set(a.vocabulary.tokens), set(b.vocabulary.tokens)]
    ends = sum(t[k:] in other for one, other in (tokens, tokens[::-1]) for t in one for k in range(len(t)))
    assert ends <= bound < 1_000_000


@pytest.mark.parametrize("n", [0, 1, 5])
def test_pair_counts(n, monkeypatch):
    monkeypatch.setattr(T, "COUNTED", 7)
    g, seen, want = np.random.default_rng(n), T._PairCounts(), Counter()
    for _ in range(n):
        x = g.integers(0, 9, 5).astype("<u4")
        seen.add(x)
        want.update(x.tolist())
    seen.merge()
    assert dict(zip(seen.pairs.tolist(), seen.counts.tolist())) == want
