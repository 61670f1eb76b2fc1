"""SimHash fingerprints, BK-trees and their components against brute force."""

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from llm.conftest import make_words
from textloom.llm import simhash_bk as B


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """Component per row of (id, fingerprint): rows of near fingerprints or one identifier belong together."""
    names = list(range(len(rows)))

    def find(x):
        while names[x] != x:
            x = names[x]
        return x
    for i, (a, x) in enumerate(rows):
        for j, (b, y) in enumerate(rows[:i]):
            if (x ^ y).bit_count() <= 3 or a is not None and a == b:
                p, q = find(i), find(j)
                names[max(p, q)] = min(p, q)
    roots = [find(i) for i in range(len(rows))]
    return [min((a for (a, _), s in zip(rows, roots) if s == r and a is not None), default=None) for r in roots]


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aAbB é\n\t\x0b ")) | st.lists(st.sampled_from(["x", "Y", "é", "zz"])).map(" ".join))
def test_fingerprint(text):
    assert B.fingerprint(text.encode()) == brute_fingerprint(text)


def near_values(g, n, bits=64, flips=6):
    """Fingerprints around a few centres."""
    centres = g.integers(0, 1 << 63, 5, dtype=np.uint64)
    out = centres[g.integers(0, 5, n)]
    for _ in range(flips):
        out = out ^ (np.uint64(1) << g.integers(0, bits, n).astype(np.uint64)) * (g.random(n) < 0.6)
    return np.unique(out)


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_trees(radius, monkeypatch):
    monkeypatch.setattr(B, "FRONTIER", 500)
    g = np.random.default_rng(radius)
    fp = g.permutation(near_values(g, 600))
    shard = np.sort(g.integers(0, 4, len(fp)))
    tree = B.Forest(fp, shard)
    root = np.array([tree.root_of[s] for s in shard.tolist()])
    got = {(int(q), int(n)) for part in tree.near(fp, root, radius) for q, n in zip(*part)}
    want = {(i, j) for i in range(len(fp)) for j in np.flatnonzero((np.bitwise_count(fp[i] ^ fp) <= radius) & (shard == shard[i])).tolist()}
    assert got == want
    # Subtrees of the query's own component are not entered, and nothing else is missed.
    group = g.integers(0, 2, len(fp))
    tree = B.Forest(fp, shard, group)
    met = {(int(q), int(n)) for part in tree.near(fp, root, radius, group) for q, n in zip(*part)}
    assert met <= want and {(q, n) for q, n in want if group[q] != group[n]} <= met


@pytest.mark.parametrize("agree", [1, 2, 3])
def test_near_nodes_share_a_shard(spark, agree):
    g = np.random.default_rng(agree)
    rows = []
    for _ in range(300):
        x = int(g.integers(0, 1 << 63)) * 2 + 1
        y = x
        for b in g.choice(64, 3, replace=False).tolist():
            y ^= 1 << b
        rows.append(tuple(v - (1 << 64) if v >> 63 else v for v in (x, y)))
    df = spark.createDataFrame(rows, "x long, y long")
    x, y = (B.F.array(*B.shard_keys(B.F.col(c), 3, agree)) for c in "xy")
    assert df.where(~B.F.exists(B.F.zip_with(x, y, lambda a, b: a == b), lambda z: z)).count() == 0


@pytest.mark.parametrize("size", [2048, 40])  # 40: most shards hold several trees, which meet
def test_links_of_nodes(spark, monkeypatch, size):
    for name in ("TREE", "QUERIES"):
        monkeypatch.setattr(B, name, size)
    g = np.random.default_rng(5)
    fp = np.concatenate([near_values(g, 500), g.integers(0, 1 << 63, 200, dtype=np.uint64) << np.uint64(8)])  # zero bits shared by many
    rows = [(int(x), int(x)) for x in np.unique(fp)]
    known = B.node_links(spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x, _ in rows], "fp long").repartition(4), len(rows)).collect()
    root = {r["a"] & (1 << 64) - 1: r["b"] & (1 << 64) - 1 for r in known}
    brute = brute_components(rows)
    mine = [root.get(x, x) for x, _ in rows]
    assert len(set(zip(mine, brute))) == len(set(mine)) == len(set(brute))


def test_near_simhash(spark, rng):
    base = make_words(rng, 150, 10_000)
    rows = [(300 - i, " ".join(w if rng.random() > 0.004 * (i % 5) else "zz" for w in base)) for i in range(50)]
    rows += [(400 + i, " ".join(make_words(rng, 50, 10_000))) for i in range(20)]
    rows += [(900 + i, rows[3][1].upper()) for i in range(30)]  # a hot fingerprint
    rows += [(1, rows[60][1]), (1, rows[61][1]), (2, rows[62][1]), (420, rows[62][1]), (420, rows[63][1])]  # identifiers with several texts
    rows += [(500, None), (501, ""), (502, " \n"), (503, "A b"), (504, "a  B"), (505, "one"), (None, rows[64][1]), (None, "nothing else"), (506, "é " * 200_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, size int").repartition(3)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in B.near_simhash(df).collect()), key=repr)
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    want = [(i, f"{x:016x}", c) for (i, x), c in zip(prints, brute_components(prints))]
    assert got == sorted(want, key=repr)
    assert B.near_simhash(df.limit(0)).count() == 0


def test_blocks_grow_with_the_nodes():
    assert [B.blocks_to_agree(n, 3) for n in (0, 10 ** 5, 10 ** 7, 10 ** 9, 10 ** 12)] == [1, 1, 1, 2, 3]
