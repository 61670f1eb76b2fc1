"""Lookup tiers on the reference's 7-row catalogue and its edge cases."""

from textloom.operators.lookup import lookup_cascade, search_topk

ITEMS = [
    (0, "claude", ["c"]), (1, "ccs:glm", []), (2, "ccs:mm", []), (3, "ccs:gemini", []),
    (4, "commit-zen", ["commit", "commit-message"]), (5, "commit-atomic", ["ac", "auto-commit"]),
    (6, "review", ["rev"]),
]


def _items(spark, rows):
    return spark.createDataFrame(
        [(o, n, a, "run " + n, None, None) for o, n, a in rows],
        "ord int, name string, aliases array<string>, command string, prompt_command string, prompt_use_stdin boolean")


def _lookup(spark, queries, rows=ITEMS):
    q = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    out = lookup_cascade(q, _items(spark, rows)).collect()
    return {r["query"]: r for r in out}


def test_tiers(spark):
    got = _lookup(spark, ["claude", "CLAUDE", "c", "C", "rev", "commit-message", "mm", "MM", "glm", "gemini",
                          "cluade", "commit", "nonexistent", ""])
    want = {"claude": ("claude", "exact"), "CLAUDE": ("claude", "exact"), "c": ("claude", "alias"),
            "C": ("claude", "alias"), "rev": ("review", "alias"), "commit-message": ("commit-zen", "alias"),
            "mm": ("ccs:mm", "suffix"), "MM": ("ccs:mm", "suffix"), "glm": ("ccs:glm", "suffix"),
            "gemini": ("ccs:gemini", "suffix"), "cluade": ("claude", "fuzzy"), "commit": ("commit-zen", "alias")}
    for q, (name, tier) in want.items():
        assert (got[q]["name"], got[q]["tier"]) == (name, tier), q
    assert not got["nonexistent"]["ok"] and "nonexistent" in got["nonexistent"]["error"]
    assert got[""]["error"] == "No query provided"
    assert abs(got["cluade"]["score"] - 2 / 6) < 1e-9


def test_ambiguous_and_unique(spark):
    rows = [(0, "foo-bar", []), (1, "foo-baz", []), (2, "unique-tool", []), (3, "other", []),
            (4, "opencode", ["oc"]), (5, "opencode-test", []), (6, "very-specific-name", []), (7, "different-tool", [])]
    got = _lookup(spark, ["foo", "unique", "open", "specific"], rows)
    assert got["unique"]["name"] == "unique-tool"
    assert got["specific"]["name"] == "very-specific-name"
    for q in ("foo", "open"):
        assert not got[q]["ok"] and got[q]["error"].startswith(f"Ambiguous match for '{q}'\nDid you mean:\n")
    assert "  • opencode (oc)" in got["open"]["error"] and "  • opencode-test" in got["open"]["error"]


def test_search_topk(spark):
    q = spark.createDataFrame([(0, "comit"), (1, "zzzz")], "query_id int, query string")
    items = _items(spark, ITEMS).withColumn("description", __import__("pyspark.sql.functions").sql.functions.lit("x"))
    out = search_topk(q, items, k=10).orderBy("query_id", "rank").collect()
    assert [r["name"] for r in out if r["query_id"] == 0][:2] == ["commit-zen", "commit-atomic"]
    assert not [r for r in out if r["query_id"] == 1]


def test_cheapest_pieces():
    """Against all ways to take disjoint pieces."""
    import random
    from itertools import combinations

    from textloom.operators.lookup import THRESHOLD, cheapest_pieces
    g = random.Random(4)
    for _ in range(150):
        q = "".join(g.choice("abc") for _ in range(g.randint(1, 9)))
        parts = int(THRESHOLD * len(q)) + 1
        spans = [(i, i + n) for i in range(len(q)) for n in (1, 2, 3) if i + n <= len(q)]
        cost = {q[a:b]: g.randint(0, 50) for a, b in spans if g.random() < 0.8}
        best = min(sum(cost.get(q[a:b], 0) for a, b in c) for c in combinations(spans, parts) if all(x[1] <= y[0] for x, y in zip(sorted(c), sorted(c)[1:])))
        got = cheapest_pieces(q, parts, cost)
        assert len(got) == parts and sum(cost.get(p, 0) for p in got) == best


def test_candidates_are_whole_and_few(spark, monkeypatch):
    """Every value within the threshold is a candidate, also when a gram that all values share is dealt over several keys."""
    import random

    from pyspark.sql import functions as F

    from textloom.operators import lookup as L
    from textloom.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    g = random.Random(5)
    words = ["tool-" + "".join(g.choice("abcdefgh") for _ in range(g.randint(3, 9))) for _ in range(400)]
    queries = ["".join(c if g.random() > 0.15 else g.choice("abcdefgh-") for c in g.choice(words)) for _ in range(60)] + ["tool-", "a", "zzzz", "to"]
    values = spark.createDataFrame(list(enumerate(words)), "ord long, value string")
    texts = spark.createDataFrame([(q, len(q)) for q in sorted(set(queries))], "ql string, m int")
    want = {(r["ql"], r["ord"]) for r in texts.crossJoin(values).withColumn("d", L.substring_distance(F.col("value"), F.col("ql"), F.col("m")))
            .where(F.col("d") <= F.floor(F.col("m") * L.THRESHOLD)).collect()}
    counts = {}
    for hot in (10_000, 30):
        monkeypatch.setattr(L, "HOT_GRAM", hot)
        got = {(r["ql"], r["ord"]) for r in L.fuzzy_candidates(texts, values).collect()}
        assert want <= got
        counts[hot] = got
    assert counts[10_000] == counts[30]
    # The part that all names share ("tool-") is avoided wherever the rest of a query has pieces enough.
    even = lambda q: [q[j * len(q) // p:(j + 1) * len(q) // p] for p in [int(L.THRESHOLD * len(q)) + 1] for j in range(p)]
    plain = sum(any(p in w for p in even(q)) for q in set(queries) for w in words)
    assert len(counts[30]) < plain
