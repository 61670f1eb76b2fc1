"""Name lookup against a catalogue.

Tiers, case-insensitive, lowest wins: exact name, alias (first in list order),
unique suffix, unique substring, fuzzy. Every tier is an equi join; no query
meets every item.

Fuzzy score: approximate substring distance (fewest edits turning the query
into some substring of the name) over the query length; a match needs
score <= 0.4, i.e. at most k = floor(0.4 m) edits for a query of m
characters. Candidates come from lossless blocking: of any k+1 disjoint pieces of
the query, a name within k edits holds at least one unchanged. The
item-side index holds the distinct 1-, 2- and 3-grams of each name with their
frequency, and each query takes those k+1 pieces of 1 to 3 characters that
the fewest names hold (dynamic programming, ``cheapest_pieces``). Candidate pairs are an equi
join of pieces to grams, hot grams dealt over several keys. Scores are then exact
(``levenshtein`` over the substrings whose length is within k of m).

This score is our own published formula (the reference's comes from an
external library); orderings can differ from it in close cases.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Threshold and ambiguity gap of the reference, and its texts.
THRESHOLD = 0.4
AMBIGUITY_GAP = 0.05
NO_QUERY = "No query provided"
TIERS = ["exact", "alias", "suffix", "substring", "fuzzy"]


def grams(col: Column, max_n: int = 3) -> Column:
    """Distinct substrings of length 1..max_n."""
    n_chars = F.length(col)
    g = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(max_n), n_chars)),
                              lambda n: F.transform(F.sequence(F.lit(1), n_chars - n + 1),
                                                    lambda i: col.substr(i, n))))
    return F.when(n_chars > 0, F.array_distinct(g)).otherwise(F.array().cast("array<string>"))


def cheapest_pieces(q: str, parts: int, cost: dict[str, int]) -> list[str]:
    """``parts`` disjoint pieces of 1 to 3 characters of ``q`` with the least total cost (by gram; absent: 0): dynamic programming over prefixes
    and numbers of pieces. Characters may be left out: an edit still spoils one piece at most."""
    n = len(q)
    best = np.full((n + 1, parts + 1), np.inf)
    best[:, 0] = 0
    taken = np.zeros((n + 1, parts + 1), np.int8)  # length of the piece that ends here; 0: the character is left out
    for i in range(1, n + 1):
        best[i] = best[i - 1]
        for size in range(1, min(3, i) + 1):
            with_piece = np.append(np.inf, best[i - size, :-1] + cost.get(q[i - size:i], 0))
            better = with_piece < best[i]
            best[i][better] = with_piece[better]
            taken[i][better] = size
    out, i, j = [], n, parts
    while j:
        size = int(taken[i, j])
        if size:
            out.append(q[i - size:i])
            j -= 1
        i -= size or 1
    return out


@F.pandas_udf(ArrayType(StringType()))
def _pieces(q: pd.Series, gram_lists: pd.Series, counts: pd.Series) -> pd.Series:
    return pd.Series([sorted(set(cheapest_pieces(t, int(THRESHOLD * len(t)) + 1, dict(zip(g, c))))) for t, g, c in zip(q, gram_lists, counts)])


HOT_GRAM = 10_000


def gram_index(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index (ord, value, g) of the distinct grams of each value, and how many values hold each gram (g, df)."""
    index = values.select("ord", "value", F.explode(grams(F.col("value"))).alias("g"))
    return index, index.groupBy("g").agg(F.count(F.lit(1)).alias("df")).checkpoint(eager=True)


def gram_counts(texts: DataFrame, freq: DataFrame) -> DataFrame:
    """``texts(ql, m)`` with the grams of each that some value holds, ``gs``, and their counts, ``dfs``."""
    known = texts.select("ql", F.explode(grams(F.col("ql"))).alias("g")).join(freq, "g").groupBy("ql").agg(
        F.array_sort(F.collect_list(F.struct("df", "g"))).alias("_l"))
    none = F.array().cast("array<struct<df:bigint,g:string>>")
    listed = texts.join(known, "ql", "left").withColumn("_l", F.coalesce("_l", none))
    return listed.select("ql", "m", F.transform("_l", lambda x: x["g"]).alias("gs"), F.transform("_l", lambda x: x["df"]).alias("dfs"))


def meet(wanted: DataFrame, index: DataFrame, freq: DataFrame) -> DataFrame:
    """``wanted(g, ...)`` joined to the index by gram. A gram that more than ``HOT_GRAM`` values hold is dealt over as many keys as it has
    such shares, and what is wanted of it is repeated for each. The hot grams are a ``HOT_GRAM``-th of the index at most; they are broadcast
    up to 100,000 of them."""
    hot = freq.where(F.col("df") > HOT_GRAM).select("g", F.ceil(F.col("df") / HOT_GRAM).cast("int").alias("_shares"))
    n_hot = hot.count()  # freq is a written table
    if not n_hot:
        return wanted.join(index, "g")
    small = F.broadcast(hot) if n_hot <= 100_000 else hot
    shares = F.coalesce("_shares", F.lit(1))
    asked = wanted.join(small, "g", "left").withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_shares")
    dealt = index.join(small, "g", "left").withColumn("_share", F.pmod(F.xxhash64("ord", "value"), shares).cast("int")).drop("_shares")
    return asked.join(dealt, ["g", "_share"]).drop("_share")


def substring_distance(text: Column, q: Column, m: Column) -> Column:
    """min over substrings s of text, |len(s) - m| <= k, of levenshtein(s, q);
    NULL when no substring length is in range (then the distance exceeds k)."""
    k = F.floor(m * THRESHOLD).cast("int")
    n_chars = F.length(text)
    lo = F.greatest(F.lit(1), m - k)
    hi = F.least(n_chars, m + k)
    d = F.array_min(F.flatten(F.transform(
        F.sequence(lo, hi),
        lambda ln: F.transform(F.sequence(F.lit(1), n_chars - ln + 1),
                               lambda i: F.levenshtein(text.substr(i, ln), q)))))
    return F.when(hi >= lo, d)


def fuzzy_candidates(texts: DataFrame, values: DataFrame, grams_of: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(ql, m, ord, value): the values that hold one of the k + 1 pieces of a query text which together are held by the fewest
    values, and that are long enough. Pieces that no value holds cost nothing and meet nothing. ``grams_of``: the values' ``gram_index``, if
    it is there already."""
    index, freq = grams_of or gram_index(values)
    cut = gram_counts(texts, freq).select("ql", "m", F.explode(_pieces("ql", "gs", "dfs")).alias("g"))
    long_enough = F.length("value") >= F.col("m") - F.floor(F.col("m") * THRESHOLD)
    return meet(cut, index, freq).where(long_enough).select("ql", "m", "ord", "value").distinct()


def fuzzy_matches(queries: DataFrame, values: DataFrame, grams_of: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, ord, score) for every item value within the threshold; an
    item with several values keeps its best score. ``queries`` has
    query_id, ql (lower-cased query), m (its length > 0); ``values`` has ord,
    value (lower-cased).

    Scores depend only on the query text, so they are computed once per
    distinct text and joined back to the query ids: repeated queries (and a
    hot query holding a large share of the rows) cost one scoring."""
    cand = fuzzy_candidates(queries.select("ql", "m").distinct(), values, grams_of)
    scored = cand.withColumn("d", substring_distance(F.col("value"), F.col("ql"), F.col("m")))
    k = F.floor(F.col("m") * THRESHOLD)
    per_text = (scored.where(F.col("d") <= k)
                .groupBy("ql", "ord").agg((F.min("d") / F.first("m")).alias("score")))
    return queries.select("query_id", "ql").join(per_text, "ql").select("query_id", "ord", "score")


def lookup_cascade(queries: DataFrame, items: DataFrame) -> DataFrame:
    """J3. ``queries``: query_id, query. ``items``: ord, name, aliases
    (array<string>), command, prompt_command, prompt_use_stdin.

    Returns one row per query: query_id, query, ok, tier, ord, name, score,
    error, command_for_prompt, pipe_input.

    The queries, the catalogue and each tier's result are checkpointed to the
    shared checkpoint folder: every later tier reads them again, and without
    the cuts each branch would re-derive its inputs from the sources (no
    exchange reuse across differently optimised copies)."""
    from textloom.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(queries.sparkSession)
    q = (queries.withColumn("ql", F.lower("query")).withColumn("m", F.coalesce(F.length("query"), F.lit(0))))
    q = q.checkpoint(eager=True)
    items = items.checkpoint(eager=True)
    live = q.where(F.col("m") > 0)
    names = items.select("ord", F.lower("name").alias("nl"))

    exact = (live.join(names, F.col("ql") == F.col("nl")).groupBy("query_id")
             .agg(F.min("ord").alias("ord")).withColumn("tier_no", F.lit(0)))
    aliases = items.select("ord", F.explode("aliases").alias("a")).select("ord", F.lower("a").alias("al"))
    alias = (live.join(aliases, F.col("ql") == F.col("al")).groupBy("query_id")
             .agg(F.min("ord").alias("ord")).withColumn("tier_no", F.lit(1)))
    first = exact.unionByName(alias)
    # Lowest tier, then first in list order
    first = first.groupBy("query_id").agg(F.min(F.struct("tier_no", "ord")).alias("b")).select(
        "query_id", F.col("b.tier_no").alias("tier_no"), F.col("b.ord").alias("ord")).checkpoint(eager=True)

    rest = live.join(first.select("query_id"), "query_id", "left_anti")
    # Candidates containing the query: they hold all its grams, so they are met by its rarest one. A text with a gram that no name
    # holds is in none.
    index, freq = gram_index(names.select("ord", F.col("nl").alias("value")))
    texts = rest.select("ql", "m").distinct()
    size = F.least(F.lit(3), F.col("m"))
    full = F.filter("gs", lambda g: F.length(g) == size)  # rarest first
    rare = gram_counts(texts, freq).where(F.size(full) == F.size(F.array_distinct(F.filter(grams(F.col("ql")), lambda g: F.length(g) == size)))) \
        .select("ql", F.element_at(full, 1).alias("g"))
    held = meet(rare, index, freq).where(F.col("value").contains(F.col("ql"))).select("ql", "ord", F.col("value").alias("nl"))
    cand = rest.select("query_id", "ql").join(held, "ql").select("query_id", "ord", "nl", "ql")
    # A2: unique suffix / unique substring (count and first by order)
    suffix = (cand.where(F.col("nl").endswith(F.col("ql"))).groupBy("query_id")
              .agg(F.count(F.lit(1)).alias("c"), F.min("ord").alias("ord"))
              .where(F.col("c") == 1).select("query_id", "ord", F.lit(2).alias("tier_no")))
    substr = (cand.groupBy("query_id").agg(F.count(F.lit(1)).alias("c"), F.min("ord").alias("ord"))
              .where(F.col("c") == 1).select("query_id", "ord", F.lit(3).alias("tier_no")))
    second = suffix.unionByName(substr).groupBy("query_id").agg(F.min(F.struct("tier_no", "ord")).alias("b")).select(
        "query_id", F.col("b.tier_no").alias("tier_no"), F.col("b.ord").alias("ord")).checkpoint(eager=True)

    rest2 = rest.join(second.select("query_id"), "query_id", "left_anti")
    fz = fuzzy_matches(rest2.select("query_id", "ql", "m"), names.select("ord", F.col("nl").alias("value")), (index, freq))
    # Rank by (score, ord); ambiguity from the gap between the top two.
    w = Window.partitionBy("query_id").orderBy("score", "ord")
    ranked = (fz.withColumn("rn", F.row_number().over(w))
              .withColumn("top", F.first("score").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
              .checkpoint(eager=True))
    per_q = ranked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("s1"),
        F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("s2"),
        F.min_by("ord", F.struct("score", "ord")).alias("ord"))
    ambiguous = (F.col("n") >= 2) & (F.abs(F.col("s1") - F.col("s2")) < AMBIGUITY_GAP)
    fuzzy = per_q.select("query_id", F.when(~ambiguous, F.col("ord")).alias("ord"), F.lit(4).alias("tier_no"),
                         F.col("s1").alias("score"), ambiguous.alias("ambiguous"))

    # A4: the ambiguous candidates (within the gap of the best), in rank order.
    near = (ranked.where(F.abs(F.col("score") - F.col("top")) < AMBIGUITY_GAP)
            .join(items.select("ord", "name", "aliases"), "ord"))
    label = F.concat(F.lit("  • "), F.col("name"),
                     F.when(F.size("aliases") > 0, F.concat(F.lit(" ("), F.array_join("aliases", ", "), F.lit(")")))
                     .otherwise(F.lit("")))
    cands = (near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("score", "ord", label.alias("l"))))
                                          .alias("_c"))
             .select("query_id", F.array_join(F.transform("_c", lambda s: s["l"]), "\n").alias("candidates")))

    resolved = (first.withColumn("score", F.lit(None).cast("double")).withColumn("ambiguous", F.lit(False))
                .unionByName(second.withColumn("score", F.lit(None).cast("double")).withColumn("ambiguous", F.lit(False)))
                .unionByName(fuzzy))
    tier_names = F.array(*[F.lit(t) for t in TIERS])
    out = (q.join(resolved, "query_id", "left").join(cands, "query_id", "left")
           .join(items.select("ord", "name", "command", "prompt_command", "prompt_use_stdin"), "ord", "left"))
    error = (F.when(F.col("m") == 0, F.lit(NO_QUERY))
             .when(F.coalesce(F.col("ambiguous"), F.lit(False)),
                   F.concat(F.lit("Ambiguous match for '"), F.col("query"), F.lit("'\nDid you mean:\n"),
                            F.col("candidates")))
             .when(F.col("ord").isNull(), F.concat(F.lit("No tool or template found matching '"), F.col("query"),
                                                   F.lit("'"))))
    ok = error.isNull()
    return out.select(
        "query_id", "query", ok.alias("ok"),
        F.when(ok, F.element_at(tier_names, F.col("tier_no") + 1)).alias("tier"),
        F.when(ok, F.col("ord")).alias("ord"), F.when(ok, F.col("name")).alias("name"),
        F.when(ok, F.col("score")).alias("score"), error.alias("error"),
        # The command a prompt is sent to, and whether input is piped
        F.when(ok, F.coalesce("prompt_command", "command")).alias("command_for_prompt"),
        F.when(ok, F.coalesce("prompt_use_stdin", F.lit(False))).alias("pipe_input"))


def search_topk(queries: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """J4 + W3: fuzzy search over name, description and aliases; best score
    per item; the first ``k`` by (score, ord). Returns query_id, rank, ord,
    name, score. (An empty query lists the catalogue in order; that needs no
    search: ``items.orderBy("ord").limit(k)``.)"""
    q = queries.withColumn("ql", F.lower("query")).withColumn("m", F.coalesce(F.length("query"), F.lit(0)))
    values = (items.select("ord", F.explode(F.concat(F.array("name", "description"), F.coalesce(
        "aliases", F.array().cast("array<string>")))).alias("v"))
              .where(F.length("v") > 0).select("ord", F.lower("v").alias("value")).distinct())
    hits = fuzzy_matches(q.where(F.col("m") > 0).select("query_id", "ql", "m"), values)
    w = Window.partitionBy("query_id").orderBy("score", "ord")
    top = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    res = top.select("query_id", "rank", "ord", "score")
    return res.join(items.select("ord", "name"), "ord").select("query_id", "rank", "ord", "name", "score")
