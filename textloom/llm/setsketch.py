"""Near dedup with SetSketch registers.

Every document's set of five-word shingles gets 128 registers. Register i is
floor(1 - log_b x) of the smallest exponentially distributed value x that hash i gives
any element, cut off at both ends: a small integer on an exponential scale.
Equal sets have equal registers, and the registers of a union are the element-wise maxima.

1. Documents with equal sets form one class; only one document of a class goes on.
2. Bands of four registers put classes into buckets. A pair at the threshold
   0.75 shares none of the 32 bands with probability 5e-6.
   A bucket is tested as stars first; for the rest, elements that no other candidate has bound the
   similarity a document can reach, and a pair must share one of the rarest elements of both, as many
   as two sets at the threshold may differ in. That settles most of what is still apart, and no link is lost.
3. Pairs from one bucket are estimated by maximum likelihood from both documents'
   registers and set sizes; those far below the threshold (five standard errors) go.
4. The rest are decided exactly on their full shingle sets.
5. Components of the links give the result.

Null and empty texts, and those of white space only, have an empty set and are linked with
nothing. Rows that repeat an identifier are one document, with one component, even when their texts differ: whatever
is linked with one of the texts is linked with all. (A row without words stays alone in any case.) Rows with a null
identifier are linked with nothing either, and their component_id is null. Identifiers are read as long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import (cut, link_buckets, lower_ascii, mix64, split_by_slots, stars, text_chunks, window_hashes,
                                 word_bounds, word_hashes)

SHINGLE, REGISTERS, BAND, BASE, RATE, TOP = 5, 128, 4, 1.005, 20.0, 65_534
MARGIN = 0.20
_MUL = mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row of UTF-8 bytes; fewer than five words: one hash of all."""
    low = lower_ascii(data)
    starts, ends, first = word_bounds(low, offs)
    words = word_hashes(low, starts, ends)
    five = window_hashes(words, SHINGLE)
    for lo, hi in zip(first[:-1], first[1:]):
        if hi - lo >= SHINGLE:
            yield np.unique(five[lo:hi - SHINGLE + 1])
        elif hi > lo:
            yield window_hashes(words[lo:hi], int(hi - lo))
        else:
            yield np.zeros(0, np.uint64)


def registers(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers (rows x 128, uint16) of the runs of ``values`` that begin at ``starts``."""
    out = np.empty((len(starts), REGISTERS), np.uint16)
    for i in range(REGISTERS):
        low = np.minimum.reduceat(values * _MUL[i], starts)
        x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0 ** 64 * (1 - 2.0 ** -53)) / RATE
        out[:, i] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP)
    return out


def _sketch(batches):
    for batch in batches:
        for lo, hi, data, offs in text_chunks(batch.column(1)):
            sets = list(shingle_sets(data, offs))
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            regs = np.zeros((len(sets), REGISTERS), np.uint16)
            sums = np.zeros((2, len(sets)), np.uint64)
            if len(full):
                values = np.concatenate([sets[i] for i in full])
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                regs[full] = registers(values, starts)
                sums[0, full] = np.add.reduceat(mix64(values), starts)
                sums[1, full] = np.add.reduceat(mix64(values ^ np.uint64(0xA5A5A5A55A5A5A5A)), starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(sizes), *(pa.array(s.view(np.int64)) for s in sums),
                 pa.array([r.tobytes() for r in regs], pa.binary())], ["doc_id", "t", "n", "h1", "h2", "regs"])


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from registers and known set sizes, on a grid of 1/200."""
    more, less = (ra > rb).sum(1)[:, None], (ra < rb).sum(1)[:, None]
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    like = more * np.log(up) + less * np.log(down) + (REGISTERS - more - less) * np.log(np.clip(1 - up - down, 1e-12, 1))
    return j[np.arange(len(j)), like.argmax(1)]


def _likely(floor: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            reg = lambda i: np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            num = lambda i: batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64)
            keep = np.concatenate([estimate(reg(2)[k:k + 1000], reg(4)[k:k + 1000], num(3)[k:k + 1000], num(5)[k:k + 1000])
                                   for k in range(0, batch.num_rows, 1000)]) >= floor
            yield batch.select([0, 1]).filter(pa.array(keep))
    return run


def _exact(percent: int):
    def run(batches):
        last_id, last = None, None
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for lo, hi, data, offs in text_chunks(batch.column(2)):
                for i, left in zip(range(lo, hi), shingle_sets(data, offs)):
                    if (b := batch.column(1)[i].as_py()) != last_id:
                        _, _, one, at = next(text_chunks(batch.column(3).slice(i, 1)))
                        last_id, last = b, next(shingle_sets(one, at))
                    both = len(np.intersect1d(left, last, assume_unique=True))
                    keep[i] = 100 * both >= percent * (len(left) + len(last) - both) and both > 0
            yield batch.select([0, 1]).filter(pa.array(keep))
    return run


def _elements(batches):
    """(node, element) rows of sets."""
    for batch in batches:
        for lo, hi, data, offs in text_chunks(batch.column(1)):
            sets = list(shingle_sets(data, offs))
            nodes = np.repeat(batch.column(0).slice(lo, hi - lo).to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(sets).view(np.int64))], ["node", "h"])


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``: documents are linked when
    100 * |intersection| >= percent * |union| of their shingle sets; a component's smallest identifier names it."""
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))
    sketch = cut(base.mapInArrow(_sketch, "doc_id long, t long, n long, h1 long, h2 long, regs binary"), "sketch")
    key = ["n", "h1", "h2"]
    full = sketch.where("n > 0 and doc_id is not null")
    # A class is named by a number: its smallest document may be that of other classes too. ``t`` tells the texts of one identifier apart.
    classes = cut(full.groupBy(*key).agg(F.min(F.struct("doc_id", "t")).alias("least")).select(*key, "least.*")
                  .withColumn("rep", F.monotonically_increasing_id()), "classes")
    reps = cut(classes.join(full, [*key, "doc_id", "t"]).dropDuplicates(["rep"]).select("rep", "doc_id", "t", "n", "regs"), "reps")
    band = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)),
                       lambda i: F.xxhash64(i, F.substr("regs", i * (2 * BAND) + 1, F.lit(2 * BAND))))
    info = lambda n, common: F.struct(n.alias("n"), common.alias("common"))
    rows = reps.select(F.explode(band).alias("key"), F.col("rep").alias("node"), info(F.col("n"), F.col("n")).alias("info"))
    texts = _TextTable(base, reps)

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda c: reps.select(F.col("rep").alias(c), F.col("regs").alias(f"regs_{c}"), F.col("n").alias(f"n_{c}"))
        likely = (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "regs_a", "n_a", "regs_b", "n_b")
                  .mapInArrow(_likely(percent / 100 - MARGIN), "a long, b long"))
        likely = cut(likely, "likely")
        t = texts.of(likely.select(F.col("a").alias("rep")).union(likely.select("b")).distinct())
        text = lambda c: t.select(F.col("rep").alias(c), F.col("text").alias(f"text_{c}"))
        # Joined by b last, so the rows of one b come together and its set is made once.
        return (likely.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b")
                .mapInArrow(_exact(percent), "a long, b long"))

    def possible(x, y):
        """Can sets of these sizes, with so many elements that any other set has too, be similar enough?"""
        most = F.least(x["common"], y["common"])
        return 100 * most >= percent * (x["n"] + y["n"] - most)

    elements = _ElementTable(texts)

    def refine(nodes: DataFrame) -> DataFrame:
        """Counts each node's elements that no other of the nodes has: they are in no intersection."""
        lone = (elements.of(nodes).groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last")
                .groupBy("node").agg(F.count("*").alias("lone")))
        known = nodes.join(lone, "node", "left").join(reps.select(F.col("rep").alias("node"), "n"), "node")
        common = F.col("n") - F.coalesce("lone", F.lit(0))
        return cut(known.select("node", info(F.col("n"), common).alias("info"), (common / F.col("n")).alias("rank")), "refined")

    def rarest(nodes: DataFrame) -> DataFrame:
        """Each node's rarest elements, with their place in its set from the rarest on. Two sets of n and m elements
        with k of them in common both hold one of these among their first n - k + 1 and m - k + 1."""
        some = elements.table.join(nodes, "node", "left_semi")
        count = some.groupBy("h").agg(F.count("*").alias("df"))
        place = F.row_number().over(Window.partitionBy("node").orderBy("df", "h")) - 1
        placed = some.join(count, "h").withColumn("at", place).join(reps.select(F.col("rep").alias("node"), "n"), "node")
        return (placed.where((F.col("df") > 1) & (100 * (F.col("n") - F.col("at")) >= percent * F.col("n")))
                .select(F.col("h").alias("key"), "node", F.struct("n", "at").alias("info")))

    def first_shared(x, y):
        """Is the least number of common elements still ahead of both places?"""
        return (100 + percent) * F.least(x["n"] - x["at"], y["n"] - y["at"]) >= percent * (x["n"] + y["n"])

    comp = link_buckets(rows, verify, possible, refine, "near", (rarest, first_shared))
    members = _one_identifier(comp, full, classes, key)
    least = members.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = members.join(least, "component").select("rep", "component_id")
    named = classes.join(linked, "rep", "left").select(*key, F.coalesce("component_id", "doc_id").alias("component_id"))
    found = full.join(named, key).select("doc_id", "n", "component_id")
    alone = sketch.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                                     F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _one_identifier(comp: DataFrame, full: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """(rep, component, doc_id) of the classes linked with others, after linking those that hold texts of one identifier."""
    several = full.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("x"), F.max(F.struct(*key)).alias("y")).where("x <> y")
    several = cut(several.select("doc_id"), "several")
    edges = comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
    if not several.isEmpty():
        of = full.join(several, "doc_id", "left_semi").join(classes.select(*key, "rep"), key).select("doc_id", "rep").distinct()
        hub = of.groupBy("doc_id").agg(F.min("rep").alias("b"))
        edges = stars(edges.union(of.join(hub, "doc_id").where("rep <> b").select("rep", "b")), "near")
    roots = edges.select("b").distinct()
    members = edges.union(roots.select("b", "b")).toDF("rep", "component")
    return members.join(classes.select("rep", "doc_id"), "rep")


class _TextTable:
    """Texts of wanted classes, one row per class."""

    def __init__(self, base: DataFrame, reps: DataFrame):
        self.base, self.reps = base, reps.select("rep", "doc_id", "t")

    def of(self, nodes: DataFrame) -> DataFrame:
        wanted = cut(self.reps.join(nodes, "rep"), "wanted")
        some, _ = split_by_slots(self.base, "doc_id", wanted.select("doc_id"))
        return cut(some.join(wanted, ["doc_id", "t"]).dropDuplicates(["rep"]).select("rep", "text"), "texts")


class _ElementTable:
    """Set elements (node, h) of the classes asked for last."""

    def __init__(self, texts: _TextTable):
        self.texts, self.table = texts, None

    def of(self, nodes: DataFrame) -> DataFrame:
        found = self.texts.of(nodes.select(F.col("node").alias("rep"))).mapInArrow(_elements, "node long, h long")
        self.table = cut(found, "elements")
        return self.table
