"""Near dedup by SimHash and BK-trees.

A text's words (ASCII letters lower-cased) give three-word shingles, repeats included; fewer words give one
shingle of them all. A fingerprint bit is 1 if it is set in over half the shingles' XXH64 values (seed 42). A text without
words, empty or null, has fingerprint zero and is linked like any other.

Fingerprints within ``radius`` bits are linked, and a document's component is the smallest identifier that links reach:

1. Equal fingerprints are one node: only distinct ones go on.
2. ``radius + agree`` blocks of bits: two fingerprints within the radius agree on ``agree`` of them at least. A node goes into one shard
   for each choice of ``agree`` blocks, named by the choice and the bits there, so no link is lost between shards. ``agree`` grows with the
   number of nodes, so that a shard of evenly spread fingerprints stays small; it never changes the result.
3. Every shard is a BK-tree: a node's children are keyed by their integer Hamming distance to it. A query follows only edges within the radius
   of its own distance. Trees hold ``TREE`` nodes at most; a larger shard is dealt over several trees by a hash of the node.
   Each node is looked up in its own tree, and a tree returns links that span its components, never all pairs.
4. Only larger shards need more: where one still holds several components, every node outside its largest one is looked up in all of its
   trees. The nodes come in blocks of ``QUERIES``, and each tree goes once to each block: a broadcast inside the shard, whose size is
   bounded by ``TREE``, whatever the size of the shard. A subtree that lies in the query's own component whole is not entered.
5. Components of all links give the result.

Rows that repeat an identifier count as one document, also with different texts. Null identifiers link others, but name no component;
a component with nothing else has a null component_id. An empty table gives no rows. Extra columns are not read. Identifiers
are integers.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, split_by_slots, stars, text_bytes

SHINGLE, SEED, RADIUS = 3, 42, 3
TREE, QUERIES, SHARD = 2048, 2048, 512
FRONTIER = 1 << 18  # (query, node) pairs compared at once
FOREST = 1 << 16  # rows of whole shards searched at once
HOT_KEYS = 100_000
_RUN = 1 << 17


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # bytes: ASCII letters, and white space \x20 \x09-\x0D
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-SHINGLE] + 1])
    ends = ends[SHINGLE - 1:]
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), _RUN):
        h = np.array([digest(line[s:e], SEED) for s, e in zip(starts[k:k + _RUN].tolist(), ends[k:k + _RUN].tolist())], "<u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        data, offs = text_bytes(batch.column(1))
        fps = [fingerprint(data[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])


# --- BK-trees ------------------------------------------------------------------

class Forest:
    """BK-trees of many shards as arrays. ``fp`` holds the fingerprints, ``shard`` their shards in ascending order; the first
    of a shard is its root. ``group``: each one's component, as a number from 0."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray, group: np.ndarray | None = None):
        self.fp, self.group = fp, group
        n = len(fp)
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if n else np.zeros(0, np.int64)
        self.root_of = dict(zip(shard[first].tolist(), first.tolist()))
        size = np.diff(np.append(first, n))
        at = np.repeat(first, size)  # the node that each fingerprint has come down to
        todo = np.flatnonzero(at != np.arange(n))
        parents, labels, nodes, levels = [], [], [], [first]
        while len(todo):
            d = np.bitwise_count(fp[todo] ^ fp[at[todo]]).astype(np.int64)
            edge, one, back = np.unique(at[todo] * 65 + d, return_index=True, return_inverse=True)
            child = todo[one]  # the first to come along an edge becomes its child
            nodes.append(child)
            parents.append(edge // 65)
            labels.append(edge % 65)
            levels.append(child)
            at[todo] = child[back]
            todo = todo[child[back] != todo]
        parent, label, node = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parents, labels, nodes))
        order = np.argsort(parent * 65 + label, kind="stable")
        self.edge, self.child = (parent * 65 + label)[order], node[order]
        self.whole = None
        if group is not None:  # the component of a subtree that lies in one whole, else -1
            up = np.full(n, -1, np.int64)
            up[node] = parent
            whole = group.copy()
            for level in reversed(levels[1:]):
                differ = level[whole[level] != whole[up[level]]]
                whole[up[differ]] = -1
            self.whole = whole

    def near(self, query: np.ndarray, root: np.ndarray, radius: int, group: np.ndarray | None = None):
        """(query number, node) pairs within ``radius``, in parts; query i starts from node ``root[i]``."""
        stack = [(np.arange(len(query)), root)]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(q[half:], node[half:]), (q[:half], node[:half])]
                continue
            if group is not None:
                enter = self.whole[node] != group[q]
                q, node = q[enter], node[enter]
            if not len(q):
                continue
            d = np.bitwise_count(query[q] ^ self.fp[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit]
            lo = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), "right")
            many = hi - lo
            follow = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            stack.append((np.repeat(q, many), self.child[follow]))


def _least(least: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``least`` (a smaller or equal member of each one's component) after the links (a, b) too."""
    while True:
        x, y = least[a], least[b]
        apart = x != y
        if not apart.any():
            return least
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = least[least]
            if (up == least).all():
                break
            least = up


def _whole_shards(batches):
    """(shard, fp, other columns ...) arrays of whole shards, from batches sorted by shard."""
    kept, rows = [], 0
    for batch in batches:
        kept.append(batch)
        rows += batch.num_rows
        if rows < FOREST:
            continue
        t = pa.Table.from_batches(kept)
        shard = t.column(0).to_numpy()
        end = int(np.searchsorted(shard, shard[-1], "left"))
        if end:
            yield t.slice(0, end)
        kept, rows = t.slice(end).to_batches(), t.num_rows - end
    if rows:
        yield pa.Table.from_batches(kept)


def _inside(radius: int):
    """Links that span the components of each tree, from rows (tree, fp)."""
    def run(batches):
        for t in _whole_shards(batches):
            shard, fp = t.column(0).to_numpy(), t.column(1).to_numpy().view(np.uint64)
            forest = Forest(fp, shard)
            first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            root = np.repeat(first, np.diff(np.append(first, len(fp))))
            least = np.arange(len(fp))
            for q, node in forest.near(fp, root, radius):
                least = _least(least, q, node)
            far = np.flatnonzero(least != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[far].view(np.int64)), pa.array(fp[least[far]].view(np.int64))], ["a", "b"])
    return run


def _across(radius: int):
    """Links between components, from rows (meeting, fp, component, is a query): each meeting's queries in its tree."""
    def run(batches):
        for t in _whole_shards(batches):
            shard, fp, named, asks = (t.column(k).to_numpy() for k in range(4))
            names, group = np.unique(named, return_inverse=True)
            fp, asks = fp.view(np.uint64), asks.astype(bool)
            forest = Forest(fp[~asks], shard[~asks], group[~asks])
            root = np.array([forest.root_of.get(s, -1) for s in shard[asks].tolist()], np.int64)
            some = root >= 0  # a hash may leave a tree empty
            query, own = fp[asks][some], group[asks][some]
            for q, node in forest.near(query, root[some], radius, own):
                link = np.unique(np.stack([own[q], forest.group[node]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(names[x]) for x in link], ["a", "b"])
    return run


# --- Spark jobs ------------------------------------------------------------------

def shard_keys(fp: Column, radius: int, agree: int) -> list[Column]:
    """A key for each choice of ``agree`` of ``radius + agree`` blocks: equal where the bits of those blocks are. (Two shards whose
    hashed names fall together are one larger shard; distances decide.)"""
    blocks = radius + agree
    edges = [64 * k // blocks for k in range(blocks + 1)]
    bits = [((1 << edges[k + 1]) - (1 << edges[k])) for k in range(blocks)]
    keys = []
    for k, choice in enumerate(combinations(bits, agree)):
        mask = sum(choice)
        keys.append(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return keys


def blocks_to_agree(nodes: int, radius: int) -> int:
    """Fewest blocks that keep a shard of evenly spread nodes at ``SHARD`` or below."""
    return next((a for a in range(1, 6) if nodes >> (64 * a // (radius + a)) < SHARD), 6)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``, the fingerprint as a signed 64-bit number."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(_fingerprints, "doc_id long, fp long")


def _hot(rows: DataFrame, hot: DataFrame, n_hot: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to the larger shards: broadcast up to ``HOT_KEYS`` of them, by key beyond."""
    return rows.join(F.broadcast(hot) if n_hot <= HOT_KEYS else hot, "key", how)


def node_links(nodes: DataFrame, count: int, radius: int = RADIUS, name: str = "bk") -> DataFrame:
    """Stars (a, b) of the components that links within ``radius`` bits make of ``nodes(fp)``."""
    rows = nodes.select(F.explode(F.array(*shard_keys(F.col("fp"), radius, blocks_to_agree(count, radius)))).alias("key"), "fp")
    hot = cut(rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > TREE)
              .select("key", F.ceil(F.col("size") / TREE).cast("int").alias("parts")), name)
    n_hot = hot.count()
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tree = F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", part))
    dealt = (_hot(rows, hot, n_hot, "left") if n_hot else rows.withColumn("parts", F.lit(None).cast("int"))).select(tree.alias("tree"), "fp")
    inside = dealt.repartition("tree").sortWithinPartitions("tree").mapInArrow(_inside(radius), "a long, b long")
    known = stars(inside, name)
    if not n_hot:
        return known
    of = known.select(F.col("a").alias("fp"), F.col("b").alias("c"))
    larger = cut(_hot(rows, hot, n_hot).join(of, "fp", "left").withColumn("c", F.coalesce("c", "fp")), name)
    shares = larger.groupBy("key", "c").agg(F.count("*").alias("n"))
    mixed = (shares.groupBy("key").agg(F.max(F.struct("n", "c"))["c"].alias("main"), F.sum("n").alias("size"), F.max("n").alias("most"))
             .where("size > most").select("key", "main", F.ceil((F.col("size") - F.col("most")) / QUERIES).cast("int").alias("blocks")))
    met = _hot(larger, cut(mixed, name), n_hot)
    block = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    trees = met.select("key", "fp", "c", part.alias("part"), every("blocks").alias("block"), F.lit(0).alias("asks"))
    asking = met.where("c <> main").select("key", "fp", "c", every("parts").alias("part"), block.alias("block"), F.lit(1).alias("asks"))
    meeting = trees.unionByName(asking).select(F.xxhash64("key", "part", "block").alias("meeting"), "fp", "c", "asks")
    found = cut(meeting.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(_across(radius), "a long, b long"), name)
    return known if found.isEmpty() else stars(known.union(found), name)


def _name(rows: DataFrame, key: str, table: DataFrame, total: int) -> DataFrame:
    """``rows`` with their row of ``table(key, size, ...)``, where size is the number of rows with that key and ``total`` that of
    all rows: the keys with a thousandth of all rows each, a thousand at most, are broadcast."""
    heavy = table.where(F.col("size") * 1000 >= total).drop("size")
    some = F.broadcast(heavy)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(table.drop("size"), key)
    return rows.join(some, key).unionByName(rest)


def near_simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``."""
    fps = cut(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")), "classes")
    known = node_links(classes.select("fp"), classes.count(), radius)
    ids = fps.where("doc_id is not null")
    apart = cut(ids.groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("a")).where("a <> b").select("doc_id", "b"), "repeated")
    if not apart.isEmpty():  # the texts of one document are one node
        some, _ = split_by_slots(ids, "doc_id", apart)
        known = stars(known.union(some.join(apart, "doc_id").select(F.col("fp").alias("a"), "b")), "repeated")
    of = known.select(F.col("a").alias("fp"), F.col("b").alias("c"))
    member = cut(classes.join(of, "fp", "left").withColumn("c", F.coalesce("c", "fp")), "members")
    groups = cut(member.groupBy("c").agg(F.min("first").alias("component_id"), F.count("*").alias("size")), "groups")
    named = cut(_name(member.withColumnRenamed("size", "rows"), "c", groups, member.count()).select("fp", "component_id", F.col("rows").alias("size")), "named")
    return _name(fps, "fp", named, fps.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
