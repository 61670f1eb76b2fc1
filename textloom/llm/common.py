"""Helpers shared by the operators: shared-folder tables, byte/word arrays, components.

The numpy helpers work on one Arrow batch inside a task, a few megabytes of
text at a time, so a task's memory does not grow with its partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.session import ensure_checkpoint_dir

CHUNK_BYTES = 2 << 20
WS = r"[\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, removed when the
    application's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/textloom-{name}-{uuid.uuid4().hex}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the
    lineage ends there, and a lost executor costs no more than its tasks.
    The write's own shuffle files are deleted with its end."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that ``cut`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- bytes and words ---------------------------------------------------------

def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_P = 0x5851F42D4C957F2D
_P_INV = pow(_P, -1, 1 << 64)
_pow: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next call."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        a[0] = 1
        have = _pow[base] = np.cumprod(a, dtype=np.uint64)
    return have[:n]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string or binary array (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset:col.offset + len(col) + 1]
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def text_chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of at most
    ``limit`` bytes; a longer row comes alone."""
    data, offs = text_bytes(col)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def lower_ascii(b: np.ndarray) -> np.ndarray:
    return np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)


def word_bounds(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes other than ASCII white space,
    never across rows) and the index of each row's first word."""
    w = ~SPACE[b]
    full = offs[:-1] < offs[1:]
    first, last = offs[:-1][full], offs[1:][full] - 1
    s, e = w.copy(), w.copy()
    s[1:] &= ~w[:-1]
    e[:-1] &= ~w[1:]
    s[first], e[last] = w[first], w[last]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    v = _BYTE[b] * powers(_P, len(b))
    v[SPACE[b]] = 0
    h = np.add.reduceat(v, starts) * powers(_P_INV, len(b))[starts]
    return mix64(h + (ends - starts).astype(np.uint64))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring hashes (len(h) - size + 1 values)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, size, np.uint64)
    for k in range(size):
        acc = mix64(acc * np.uint64(_P) + h[k:k + n])
    return acc


# --- connected components -----------------------------------------------------

def stars(edges: DataFrame, name: str = "components") -> DataFrame:
    """The components of ``edges(a, b)`` as stars: one row (a, b) for each node but the smallest of its
    component, with b that smallest node.

    Alternating large-star and small-star rounds: each round is two grouped
    minima and joins, written to the shared folder, until only stars are left.
    A node's neighbours are never gathered in one task.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _only_stars(e):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct(), name)
        drop(e)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                            F.col("m").alias("b"))
        e = cut(small.where("a <> b").distinct(), name)
        drop(large)
    return e


def _only_stars(e: DataFrame) -> bool:
    """Has every node one link to a smaller node, or links from larger nodes, but not both?"""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        e.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up + down > 1").count() == 0


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest reachable node per node of ``edges(a, b)``: (node, component)."""
    e = stars(edges, name)
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def link_buckets(rows: DataFrame, verify: Callable[[DataFrame], DataFrame], prune: Callable | None = None,
                 refine: Callable[[DataFrame], DataFrame] | None = None, name: str = "links",
                 narrow: tuple[Callable[[DataFrame], DataFrame], Callable] | None = None,
                 rest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Components of the graph whose links join nodes of one bucket: (node, component), for every
    linked node but the smallest of its component.

    ``rows(key, node, info)`` lists the buckets of each node; ``verify`` turns
    distinct pairs (a, b) into the links among them; ``prune(info_a, info_b)`` is a cheap
    condition that every link meets. Buckets are first tested as stars: every node with the smallest
    node of its buckets and, without ``refine``, with the largest. Where a bucket then still holds several components, ``refine``
    gives its nodes (column ``node``) a sharper ``info`` and a ``rank``, and each is tested with the node
    of the highest rank in its buckets. What is then left is tested in full across components, wherever ``prune`` allows, so
    no link inside a bucket is lost, and a bucket of near copies costs a few pairs
    per node instead of all pairs. ``narrow`` makes that last step finer: its first part gives nodes (column ``node``) rows
    (key, node, info), and every link joins two rows of one such key whose infos meet its second part; a pair must share a bucket as well. ``rest`` does
    that last step itself: of rows (key, node, info, c) it gives links that join the components ``c`` of a bucket wherever its links do. A step that finds no pairs ends without further jobs, and each search for
    components goes on from the stars of the one before.
    """
    ok = prune or (lambda a, b: F.lit(True))
    w = Window.partitionBy("key").orderBy("node")
    end = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tagged = rows.withColumn("lo", F.first(F.struct("node", "info")).over(w)).withColumn("next", F.lead("node").over(w))
    tagged = tagged.withColumn("hi", F.col("lo") if refine else F.last(F.struct("node", "info")).over(end))
    hub = lambda c: F.when((F.col("node") != F.col(c)["node"]) & ok(F.col("info"), F.col(c)["info"]), F.col(c)["node"]).alias(c)
    hot = cut(tagged.where((F.col("node") != F.col("lo.node")) | F.col("next").isNotNull()).select("key", "node", "info", hub("lo"), hub("hi")), name)
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    def linked(known: DataFrame | None, pairs: DataFrame) -> DataFrame | None:
        """Stars of what was known and of the links among ``pairs``."""
        pairs = cut(pairs.distinct(), name)
        if pairs.isEmpty():
            return known
        links = verify(pairs)
        return stars(links if known is None else known.union(links), name)

    def mixed(rows: DataFrame, known: DataFrame) -> DataFrame:
        """Rows of buckets that hold several components, with their component ``c``."""
        of = known.select(F.col("a").alias("node"), F.col("b").alias("c"))
        left = rows.join(of, "node", "left").withColumn("c", F.coalesce("c", "node"))
        keys = left.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").drop("c0", "c1")
        return cut(left.join(keys, "key"), name)

    star = (hot.where(F.coalesce("lo", "hi").isNotNull()).groupBy("node").agg(F.min("lo").alias("x"), F.max("hi").alias("y"))
            .select("node", F.explode(F.array("x", "y")).alias("hub")).where("hub is not null").select(*pair("node", "hub")))
    none = rows.sparkSession.createDataFrame([], rows.select(F.col("node").alias("a"), F.col("node").alias("b")).schema)
    known = linked(None, star)
    known = none if known is None else known
    left = mixed(hot.select("key", "node", "info"), known)
    drop(hot)
    if not left.isEmpty():
        if refine:
            left = cut(left.drop("info").join(refine(left.select("node").distinct()), "node"), name)
            best = F.max_by(F.struct("node", "info", "c", "rank"), F.struct("rank", "node")).alias("hub")
            to_hub = left.join(left.groupBy("key").agg(best), "key")
            found = (to_hub.where((F.col("c") != F.col("hub.c")) & ok(F.col("info"), F.col("hub.info")))
                     .groupBy("node").agg(F.max_by("hub.node", F.struct("hub.rank", "hub.node")).alias("hub")).select(*pair("node", "hub")))
            known = linked(known, found)
            left = mixed(left.select("key", "node", "info"), known)
        if rest:
            return stars(known.union(rest(left)), name).select(F.col("a").alias("node"), F.col("b").alias("component"))
        may = lambda x, y: ok(x["info"], y["info"])
        if narrow and not left.isEmpty():
            finer, meet = narrow
            of = left.groupBy("node").agg(F.first("info").alias("info"), F.collect_set("key").alias("buckets"))
            left = mixed(finer(of.select("node")).withColumnRenamed("info", "finer").join(of, "node"), known)
            may = lambda x, y: ok(x["info"], y["info"]) & meet(x["finer"], y["finer"]) & F.arrays_overlap(x["buckets"], y["buckets"])
        side = F.struct(*[c for c in left.columns if c not in ("key", "node", "c")])
        x, y = (left.select("key", "node", "c", side.alias("side")).alias(t) for t in "xy")
        found = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c"))
                       & may(F.col("x.side"), F.col("y.side"))).select(*pair("x.node", "y.node"))
        known = linked(known, found)
    return known.select(F.col("a").alias("node"), F.col("b").alias("component"))


def split_by_slots(docs: DataFrame, key: str, wanted: DataFrame, slots: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two parts: rows whose ``key`` may be in ``wanted(key)``, and rows whose key cannot be.

    Only slot numbers are broadcast, at most ``slots`` integers whatever the
    sizes, so the second part needs no shuffle.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")
    seen = F.broadcast(wanted.select(slot.alias("_slot")).distinct())
    cond = slot == F.col("_slot")
    return docs.join(seen, cond, "left_semi"), docs.join(seen, cond, "left_anti")
