"""Removal of repeated byte strings with suffix sorting.

A byte goes when a ``length``-byte string covers it that also starts earlier: in a document with a smaller
identifier, or further up in the same document.

Routing. Each start of such a string has an anchor: of the k-byte strings inside it, the
one with the smallest hash (the first of equals). That depends on the string's bytes alone, so equal strings
have equal anchors, and neighbouring starts mostly share one: a segment is a run of starts with one
anchor. Segments meet by anchor hash, first inside a chunk of a few megabytes, where the text
is at hand, then across chunks: of a passage that fills the corpus, each chunk passes on one copy.
Texts are only fetched for anchors that come up twice.

Sorting. The starts of the segments that meet are suffix-sorted in two stages. Suffixes smaller than
their successors are sorted directly by their first ``length`` bytes. A scan over
the buckets (first bytes, ascending) then puts every other suffix behind those
already in its bucket as its successor is passed. Neighbours whose common prefix reaches ``length``
form a group of equal strings; all but its earliest start are marked.

Null texts are empty. Rows equal in identifier and text are one document and get the same result; rows that
share an identifier only are documents of their own, in an order fixed by their checksums. Null identifiers
come before all others. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import _BYTE, _P, _P_INV, cut, mix64, powers, split_by_slots, text_bytes, text_chunks

LENGTH, ANCHOR = 100, 24
CHUNK, SORT_BYTES = 2 << 20, 2 << 20
_NULL_ID = -(1 << 63)


# --- two-stage suffix sorting -----------------------------------------------

def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor; the last suffix counts as such."""
    ends = np.append(np.flatnonzero(text[:-1] != text[1:]), len(text) - 1)
    at_end = np.ones(len(ends), bool)
    at_end[:-1] = text[ends[:-1]] < text[ends[:-1] + 1]
    return np.repeat(at_end, np.diff(ends, prepend=-1))


def sort_starts(text: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """The wanted starts of ``text`` in order of their first ``length`` bytes, by two-stage sorting.

    ``text`` must go on for ``length`` bytes after the last wanted start.
    """
    direct = smaller_than_next(text)
    # What a wanted start is induced from must be sorted too: the starts up to the next direct one.
    nearest = np.where(direct, np.arange(len(text)), len(text))
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    gap = nearest[wanted] - wanted
    active = np.zeros(len(text) + 1, np.int32)
    np.add.at(active, wanted, 1)
    np.add.at(active, wanted + gap + 1, -1)
    active = np.cumsum(active)[:-1] > 0
    padded = np.concatenate([text, np.zeros(length, np.uint8)])
    strings = np.ndarray(len(text), f"S{length}", padded, strides=(1,))
    first = np.flatnonzero(active & direct)
    first = first[np.argsort(strings[first], kind="stable")]
    bounds = np.searchsorted(text[first], np.arange(257))
    pending: dict[int, list[np.ndarray]] = {}
    out = []
    induced = active & ~direct

    def before(order: np.ndarray) -> np.ndarray:
        prior = order[order > 0] - 1
        return prior[induced[prior]]

    for c in range(256):
        own = pending.pop(c, [])
        front = np.concatenate(own) if own else np.zeros(0, np.int64)
        while len(front):  # runs of one byte induce inside their own bucket
            prior = before(front)
            front = prior[text[prior] == c]
            own.append(front)
        order = np.concatenate([*own, first[bounds[c]:bounds[c + 1]]])
        if not len(order):
            continue
        out.append(order)
        prior = before(order)
        prior = prior[text[prior] > c]
        if len(prior):
            byte = text[prior]
            by = np.argsort(byte, kind="stable")
            prior, byte = prior[by], byte[by]
            for group in np.split(prior, np.flatnonzero(np.diff(byte)) + 1):
                pending.setdefault(int(text[group[0]]), []).append(group)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    is_wanted = np.zeros(len(text), bool)
    is_wanted[wanted] = True
    return order[is_wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each start in ``order`` with the one before it, up to ``length``; 0 for the first."""
    padded = np.concatenate([text, np.zeros(length + 8, np.uint8)])
    words = np.ndarray(len(text) + length, "<u8", padded, strides=(1,))
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for at in range(0, length, 8):
        x = words[order[live] + at] ^ words[order[live - 1] + at]
        same = x == 0
        out[live] = at + 8
        part = live[~same]
        low = x[~same]
        out[part] = at + np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int64) // 8
        live = live[same]
    return np.minimum(out, length)


def repeated_starts(text: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """Which wanted starts have the same ``length`` bytes as an earlier wanted one (mask over ``wanted``, ascending)."""
    order = sort_starts(text, wanted, length)
    heads = np.flatnonzero(common_prefixes(text, order, length) < length)
    earliest = np.minimum.reduceat(order, heads) if len(heads) else order
    later = order != np.repeat(earliest, np.diff(np.append(heads, len(order))))
    mask = np.zeros(len(text), bool)
    mask[order[later]] = True
    return mask[wanted]


# --- segments ------------------------------------------------------------------

def segments(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: (row, first start, count, anchor hash); starts count from the chunk's begin."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_P, n), out=sums[1:])
    hashes = mix64((sums[k:] - sums[:-k]) * powers(_P_INV, n)[:n - k + 1])
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    window, span = length - k + 1, 1
    while span * 2 <= window:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if window > span:
        low = np.minimum(low[:len(low) - (window - span)], low[window - span:])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    room = np.maximum(np.diff(offs) - length + 1, 0)  # starts per row
    row = np.repeat(np.arange(len(room)), room)
    start = np.arange(len(row)) - np.repeat(np.cumsum(room) - room, room) + offs[:-1][row]
    if not len(start):
        return none, none, none, none.astype(np.uint64)
    a = anchor[start]
    heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (row[1:] != row[:-1])]))
    return row[heads], start[heads], np.diff(np.append(heads, len(start))), mix64(hashes[a[heads]])


def _gather(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = np.cumsum(size) - size
    return data[np.arange(int(size.sum())) - np.repeat(at - first, size)]


def _marks(text: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Repeated starts of segments laid end to end (each count + length - 1 bytes), as a mask over all their starts."""
    at = np.cumsum(count + length - 1) - (count + length - 1)
    wanted = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - at, count)
    return repeated_starts(text, wanted, length)


def _runs(mask: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked starts, per segment: (segment, first start in it, number)."""
    seg = np.repeat(np.arange(len(count)), count)
    edge = np.concatenate([[True], seg[1:] != seg[:-1]]) if len(seg) else np.zeros(0, bool)
    head = np.flatnonzero(mask & (edge | ~np.concatenate([[False], mask[:-1]]) if len(mask) else mask))
    last = np.flatnonzero(mask & (np.append(edge[1:], True) | ~np.append(mask[1:], False) if len(mask) else mask))
    return seg[head], head - (np.cumsum(count) - count)[seg[head]], last - head + 1


def _anchors(length: int):
    """Rows (h, kind, doc_id, crc, lo, n): kind 0 a segment for others to meet, kind 1 a run of repeated starts."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for r0, r1, data, offs in text_chunks(batch.column(1), CHUNK):
                crc = np.array([zlib.crc32(data[a:b]) for a, b in zip(offs[:-1], offs[1:])], np.int64)
                doc = ids[r0:r1]
                rank_order = np.lexsort((crc, doc))
                again = np.zeros(len(doc), bool)
                again[rank_order[1:]] = (np.diff(doc[rank_order]) == 0) & (np.diff(crc[rank_order]) == 0)
                rank = np.empty(len(doc), np.int64)
                rank[rank_order] = np.arange(len(doc))
                row, start, count, h = segments(data, offs, length)
                keep = ~again[row]
                row, start, count, h = row[keep], start[keep], count[keep], h[keep]
                order = np.lexsort((start, rank[row], h))
                row, start, count, h = row[order], start[order], count[order], h[order]
                same = h[1:] == h[:-1]
                met = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(h) else np.zeros(0, bool)
                done = np.zeros(len(h), bool)
                out = [[], [], [], [], []]
                some = np.flatnonzero(met)
                # The few segments that met are sorted in pieces that never split a hash.
                for lo, hi in _pieces(h[some], count[some] + length - 1, SORT_BYTES):
                    part = some[lo:hi]
                    text = _gather(data, start[part], count[part] + length - 1)
                    mask = _marks(text, count[part], length)
                    seg, first, n = _runs(mask, count[part])
                    done[part] = np.add.reduceat(mask.astype(np.int64), np.cumsum(count[part]) - count[part]) == count[part]
                    at = part[seg]
                    for o, v in zip(out, (mix64(doc[row[at]].view(np.uint64)), np.ones(len(at), np.int64), row[at], start[at] + first, n)):
                        o.append(v)
                left = np.flatnonzero(~done)
                for o, v in zip(out, (h[left], np.zeros(len(left), np.int64), row[left], start[left], count[left])):
                    o.append(v)
                hh, kind, rr, ss, nn = (np.concatenate(o) for o in out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hh.astype(np.uint64).view(np.int64)), pa.array(kind.astype(np.int8)), pa.array(doc[rr]), pa.array(crc[rr]),
                     pa.array((ss - offs[rr]).astype(np.int32)), pa.array(nn.astype(np.int32))], ["h", "kind", "doc_id", "crc", "lo", "n"])
    return run


def _pieces(h: np.ndarray, size: np.ndarray, limit: int):
    """(from, to) pieces of about ``limit`` bytes of rows sorted by ``h``, cut where it changes."""
    if not len(h):
        return
    ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
    total = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < len(h):
        e = ends[min(np.searchsorted(total[ends], total[lo] + limit), len(ends) - 1)]
        yield lo, int(e)
        lo = int(e)


def _fetch(length: int):
    """Bytes of the wanted segments of each document."""
    def run(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column(2))
            lists = batch.column(3)
            per = np.asarray(lists.value_lengths())
            ends = np.concatenate([[0], np.cumsum(per)])
            flat = lists.flatten()
            h, lo, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("h", "lo", "n"))
            row = np.repeat(np.arange(batch.num_rows), per)
            size = n.astype(np.int64) + length - 1
            for a, b in _pieces(np.arange(len(h)), size, 8 << 20):
                raw = _gather(data, (offs[row[a:b]] + lo[a:b]).astype(np.int64), size[a:b])
                cuts = np.concatenate([[0], np.cumsum(size[a:b])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[a:b]), batch.column(0).take(pa.array(row[a:b])), batch.column(1).take(pa.array(row[a:b])), pa.array(lo[a:b]),
                     pa.array(n[a:b]), pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(raw.tobytes())])],
                    ["h", "doc_id", "crc", "lo", "n", "bytes"])
    return run


def _meet(length: int):
    """Runs of repeated starts among segments that come sorted by (h, doc_id, crc, lo).

    At most SORT_BYTES are sorted at once. Where that cuts a hash, the segments seen so far that hold an earliest
    start stay for the next piece, so memory follows the number of different strings, not of copies.
    """
    def work(table: pa.Table, carried: int):
        h, doc, crc, lo, n = (table.column(i).to_numpy() for i in range(5))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1]) | (lo[1:] != lo[:-1])
        table = table.filter(pa.array(new))
        carried -= int((~new[:carried]).sum())
        h, doc, crc, lo, n = (table.column(i).to_numpy() for i in range(5))
        text, _ = text_bytes(table.column(5))
        count = n.astype(np.int64)
        mask = _marks(text, count, length)
        seg, first, run_len = _runs(mask, count)
        fresh = seg >= carried
        seg, first, run_len = seg[fresh], first[fresh], run_len[fresh]
        out = pa.RecordBatch.from_arrays([pa.array(doc[seg]), pa.array(crc[seg]), pa.array((lo[seg] + first).astype(np.int32)),
                                          pa.array(run_len.astype(np.int32))], ["doc_id", "crc", "lo", "n"])
        whole = np.add.reduceat(mask.astype(np.int64), np.cumsum(count) - count) == count
        return out, table.filter(pa.array((h == h[-1]) & ~whole))

    def run(batches):
        have, size, carried = [], 0, 0
        for batch in batches:
            step = max(1, batch.num_rows * SORT_BYTES // max(1, batch.column(5).nbytes))
            for at in range(0, batch.num_rows, step):
                have.append(batch.slice(at, step))
                size += have[-1].column(5).nbytes if step >= batch.num_rows else SORT_BYTES
                if size >= SORT_BYTES:
                    out, rest = work(pa.Table.from_batches(have), carried)
                    yield out
                    have, size, carried = rest.combine_chunks().to_batches(), 0, rest.num_rows
        if have and sum(b.num_rows for b in have) > carried:
            yield work(pa.Table.from_batches(have), carried)[0]
    return run


def _finish(length: int):
    """Result and remaining bytes of documents with runs of repeated starts."""
    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(5)]
            for i in range(batch.num_rows):
                data, _ = text_bytes(batch.column(1).slice(i, 1))
                runs = batch.column(2).slice(i, 1).flatten()
                lo, n = (runs.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "n"))
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, lo, 1)
                np.add.at(edge, lo + n + length - 1, -1)
                gone = np.cumsum(edge)[:-1] > 0
                left = data[~gone].tobytes()
                for c, v in zip(cols, (len(data), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()),
                                       hashlib.sha256(left).hexdigest(), left)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def repeated_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, crc, lo, n): runs of starts whose ``length`` bytes also start earlier, for ``docs(doc_id, text)``
    without null identifiers; ``crc`` is the text's CRC-32. The run covers n + length - 1 bytes."""
    rows = docs.mapInArrow(_anchors(length), "h long, kind byte, doc_id long, crc long, lo int, n int")
    w = Window.partitionBy("h", "kind").orderBy("doc_id")
    near = rows.withColumn("prior", F.lag("doc_id").over(w)).withColumn("next", F.lead("doc_id").over(w))
    near = cut(near.where("kind = 1 or prior is not null or next is not null").drop("prior", "next"), "anchors")
    lists = (near.where("kind = 0").groupBy("doc_id", "crc").agg(F.collect_list(F.struct("h", "lo", "n")).alias("wanted")))
    key = ["doc_id", "crc"]
    some, _ = split_by_slots(docs, "doc_id", near.where("kind = 0").select("doc_id"))
    some = some.withColumn("crc", F.crc32(F.col("text").cast("binary")))
    met = (some.join(lists, key).select("doc_id", "crc", "text", "wanted")
           .mapInArrow(_fetch(length), "h long, doc_id long, crc long, lo int, n int, bytes binary")
           .repartition("h").sortWithinPartitions("h", "doc_id", "crc", "lo")
           .mapInArrow(_meet(length), "doc_id long, crc long, lo int, n int"))
    return cut(met.union(near.where("kind = 1").select("doc_id", "crc", "lo", "n")), "runs")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row of ``docs``; ``kept`` holds the remaining bytes."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    runs = repeated_runs(base, length)
    some, rest = split_by_slots(base, "doc_id", runs.select("doc_id"))
    lists = runs.groupBy("doc_id", "crc").agg(F.collect_list(F.struct("lo", "n")).alias("runs"))
    some = some.withColumn("crc", F.crc32(F.col("text").cast("binary"))).join(lists, ["doc_id", "crc"], "left")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    changed = some.where("runs is not null").select("doc_id", "text", "runs").mapInArrow(_finish(length), out)
    same = some.where("runs is null").select("doc_id", "text").union(rest.select("doc_id", "text"))
    raw = F.col("text").cast("binary")
    none = F.lit(0).cast("long")
    same = same.select("doc_id", F.length(raw).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
                       F.sha2(raw, 256).alias("kept_sha256"), raw.alias("kept"))
    return changed.union(same).withColumn("doc_id", F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")))
