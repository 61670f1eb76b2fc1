"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

Tokens are runs of anything but ASCII white space, one sequence per text. The field tags each O
(outside), B (secret begins) or I (secret goes on). Its features are a token's shape (length, digit, upper,
lower and other shares, character changes), hashed words of the token and its two neighbours, their
shapes, and features of the file. Tags are decoded by Viterbi.

Viterbi runs on whole texts, yet touches few tokens: where O beats B and I by more than
all transition weights together can change, the best path has O whatever its neighbours are, so the text
falls into short runs that are decoded exactly on their own.

The field is fitted on windows of all documents: for each kind of pattern the ``MAX_FIT`` windows around its matches that
hash lowest, and ``FIT_RANDOM`` times as many random ones. So a rare kind is learned too. Pattern matches are the tags to learn.
A window has ``FIT_TOKENS`` tokens; a shorter text is a window as it is.

Null texts are empty and have no spans. Repeated rows are scanned each. An empty table gives no rows; with
nothing to fit on, only the patterns find spans. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import SPACE, cut, lower_ascii, mix64, text_bytes, text_chunks, word_bounds, word_hashes

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
MAX_FIT, FIT_TOKENS, FIT_RANDOM, EPOCHS, RATE, DECAY = 6000, 9, 3, 50, 0.5, 1e-4
CAUTION = 2.0  # by how much the field must favour a secret
O, B, I, PAD = 0, 1, 2, -1
WORDS = 1 << 12  # hashed words
SHAPES = 6 * 5 * 5 * 4 * 3 * 2
FILES = 16
_OFF = np.cumsum([0, SHAPES, WORDS, SHAPES, WORDS, SHAPES, WORDS, FILES])
FEATURES = int(_OFF[-1])
EDGE = WORDS - 1  # the word beyond either end of a text


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _token_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, first token per row, and feature numbers (tokens x 7) of a chunk of texts."""
    starts, ends, first = word_bounds(data, offs)
    n = len(starts)
    if not n:
        return starts, ends, first, np.zeros((0, 7), np.int64)
    kind = _CLASS[data]
    total = [np.add.reduceat((kind == k).astype(np.int32), starts) for k in (1, 2, 3)]  # digits, upper, lower
    size = ends - starts
    change = np.zeros(len(data), np.int32)
    change[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    change[starts] = 0
    changes = np.add.reduceat(change, starts)
    part = lambda x, k: np.minimum(x * k // np.maximum(size, 1), k - 1)
    length = np.searchsorted([4, 8, 12, 20, 40], size, "right")
    marked = np.add.reduceat(((data == 61) | (data == 58)).astype(np.int32), starts) > 0  # = or :
    shape = ((((length * 5 + part(total[0], 5)) * 5 + np.searchsorted([1, 2, 4, 8], changes, "right")) * 4 + part(total[1], 4)) * 3
             + part(total[2], 3)) * 2 + marked
    word = (word_hashes(lower_ascii(data), starts, ends) % np.uint64(WORDS - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begins = np.zeros(n, bool)
    begins[first[:-1][np.diff(first) > 0]] = True
    finishes = np.roll(begins, -1)
    before = lambda x, edge: np.where(begins, edge, np.roll(x, 1))
    after = lambda x, edge: np.where(finishes, edge, np.roll(x, -1))
    counts = np.diff(first)
    odd = np.concatenate([[0], np.cumsum(kind == 4)])
    share = (odd[offs[1:]] - odd[offs[:-1]]) * 8 // np.maximum(np.diff(offs), 1)
    file = np.minimum(share, 3) * 4 + np.searchsorted([20, 200, 2000], counts)
    cols = [shape, word, before(shape, 0), before(word, EDGE), after(shape, 0), after(word, EDGE), file[row]]
    return starts, ends, first, np.stack([c + o for c, o in zip(cols, _OFF)], 1)


_CLASS = np.full(256, 4, np.uint8)  # other signs
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 1, 2, 3, 3
_CLASS[SPACE] = 0


def _byte_spans(spans: list[tuple[int, int, int]], text: str) -> list[tuple[int, int]]:
    at, byte, out = 0, 0, []
    for start, _, end in spans:
        if start < at:
            at, byte = 0, 0
        byte += len(text[at:start].encode("utf-8", "replace"))
        out.append((byte, byte + len(text[start:end].encode("utf-8", "replace"))))
        at = start
    return out


def _examples(max_fit: int):
    """Windows of FIT_TOKENS tokens (all of a shorter text) with kind (random ones: after the last) and rank: feature numbers and tags, flat
    lists. A task gives the lowest ranks of each kind only, so its memory stays bounded."""
    limits = [max_fit] * len(KINDS) + [max_fit * FIT_RANDOM]

    def run(batches):
        best: list[list] = [[] for _ in limits]  # heaps of (-rank, features, tags), highest rank first
        held: list[set] = [set() for _ in limits]  # their ranks: copies of a text give a window once
        for batch in batches:
            for i, text in enumerate(batch.column(0)):
                text = text.as_py() or ""
                spans = base_spans(text)
                data, offs = text_bytes(batch.column(0).slice(i, 1))
                seed = np.uint64(zlib.crc32(data.tobytes()) << 8)
                draw = mix64(np.arange(FIT_RANDOM, dtype=np.uint64) + seed)
                at = [b for b, _ in _byte_spans(spans, text)]
                ranks = mix64(mix64(np.array(at, np.uint64) + np.uint64(FIT_RANDOM)) ^ seed) >> np.uint64(1)
                wanted = [(k, int(r), place, None) for (_, k, _), r, place in zip(spans, ranks, at)]
                wanted += [(len(KINDS), int(d >> np.uint64(1)), None, int(d)) for d in mix64(draw)]
                wanted = [w for w in wanted if w[1] not in held[w[0]] and (len(best[w[0]]) < limits[w[0]] or -w[1] > best[w[0]][0][0])]
                if not wanted:
                    continue
                starts, ends, _, x = _token_features(data, offs)
                n = len(starts)
                if not n:
                    continue
                size = min(n, FIT_TOKENS)
                y = np.zeros(n, np.int64)
                for s, e in _byte_spans(spans, text):
                    a, b = np.searchsorted(ends, s, "right"), np.searchsorted(starts, e, "left")
                    y[a:b] = I
                    y[a] = B
                for kind, rank, place, d in wanted:
                    a = d % (n - size + 1) if place is None else max(
                        0, min(int(np.searchsorted(ends, place, "right")) - FIT_TOKENS // 2, n - size))
                    if rank in held[kind]:
                        continue
                    held[kind].add(rank)
                    heapq.heappush(best[kind], (-rank, x[a:a + size].astype("<i4").tobytes(), y[a:a + size].astype("<i4").tobytes()))
                    if len(best[kind]) > limits[kind]:
                        held[kind].remove(-heapq.heappop(best[kind])[0])
        for kind, heap in enumerate(best):
            for lo in range(0, len(heap), 1000):
                ranks, *lists = zip(*heap[lo:lo + 1000])
                feats, tags = ([np.frombuffer(v, "<i4") for v in c] for c in lists)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(ranks), pa.int32()), pa.array([-r for r in ranks], pa.int64()),
                     pa.array(feats, pa.list_(pa.int32())), pa.array(tags, pa.list_(pa.int32()))], ["kind", "rank", "x", "y"])
    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_fit: int = MAX_FIT) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x 3) and transitions (3 x 3), from the windows of lowest rank: at most ``max_fit`` for each kind of
    pattern, and FIT_RANDOM times as many random ones."""
    found = cut(docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(
        _examples(max_fit), "kind int, rank long, x array<int>, y array<int>"), "examples")
    limits = [max_fit * (FIT_RANDOM if k == len(KINDS) else 1) for k in range(len(KINDS) + 1)]
    # Steps of ranks, each 0.3 % wide: at most 16,128 a kind. All but those up to a kind's last step go before any shuffle of windows.
    step = F.floor(F.log2(F.col("rank") + 1.0) * 256).cast("int")
    counts = found.select("kind", "rank").distinct().groupBy("kind", step.alias("step")).count().orderBy("kind", "step").collect()
    last, seen = {}, [0] * len(limits)
    for row in counts:
        if seen[row["kind"]] < limits[row["kind"]]:
            seen[row["kind"]] += row["count"]
            last[row["kind"]] = row["step"]
    if not last:
        return np.zeros((FEATURES, 3)), np.zeros((3, 3))
    near = found.where(reduce(lambda p, q: p | q, [(F.col("kind") == k) & (step <= s) for k, s in last.items()])).distinct()
    lowest = [near.where(F.col("kind") == k).orderBy("rank", "x", "y").limit(limits[k]) for k in last]
    rows = reduce(DataFrame.union, lowest).select("x", "y").toArrow()  # bounded by max_fit
    x, y = np.zeros((rows.num_rows, FIT_TOKENS, len(_OFF) - 1), np.int32), np.full((rows.num_rows, FIT_TOKENS), PAD, np.int32)
    sizes = pc.list_value_length(rows.column("y")).to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        some = rows.take(pa.array(at))
        flat = [np.array(some.column(c).combine_chunks().flatten()) for c in "xy"]
        x[at, :size], y[at, :size] = flat[0].reshape(len(at), size, -1), flat[1].reshape(len(at), size)
    every = np.unique(np.concatenate([x.reshape(len(x), -1), y], 1), axis=0)  # one row order, so the same sums, whatever the partitioning
    return train(every[:, :-FIT_TOKENS].reshape(len(every), FIT_TOKENS, -1), every[:, -FIT_TOKENS:])


def train(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Maximum conditional likelihood by AdaGrad: forward-backward over all windows at once, those of one length
    together. Tags PAD, at the end of short windows, are no tokens."""
    w, t = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    gw, gt = np.full_like(w, 1e-8), np.full_like(t, 1e-8)
    n, sizes = len(x), (y != PAD).sum(1)
    windows = [(x[sizes == k, :k], y[sizes == k, :k]) for k in np.unique(sizes)]
    for _ in range(epochs):
        slopes = [_slope(*window, w, t) for window in windows]
        dw = sum(s for s, _ in slopes) / n - DECAY * w
        dt = sum(s for _, s in slopes) / n - DECAY * t
        gw += dw * dw
        gt += dt * dt
        w += RATE * dw / np.sqrt(gw)
        t += RATE * dt / np.sqrt(gt)
    return w, t


def _slope(x: np.ndarray, y: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood of windows of one length, by weights and by transitions."""
    gold = np.eye(3)[y]
    length = x.shape[1]
    e = w[x].sum(2)
    f, b = np.zeros_like(e), np.zeros_like(e)
    f[:, 0] = e[:, 0]
    for k in range(1, length):
        f[:, k] = e[:, k] + np.logaddexp.reduce(f[:, k - 1, :, None] + t, axis=1)
    for k in range(length - 2, -1, -1):
        b[:, k] = np.logaddexp.reduce(t + (e[:, k + 1] + b[:, k + 1])[:, None, :], axis=2)
    z = np.logaddexp.reduce(f[:, -1], axis=1)[:, None, None]
    p = np.exp(f + b - z)
    pair = np.exp(f[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[..., None])
    slope = np.repeat((gold - p).reshape(-1, 3), x.shape[2], axis=0)
    by_weight = np.stack([np.bincount(x.reshape(-1), slope[:, k], FEATURES) for k in range(3)], 1)
    return by_weight, np.einsum("nli,nlj->ij", gold[:, :-1], gold[:, 1:]) - pair.sum((0, 1))


def viterbi(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Best tags of one sequence of emission scores."""
    score, back = e[0], np.zeros((len(e), 3), np.int64)
    for k in range(1, len(e)):
        step = score[:, None] + t
        back[k] = step.argmax(0)
        score = step.max(0) + e[k]
    out = np.zeros(len(e), np.int64)
    out[-1] = score.argmax()
    for k in range(len(e) - 1, 0, -1):
        out[k - 1] = back[k, out[k]]
    return out


def decode(e: np.ndarray, t: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Viterbi tags of all sequences (``first`` holds their first tokens), touching only undecided runs."""
    out = np.zeros(len(e), np.int64)
    swing = 2 * (t.max() - t.min())  # most that both transitions of a token can favour another tag
    open_ = e[:, O] - e[:, 1:].max(1) <= swing
    if not open_.any():
        return out
    at = np.flatnonzero(open_)
    row = np.searchsorted(first, at, "right")
    cut_ = np.flatnonzero((np.diff(at) > 1) | (np.diff(row) > 0)) + 1
    for run in np.split(at, cut_):
        lo, hi = run[0], run[-1] + 1
        r = np.searchsorted(first, lo, "right") - 1
        here = e[lo:hi].copy()
        if lo > first[r]:
            here[0] += t[O]  # the token before is O
        if hi < first[r + 1]:
            here[-1] += t[:, O]
        out[lo:hi] = viterbi(here, t)
    return out


def _scan(weights: np.ndarray, trans: np.ndarray, with_text: bool = True):
    weights, trans = weights.astype(np.float32), trans.astype(np.float32)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column(1)):
                starts, ends, first, x = _token_features(data, offs)
                e = np.zeros((len(starts), 3), np.float32)
                for k in range(x.shape[1]):
                    e += weights[x[:, k]]
                e[:, O] += CAUTION
                tags = decode(e, trans, first)
                begin = np.flatnonzero((tags == B) | ((tags == I) & (np.concatenate([[O], tags[:-1]]) == O)))
                row = np.searchsorted(first, begin, "right") - 1
                more: dict[int, list] = {}
                for t, r in zip(begin.tolist(), row.tolist()):
                    stop = t + 1
                    while stop < first[r + 1] and tags[stop] == I:
                        stop += 1
                    cp = lambda p: int(np.count_nonzero((data[offs[r]:p] & 0xC0) != 0x80))  # noqa: B023, E731
                    more.setdefault(r, []).append((cp(starts[t]), len(KINDS), cp(ends[stop - 1])))
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                spans = [sorted(base_spans(s or "") + more.get(i, [])) for i, s in enumerate(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo),
                     pa.array([[{"kind": (*KINDS, "crf")[k], "start": s, "end": z} for s, k, z in v] for v in spans], _SPANS),
                     *([batch.column(1).slice(lo, hi - lo)] if with_text else [])],
                    ["doc_id", "spans", "text"][:3 if with_text else 2])
    return run


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text",
                 with_text: bool = True) -> DataFrame:
    """(doc_id, spans, and text unless not asked for): all spans by start, then kind as listed, then end; end exclusive."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return d.mapInArrow(_scan(*model, with_text), out + ", text string" * with_text)


def redact(texts: pa.Array, spans: pa.Array, mark: str) -> pa.Array:
    out = []
    for text, found in zip(texts.to_pylist(), spans.to_pylist()):
        if found:
            parts, at = [], 0
            for s in found:
                if s["end"] > at:
                    if s["start"] >= at:
                        parts += [text[at:s["start"]], mark]
                    at = s["end"]
            text = "".join(parts) + text[at:]
        out.append(text)
    return pa.array(out, pa.string())


def redact_secrets(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mark``; columns and rows stay the same."""
    scan, at = _scan(*model), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            small = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], ["doc_id", "text"])
            for part in scan([small]):
                lo = part.column(0)[0].as_py()
                rows = batch.slice(lo, part.num_rows)
                clean = redact(part.column(2), part.column(1), mark)
                yield pa.RecordBatch.from_arrays([clean if i == at else rows.column(i) for i in range(batch.num_columns)],
                                                 batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts, digest of the pattern spans and list of all spans, per row of find_secrets."""
    show = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", *map(count, KINDS), F.sha2(F.array_join(F.transform(base, show), ",").cast("binary"), 256).alias("base_sha256"),
                        F.array_join(F.transform("spans", show), ",").alias("spans"))


def digest(text: str) -> str:
    """What digest_columns gives as base_sha256, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base_spans(text)).encode()).hexdigest()
