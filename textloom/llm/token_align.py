"""Cross-tokenizer alignment of a byte-level BPE (side A) and a SentencePiece model (side B).

Both sides encode space + text (B adds the space itself), special tokens' strings as plain text. A token covers the
bytes it stands for, so both sides cover the same byte range. In each batch of texts two ``pandas.merge_asof`` calls, keyed by document,
find the token of the other side that covers each token's start: A starts among B tokens and B starts among A tokens. Their union is every
overlapping pair. Overlaps that end together are links, and their ends cut the document into groups.

Texts that are null or empty, not valid UTF-8, or whose A or B token bytes, joined, differ from space + text have no tokens.

A long text is taken in segments of about ``SEGMENT`` bytes. They end where an ASCII letter, one space and another ASCII letter meet: no token of
either side crosses that place, and the space of the next segment is the one that each side puts before a text, so segments are
encoded as the text is (a piece vocabulary with a space inside a piece is not cut at all).
Memory holds one run of segments; beyond that a document costs four bytes a link.

``align_corpus`` also counts over all documents how often each id pair is linked. Two linked tokens end together, so the bytes of one end
in the bytes of the other: there are at most as many such pairs as the two vocabularies have bytes (``pair_bound``), whatever the corpus.
Tasks count pairs before the shuffle, and the counts (at most that many rows) are sent to every task.

Repeated rows are separate rows; null identifiers stay. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, text_bytes

SEGMENT, RUN_BYTES, COUNTED = 1 << 18, 1 << 20, 1 << 22
_SEAM = re.compile(rb"[A-Za-z] (?=[A-Za-z])")
# Fixed value: the splitting pattern of the public byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary:
    """Bytes of each token id, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.at[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteSide:
    """Byte-level BPE from a tokenizer file. Where ids follow the merges, as in the public file, tiktoken applies
    them (equal ids, a third of the time); else the file's own library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, special = byte_alphabet(), {t["content"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items()}
        tokens = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for b, i in ranks.items():
            tokens[i] = b
        self.vocabulary = Vocabulary(tokens)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pre = spec["pre_tokenizer"]
        plain = pre["type"] == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and spec["normalizer"] is None
        if plain and len(ranks) == len(merges) + 256 and all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges)):
            import tiktoken
            self.encode = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        else:
            from tokenizers import Tokenizer
            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True
            self.encode = lambda text: library.encode(text, add_special_tokens=False).ids


class PieceSide:
    """SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = model.id_to_piece(list(range(n)))
        tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else p.replace("▁", " ").encode()
                  for i, p in enumerate(pieces)]
        self.vocabulary = Vocabulary(tokens)
        self.seams = not any(b" " in t.lstrip(b" ") for t in tokens)  # no piece goes on past a space
        self.encode = lambda text: model.encode(text, num_threads=1)


_sides: dict[tuple[str, str], tuple[ByteSide, PieceSide]] = {}  # one per Python worker


def sides(files: tuple[str, str]) -> tuple[ByteSide, PieceSide]:
    return _sides.get(files) or _sides.setdefault(files, (ByteSide(files[0]), PieceSide(files[1])))


def pair_bound(files: tuple[str, str]) -> int:
    """Most pairs of ids that can ever end together: each is a token and one of its own ends."""
    return int(sum(s.vocabulary.size.sum() for s in sides(files)))


def segments(text: bytes, size: int = SEGMENT) -> Iterator[bytes]:
    """``text`` cut at seams, each segment but the last at least ``size`` bytes long; the space of a seam is left out."""
    at = 0
    while (seam := _SEAM.search(text, at + size)) is not None:
        yield text[at:seam.end() - 1]
        at = seam.end()
    yield text[at:]


class Run(NamedTuple):
    """Aligned tokens of a run of segments. Of the tokens, segment i has those from ``first[i]`` to ``first[i + 1]``; links likewise."""

    ids: tuple[np.ndarray, np.ndarray]  # of both sides
    ends: tuple[np.ndarray, np.ndarray]  # byte offsets within the run
    first: tuple[np.ndarray, np.ndarray]
    overlap: tuple[np.ndarray, np.ndarray]  # overlapping tokens of A and of B, by number
    link: tuple[np.ndarray, np.ndarray]  # those that end together, in order
    first_link: np.ndarray
    good: np.ndarray  # do both sides give back the text?
    start: np.ndarray  # byte offset of each segment


def align_run(parts: list[bytes], a: ByteSide, b: PieceSide) -> Run:
    """Encode segments and align their tokens."""
    texts = [p.decode("utf-8", "replace") for p in parts]
    lists = [[np.asarray(a.encode(" " + t), np.int64) for t in texts], [np.asarray(b.encode(t), np.int64) for t in texts]]
    raw = [b" " + p for p in parts]
    size = np.array([len(r) for r in raw], np.int64)
    good = np.ones(len(parts), bool)
    for side, got in zip((a, b), lists):
        total = [int(side.vocabulary.size[x].sum()) for x in got]
        good &= size == total
    while True:  # a second time if bytes differ at equal lengths
        for got in lists:
            for i in np.flatnonzero(~good):
                got[i] = got[i][:0]
        ids = [np.concatenate(got) for got in lists]
        data = np.frombuffer(b"".join(r for r, g in zip(raw, good) if g), np.uint8)
        start = np.cumsum(size * good) - size * good
        differ = np.zeros(len(data), bool)
        for side, x in zip((a, b), ids):
            differ |= side.vocabulary.joined(x) != data
        if not differ.any():
            break
        good[np.unique(np.searchsorted(start + size * good, np.flatnonzero(differ), "right"))] = False
    count = [np.array([len(x) for x in got], np.int64) for got in lists]
    first = [np.concatenate([[0], np.cumsum(c)]) for c in count]
    ends = [np.cumsum(side.vocabulary.size[x]) for side, x in zip((a, b), ids)]
    frames = []
    for side, x, e, c in zip((a, b), ids, ends, count):
        frames.append(pd.DataFrame({"doc": np.repeat(np.arange(len(parts)), c), "start": e - side.vocabulary.size[x], "token": np.arange(len(x))}))
    cover = [pd.merge_asof(frames[k], frames[1 - k].assign(begin=frames[1 - k]["start"]), on="start", by="doc", suffixes=("", "_other"))
             for k in (0, 1)]
    inside = (cover[1]["begin"] < cover[1]["start"]).to_numpy()  # equal starts are found from A already
    number = lambda t, c: t[c].to_numpy(np.int64)
    over_a = np.concatenate([number(cover[0], "token"), number(cover[1], "token_other")[inside]])
    over_b = np.concatenate([number(cover[0], "token_other"), number(cover[1], "token")[inside]])
    together = ends[0][over_a] == ends[1][over_b]
    link_a, link_b = np.sort(over_a[together]), np.sort(over_b[together])  # each token ends one link at most
    return Run(tuple(ids), tuple(ends), tuple(first), (over_a, over_b), (link_a, link_b), np.searchsorted(link_a, first[0]), good, start)


def _runs(col: pa.Array, a: ByteSide, b: PieceSide) -> Iterator[tuple[list[int], list[int], Run]]:
    """(each segment's row and byte offset in space + text, aligned segments), at most about ``RUN_BYTES`` of text at once."""
    data, offs = text_bytes(col)
    parts, rows, bases, size = [], [], [], 0
    for i, (lo, hi) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        if lo == hi:
            continue
        text, base = data[lo:hi].tobytes(), 0
        for part in segments(text) if b.seams else (text,):
            parts.append(part)
            rows.append(i)
            bases.append(base)
            base += 1 + len(part)
            size += len(part)
            if size > RUN_BYTES:
                yield rows, bases, align_run(parts, a, b)
                parts, rows, bases, size = [], [], [], 0
    if parts:
        yield rows, bases, align_run(parts, a, b)


class _Groups:
    """Decimal ids with the sign that follows them, for the text of groups."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        text = [np.array([f"{i}{sign}" for i in range(len(v.tokens))], object) for v, sign in ((a, ","), (a, "|"), (b, ","), (b, ";"))]
        self.first = np.cumsum([0, *(len(t) for t in text[:-1])])
        self.text = np.concatenate(text)

    def of(self, run: Run) -> tuple[np.ndarray, np.ndarray]:
        """The texts of all tokens of a run, A before B in each group, and where each segment's begin."""
        n_a, n_b = len(run.ids[0]), len(run.ids[1])
        last = [np.zeros(n, np.int64) for n in (n_a, n_b)]
        for flag, link in zip(last, run.link):
            flag[link] = 1
        group = [np.cumsum(flag) - flag for flag in last]
        codes = np.empty(n_a + n_b, np.int64)
        ends = [np.append(0, link + 1) for link in run.link]  # tokens up to the end of each group
        codes[np.arange(n_a) + ends[1][group[0]]] = run.ids[0] + self.first[0:2][last[0]]
        codes[np.arange(n_b) + ends[0][group[1] + 1]] = run.ids[1] + self.first[2:4][last[1]]
        return self.text[codes], run.first[0] + run.first[1]


class _Document:
    """What is known of one row while its segments come."""

    def __init__(self):
        self.good, self.n, self.links, self.sha, self.kept = True, [0, 0], [], hashlib.sha256(), ""

    def add(self, n_a: int, n_b: int, links: np.ndarray, text: str):
        self.n[0] += n_a
        self.n[1] += n_b
        self.links.append(links)
        self.sha.update((self.kept + text[:-1]).encode())
        self.kept = text[-1:]  # the sign after the last group is left out


class _PairCounts:
    """How often each pair was seen; sorted arrays, at most ``pair_bound`` entries beside the newest ones."""

    def __init__(self):
        self.new, self.size = [], 0
        self.pairs, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, pairs: np.ndarray):
        self.new.append(pairs)
        self.size += len(pairs)
        if self.size > COUNTED:
            self.merge()

    def merge(self):
        if self.new:
            pairs, counts = np.unique(np.concatenate(self.new), return_counts=True)
            self.pairs, back = np.unique(np.concatenate([self.pairs, pairs.astype(np.int64)]), return_inverse=True)
            counts = np.concatenate([self.counts, counts])
            self.counts = np.zeros(len(self.pairs), np.int64)
            np.add.at(self.counts, back, counts)
        self.new, self.size = [], 0


_FIRST = "doc_id {0}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, pair long, times long"


def _align(files: tuple[str, str]) -> Callable:
    """Rows of documents (``pair`` null; ``links``: pairs as little-endian uint32), and at the end the task's counts (``pair`` set)."""
    def run(batches):
        a, b = sides(files)
        width, text, seen = len(b.vocabulary.tokens), _Groups(a.vocabulary, b.vocabulary), _PairCounts()
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            docs: dict[int, _Document] = {}
            for rows, _, got in _runs(batch.column(1), a, b):
                pairs = (got.ids[0][got.link[0]] * width + got.ids[1][got.link[1]]).astype("<u4")
                words, first = text.of(got)
                for k, row in enumerate(rows):
                    doc = docs.get(row) or docs.setdefault(row, _Document())
                    doc.good &= bool(got.good[k])
                    if doc.good:
                        n_a, n_b = (int(f[k + 1] - f[k]) for f in got.first)
                        doc.add(n_a, n_b, pairs[got.first_link[k]:got.first_link[k + 1]], "".join(words[first[k]:first[k + 1]].tolist()))
            out = []
            for row in range(batch.num_rows):
                doc = docs.get(row)
                if doc is None or not doc.good:
                    out.append((0, 0, 0, "", b""))
                else:
                    links = np.concatenate(doc.links)
                    seen.add(links)
                    out.append((*doc.n, len(links), doc.sha.hexdigest(), links.tobytes()))
            if out:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                cols = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                none = pa.nulls(len(out), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols, none, none], _names)
        seen.merge()
        if len(seen.pairs):
            n = len(seen.pairs)
            empty = [pa.nulls(n, t) for t in (id_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(seen.pairs), pa.array(seen.counts)], _names)
    return run


_names = [c.split(" ")[0] for c in _FIRST.split(", ")]


def _score(shared, width: int):
    """The sums over each document's links, from the counts of all pairs."""
    def run(batches):
        pairs, times = shared.value
        best = np.zeros(width, np.int64)
        np.maximum.at(best, pairs % width, times)
        is_best = times == best[pairs % width]
        for batch in batches:
            data, offs = text_bytes(batch.column("links"))
            at = np.searchsorted(pairs, data.view("<u4"))
            first = offs // 4
            sums = [np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)]) for x in (is_best, times)]
            n_best, total = (s[first[1:]] - s[first[:-1]] for s in sums)
            keep = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(np.diff(first)), pa.array(n_best), pa.array(total), batch.column("groups_sha256")],
                                             ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
    return run


def pair_counts(first: DataFrame) -> DataFrame:
    """(pair, times) over all documents, from the tasks' counts."""
    return first.where("pair is not null").groupBy("pair").agg(F.sum("times").alias("times"))


def align_corpus(docs: DataFrame, files: tuple[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its B id), count_sum (over links, how
    often the pair is linked in all documents) and groups_sha256 (of the groups as text, ids in decimal; empty without tokens).
    ``files``: the byte-level tokenizer's and the piece model's, on every machine."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    width = len(sides(files)[1].vocabulary.tokens)
    if width * len(sides(files)[0].vocabulary.tokens) > 1 << 32:
        raise ValueError("the vocabularies are too large for pairs of 32 bits")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = cut(base.mapInArrow(_align(files), _FIRST.format(kind)), "align")
    counts = pair_counts(first).toArrow()  # at most pair_bound(files) rows
    pairs, times = (counts.column(c).to_numpy() for c in ("pair", "times"))
    order = np.argsort(pairs)
    shared = spark.sparkContext.broadcast((pairs[order], times[order]))
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return first.where("pair is null").select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links").mapInArrow(_score(shared, width), schema)


_OVERLAPS = "doc_id {0}, a_id int, a_start long, a_end long, b_id int, b_start long, b_end long"


def _overlaps(files: tuple[str, str]) -> Callable:
    names = [c.split(" ")[0] for c in _OVERLAPS.split(", ")]

    def run(batches):
        a, b = sides(files)
        for batch in batches:
            for rows, bases, got in _runs(batch.column(1), a, b):
                order = np.lexsort((got.overlap[1], got.overlap[0]))
                x, y = (o[order] for o in got.overlap)
                k = np.searchsorted(got.first[0], x, "right") - 1  # the segment of each
                move = np.array(bases, np.int64)[k] - got.start[k]
                cols = []
                for side, ids, ends, t in zip((a, b), got.ids, got.ends, (x, y)):
                    end = ends[t] + move
                    cols += [pa.array(ids[t].astype(np.int32)), pa.array(end - side.vocabulary.size[ids[t]]), pa.array(end)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(rows, np.int64)[k])), *cols], names)
    return run


def overlaps(docs: DataFrame, files: tuple[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a_id, a_start, a_end, b_id, b_start, b_end): every pair of tokens that overlap, with their byte ranges in space + text. Pairs with
    equal ends are the links. Of a long text, a segment that one side does not give back has no rows."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(_overlaps(files), _OVERLAPS.format(docs.schema[id_col].dataType.simpleString()))
