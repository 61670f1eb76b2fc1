"""Best-fit packing of token sequences by minimum bin slack.

Documents are tokenised in tasks; words repeat, so each task keeps the ids of the
chunks and words it has seen (bounded tables) and asks the tokenizer only for new ones. That gives the
tokenizer's own ids because its pattern never crosses a space or line end. New words of letters
are merged by tiktoken, with the ranks that the tokenizer file states.

Only lengths matter for packing, and there are at most ``capacity`` different ones. The plan
is made from their histogram, which is the one thing the driver gets: the longest available
length opens a bin, a bitset subset-sum over the other available lengths finds the
fullest combination that fits beside it, and that combination is taken as many times as
the counts allow. A plan has at most one pattern per length, however many documents there are. Pieces then find their
place from their rank among pieces of their length, which is counted in salted groups.

Null texts are empty: one piece, the end id alone. Repeated rows are packed each.
Null identifiers are kept. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, partitions
from textloom.llm.token_align import byte_alphabet

CAPACITY, END_ID = 4096, 1
_CHUNKS, _WORDS, _KEEP_CHARS = 300_000, 600_000, 64
_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def letter_merges(path: str) -> Callable[[str], list[int]] | None:
    """Ids of a word of Latin-1 letters in lower case, by tiktoken with the merges of a tokenizer file with word ends; None
    where ids do not follow the merges as in the public file.

    tiktoken knows no word ends. A zero byte, which no such word holds, stands for one: joining a word's last byte
    with it has a lower rank than any merge, so it comes first, as if the word had begun with its last symbol marked.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, alphabet = spec["model"], byte_alphabet()
    vocab, end = model["vocab"], model.get("end_of_word_suffix")
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    plain = model["type"] == "BPE" and end and not model.get("continuing_subword_prefix") and not model.get("ignore_merges")
    if not plain or any(vocab.get(a + b) != 512 + k for k, (a, b) in enumerate(merges)):
        return None
    if any(vocab.get(c, 512) >= 256 or not 256 <= vocab.get(c + end, 0) < 512 for c in alphabet):
        return None
    import tiktoken
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in t.removesuffix(end)) + b"\0" * t.endswith(end): i for t, i in vocab.items() if t not in special}
    encode = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda word: encode(word + "\0")


class Chunks(dict):
    """Token ids (little-endian uint32 bytes) of chunks without white space; tables of chunks and words are bounded.

    A chunk of Latin-1 letters and then ASCII signs has the ids of its letters in lower case and of
    its signs: the tokenizer lower-cases, and never lets a token cross from letters to signs.
    """

    def __init__(self, path: str):
        super().__init__({"": b""})
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are Spark's to deal out
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.letters = letter_merges(path) or self.library

    def library(self, x: str) -> list[int]:
        return self.tok.encode(x, add_special_tokens=False).ids

    def word(self, x: str, encode: Callable) -> bytes:
        if (ids := self.words.get(x)) is None:
            ids = array("I", encode(x)).tobytes()
            if len(x) <= _KEEP_CHARS:
                if len(self.words) >= _WORDS:
                    self.words.clear()
                self.words[x] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        core = chunk.rstrip(_SIGNS)
        if core.isalpha() and max(core) < "\u0100":
            ids = self.word(core.lower(), self.letters)
            if len(core) < len(chunk):
                ids += self.word(chunk[len(core):], self.library)
        else:
            ids = self.word(chunk, self.library)
        if len(chunk) <= _KEEP_CHARS:
            if len(self) >= _CHUNKS:
                self.clear()
                self[""] = b""
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_encoders: dict[str, Chunks] = {}  # one per Python worker, which Spark reuses for many tasks


def _pieces(path: str, capacity: int, keep_ids: bool):
    def run(batches):
        encoder = _encoders.get(path) or _encoders.setdefault(path, Chunks(path))
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, crc32(part), part if keep_ids else None))
                    size += len(part)
                if size > 4 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)
    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])


def tokenize_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                    keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): each document's ids and the end id, cut at ``capacity``.
    ``ids`` holds little-endian uint32 values, or null unless ``keep_ids``."""
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string"))
            .mapInArrow(_pieces(tokenizer, capacity, keep_ids),
                        "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"))


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> Iterator[tuple[dict[int, int], int]]:
    """(pattern, times): lengths in a bin and the number of bins filled so, until all counts are used."""
    left = {n: c for n, c in counts.items() if c}
    mask = (1 << capacity + 1) - 1
    while left:
        lengths = sorted(left, reverse=True)
        room = capacity - lengths[0]
        # reach[k] has bit s set when some of the first k offered lengths sum to s.
        reach, offered = [1], []
        for n in lengths:
            if n > room:
                continue
            for _ in range(min(left[n] - (n == lengths[0]), room // n)):
                bits = reach[-1] | (reach[-1] << n) & mask
                if bits == reach[-1]:
                    break
                reach.append(bits)
                offered.append(n)
                if bits >> room & 1:
                    break
            if reach[-1] >> room & 1:
                break
        best = (reach[-1] & ((1 << room + 1) - 1)).bit_length() - 1
        pattern = {lengths[0]: 1}
        for k in range(len(offered), 0, -1):
            if not reach[k - 1] >> best & 1:
                pattern[offered[k - 1]] = pattern.get(offered[k - 1], 0) + 1
                best -= offered[k - 1]
        times = min(left[n] // m for n, m in pattern.items())
        yield pattern, times
        for n, m in pattern.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, groups: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces that have columns (doc_id, piece, length)."""
    spark = pieces.sparkSession
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups or 4 * partitions(spark))))
    per_salt = cut(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used = dict.fromkeys(counts, 0)
    sequence = 0
    for pattern, times in minimum_bin_slack(counts, capacity):
        at = 0
        for n, m in pattern.items():
            slots.setdefault(n, []).append((used[n], m, sequence, at))
            used[n] += m * times
            at += m * n
        sequence += times
    plan = {n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in slots.items()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    ranked = (salted.join(per_salt.select("length", "salt", before.alias("before")), ["length", "salt"])
              .withColumn("rank", F.col("before") + F.row_number().over(
                  Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1).drop("before", "salt"))
    schema = ranked.drop("rank").schema

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            out = np.zeros((2, batch.num_rows), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                first, many, base, at = plan[int(n)]
                p = np.searchsorted(first, rank[rows], "right") - 1
                nth = rank[rows] - first[p]
                out[0, rows], out[1, rows] = base[p] + nth // many[p], at[p] + nth % many[p] * n
            columns = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, out)],
                                             [c for c in batch.schema.names if c != "rank"] + ["sequence_id", "offset"])

    return ranked.mapInArrow(place, schema.add("sequence_id", "long").add("offset", "long"))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: (doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset)."""
    pieces = cut(tokenize_pieces(docs, tokenizer, id_col, text_col, capacity, keep_ids), "pieces")
    return place_pieces(pieces, capacity)
