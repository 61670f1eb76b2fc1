"""SentencePiece encoding and decoding by shared-prefix Viterbi.

The model file's normaliser must be the identity with a dummy prefix (a text is marked with one
leading space sign, and every space becomes one), as in the public BPE model. No piece
may cross from a word into the next space sign, so marked words are encoded on their own.

A task collects the distinct marked words of a batch, sorts them, and walks them as the
depth-first order of their trie: the forward scores of a prefix are kept on a stack and reused by all words
that share it. The forward step at a position is Viterbi over the pieces that end there. For a BPE model the lattice
is restricted to transitions the merges allow: a piece may follow another only if merging both their texts gives back
exactly these two, which is seen by undoing their merges from the last one back. With that restriction one path is left, the one that the merges build, so the result equals the
library's own ids (a prefix of a merge result is the merge result of its text, and merges inside two neighbouring
pieces do not depend on what lies beyond them).

Characters without a piece become byte pieces. Null texts are empty; empty texts have no ids. Repeated rows are encoded
each, other columns pass through. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

SPACE_SIGN = "▁"
_MAX_WORDS, _MAX_PAIRS = 250_000, 300_000
_BATCH_CHARS = 1 << 20


class SharedPrefixEncoder:
    """Ids of marked words under a BPE model of the sentencepiece library."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (
                spec.add_dummy_prefix and spec.escape_whitespaces and model.trainer_spec.byte_fallback):
            raise ValueError("a BPE model with byte fallback, identity normaliser and dummy prefix is needed")
        self.ids, self.score, self.bytes = {}, {}, [0] * 256
        self.text: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == 1:
                self.ids[p.piece], self.score[p.piece] = i, p.score
                self.text.append(p.piece.replace(SPACE_SIGN, " ").encode())
            elif p.type == 6:
                self.bytes[int(p.piece[1:-1], 16)] = i
                self.text.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                self.text.append(b" \xe2\x81\x87 " if p.type == 2 else b"")
        self.packed = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        long = [p for p in self.ids if len(p) > 1]
        if any(SPACE_SIGN in p.lstrip(SPACE_SIGN) for p in long):
            raise ValueError("a piece crosses a word boundary")
        # Single characters that occur in no longer piece also end a word.
        stop = "" if any("\n" in p for p in long) else "\n"
        self.words = re.compile(f"{SPACE_SIGN}+[^{SPACE_SIGN}{stop}]*|[^{SPACE_SIGN}{stop}]+" + (f"|{stop}" if stop else ""))
        # Lengths, longest first, of the pieces that end with three given characters (or are the last two): the reverse trie's first steps.
        sizes = defaultdict(set)
        for p in long:
            sizes[p[-3:]].add(len(p))
        for end, n in sizes.items():
            n.update({2} if end[-2:] in self.ids else ())
        self.sizes = {end: sorted(n, reverse=True) for end, n in sizes.items()}
        self.fits: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}
        # Words seen lately, and those of the time before.
        self.seen: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def merges(self, text: str) -> list[str]:
        """Pieces of ``text`` by repeated best merge (leftmost of equals): the definition."""
        parts = list(text)
        while True:
            best = max(((self.score[x + y], -i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            if len(parts) == 2:
                self.halves[text] = (parts[0], parts[1])
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the last merge of ``piece`` joins; None where its merges do not build it."""
        if piece not in self.halves:
            self.halves[piece] = None
            self.merges(piece)
        return self.halves[piece]

    def allowed(self, left: str, piece: str) -> bool:
        """May ``piece`` follow ``left`` (empty at a word's start)? Both are undone from their last merges back. Whenever
        a merge across their border would have come before the merge undone last, it would have joined them."""
        if len(piece) > 1 and not self.split(piece):
            return False
        if not left:
            return True
        score = self.score
        came_after, ties = float("-inf"), False  # score of the merge undone last; does one across win a tie with it?
        while True:
            across = score.get(left + piece)
            if across is not None and (across > came_after or ties and across == came_after):
                return False
            if len(left) > 1 and (len(piece) == 1 or score[left] < score[piece]):
                came_after, ties = score[left], False
                left = self.split(left)[1]
            elif len(piece) > 1:
                came_after, ties = score[piece], True
                piece = self.split(piece)[0]
            else:
                return True

    def follows(self, left: str, piece: str) -> bool:
        """``allowed``, from a bounded table."""
        key = (left, piece)
        if (ok := self.fits.get(key)) is None:
            if len(self.fits) > _MAX_PAIRS:
                self.fits.clear()
            ok = self.fits[key] = self.allowed(left, piece)
        return ok

    def learn(self, words: list[str]) -> None:
        """Encode sorted distinct words, reusing the forward scores of shared prefixes."""
        forward, tail = [0.0], [""]  # best score of each prefix, and its last piece
        last = ""
        score, sizes, fits, ids = self.score, self.sizes, self.fits, self.piece_ids
        for word in words:
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del forward[shared + 1:], tail[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                for size in sizes.get(word[max(end - 3, 0):end]) or sizes.get(word[max(end - 2, 0):end], ()):
                    if size <= end and (piece := word[end - size:end]) in score:
                        left = tail[end - size]
                        if (ok := fits.get((left, piece))) or ok is None and self.follows(left, piece):
                            break  # the merges leave one path; no other piece can end here
                else:
                    piece, size = word[end - 1], 1
                forward.append(forward[end - size] + score.get(piece, 0.0))
                tail.append(piece)
            end, path = len(word), []
            while end:
                path.append(ids(piece := tail[end]))
                end -= len(piece)
            self.seen[word] = b"".join(reversed(path))
            last = word

    def piece_ids(self, piece: str) -> bytes:
        if (one := self.packed.get(piece)) is None:
            one = b"".join(self.bytes[b].to_bytes(4, "little") for b in piece.encode("utf-8", "replace"))
        return one

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian int32 ids of each text."""
        split = [self.words.findall(SPACE_SIGN + t.replace(" ", SPACE_SIGN)) if t else [] for t in texts]
        if len(self.seen) > _MAX_WORDS:
            self.seen, self.before = {}, self.seen
        new = {w for words in split for w in words if w not in self.seen}
        for w in new & self.before.keys():
            self.seen[w] = self.before[w]
        self.learn(sorted(new - self.before.keys()))
        return [b"".join(map(self.seen.__getitem__, words)) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.text.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


_encoders: dict[str, SharedPrefixEncoder] = {}  # one per Python worker, which Spark reuses for many tasks


def _encoder(path: str) -> SharedPrefixEncoder:
    return _encoders.get(path) or _encoders.setdefault(path, SharedPrefixEncoder(path))


def _groups(col: pa.Array, size) -> list[tuple[int, int]]:
    out, lo, have = [], 0, 0
    for i, n in enumerate(size):
        have += n or 0
        if have > _BATCH_CHARS:
            out.append((lo, i + 1))
            lo, have = i + 1, 0
    return out + ([(lo, len(col))] if lo < len(col) else [])


def encode(df: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col`` (array<int>) in place of ``text_col``."""
    at = df.columns.index(text_col)
    schema = StructType([f for f in df.schema if f.name != text_col]).add(ids_col, ArrayType(IntegerType()))

    def run(batches):
        encoder = _encoder(model)
        for batch in batches:
            col = batch.column(at)
            for lo, hi in _groups(col, (len(t) if t is not None else 0 for t in col.to_pylist())):
                rows = batch.slice(lo, hi - lo)
                got = encoder.encode([t or "" for t in rows.column(at).to_pylist()])
                offs = np.cumsum([0, *(len(g) // 4 for g in got)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(got), "<i4")))
                yield pa.RecordBatch.from_arrays([rows.column(i) for i in range(rows.num_columns) if i != at] + [ids], schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``df`` with ``text_col`` decoded from ``ids_col`` added."""
    at = df.columns.index(ids_col)
    schema = StructType(list(df.schema)).add(text_col, StringType())

    def run(batches):
        encoder = _encoder(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = batch.slice(lo, 500)
                lists = rows.column(at).fill_null([])
                ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                texts = pa.array([encoder.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns, texts], schema.names)

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, n_ids, ids_crc32, decoded_sha256, exact): encoded, decoded again, compared by digest.
    A text that holds the space sign itself comes back with spaces there, as with the library."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    plain = F.translate(F.coalesce(F.col(text_col), F.lit("")), SPACE_SIGN, " ")
    rows = df.select(F.col(id_col).alias("doc_id"), sha(plain).alias("text_sha256"), F.col(text_col).cast("string").alias("text"))
    ids = encode(rows, model)
    back = decode(ids, model)
    joined = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return back.select("doc_id", "text_sha256", F.size("ids").cast("long").alias("n_ids"), F.crc32(joined.cast("binary")).alias("ids_crc32"),
                       sha(F.col("text")).alias("decoded_sha256"), (sha(F.col("text")) == F.col("text_sha256")).alias("exact"))
