"""Fill-in-middle transformation.

Two drawn numbers cut each text into prefix, middle and suffix at unit boundaries. Units are code points, words
(a run of non-space bytes with the white space after it; white space before the first word belongs to it) or lines
(up to and with the line feed).

A text is divided into blocks of ``BLOCK`` UTF-8 bytes. A Fenwick tree over its blocks holds how many units and how
many code points start in each. The place of a cut comes from a binary-lifting descent: from the highest
power of two down, a step is taken while the units under it stay below the cut. That gives the block, and the code points before it,
in as many steps as the number of blocks has bits; only that one block is then scanned for the boundary.

A text is left ``plain`` if it is empty or null, holds one of the sentinels, or is drawn to be. Otherwise the output
is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle (psm), or ``<S>`` suffix ``<P>`` prefix ``<M>`` middle (spm).
Draws come from the SHA-256 of seed and identifier alone, so they are the same under any partitioning and when a task is
run again. A null identifier draws as an empty one. Every row gives a row, repeated rows too; an empty table gives none. Rows never
move: there is no shuffle, and besides the text and its output a task holds eight bytes a block and one run of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import SPACE, text_bytes

BLOCK = 1 << 10
RUN_BLOCKS = 1 << 10  # blocks counted at once
SENTINELS = ("<P>", "<S>", "<M>")
UNITS = ("char", "word", "line")
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]


def point_starts(b: np.ndarray) -> np.ndarray:
    """Where code points start in UTF-8 bytes."""
    return (b & 0xC0) != 0x80


def unit_starts(b: np.ndarray, before: int, unit: str) -> np.ndarray:
    """Where units start in ``b``, given the byte before it (-1 at the start of the text)."""
    if unit == "char":
        return point_starts(b)
    last = np.empty(len(b), np.int16)
    last[1:], last[:1] = b[:-1], before
    if unit == "line":
        return (last == 10) | (last == -1)
    return ~SPACE[b] & ((last < 0) | SPACE[last])


class BlockTree:
    """Fenwick tree over the blocks of one text: units and code points started in each."""

    def __init__(self, text: np.ndarray, unit: str = "char", block: int = BLOCK):
        self.text, self.unit, self.block = text, unit, block
        n = -(-len(text) // block)
        counts = np.zeros((2, n + 1), np.int64)
        for lo in range(0, n, RUN_BLOCKS):
            at = lo * block
            run = text[at:at + RUN_BLOCKS * block]
            edges = np.arange(0, len(run), block)
            points = point_starts(run)
            starts = points if unit == "char" else self._starts(at, run)
            counts[0, lo + 1:lo + 1 + len(edges)] = np.add.reduceat(starts, edges, dtype=np.int64)
            counts[1, lo + 1:lo + 1 + len(edges)] = np.add.reduceat(points, edges, dtype=np.int64)
        self.units, self.points = counts.sum(1).tolist()
        # Node i covers the blocks (i - lowest bit of i, i].
        before = counts.cumsum(1)
        i = np.arange(n + 1)
        self.tree = before - before[:, i - (i & -i)]
        self.top = 1 << n.bit_length() >> 1

    def _starts(self, at: int, run: np.ndarray) -> np.ndarray:
        return unit_starts(run, int(self.text[at - 1]) if at else -1, self.unit)

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, code points) before the boundary that ends the first ``units`` units."""
        if units <= 0:
            return 0, 0
        if units >= self.units:
            return len(self.text), self.points
        tree_units, tree_points = self.tree
        node, left, points, step = 0, units, 0, self.top
        while step:
            nxt = node + step
            if nxt < len(tree_units) and tree_units[nxt] <= left:
                node, left, points = nxt, left - int(tree_units[nxt]), points + int(tree_points[nxt])
            step >>= 1
        at = node * self.block
        run = self.text[at:at + self.block]
        here = int(np.flatnonzero(self._starts(at, run))[left])  # the unit after the cut starts here
        return at + here, points + int(np.count_nonzero(point_starts(run[:here])))


def _transform(unit: str, block: int, plain_percent: int, spm_percent: int, sentinels: tuple[str, ...]):
    marks = tuple(s.encode() for s in sentinels)
    pre, suf, mid = marks

    def one(raw: np.ndarray, h: tuple[int, ...]) -> tuple:
        text = raw.tobytes()
        tree = BlockTree(raw, unit, block)
        n = tree.units
        if not text or any(m in text for m in marks) or h[2] % 100 >= 100 - plain_percent:
            return n, "plain", None, None, text
        (a, a_points), (b, b_points) = (tree.cut(x) for x in sorted(x % (n + 1) for x in h[:2]))
        form = "spm" if h[3] % 100 < spm_percent else "psm"
        parts = (suf, text[b:], pre, text[:a]) if form == "spm" else (pre, text[:a], suf, text[b:])
        return n, form, a_points, b_points - a_points, b"".join((*parts, mid, text[a:b]))

    def run(batches):
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            draws = list(zip(*(batch.column(c).to_pylist() for c in range(2, 6))))
            rows, size, first = [], 0, 0
            for i, h in enumerate(draws):
                rows.append(one(data[offs[i]:offs[i + 1]], h))
                size += len(rows[-1][-1])
                if size > 4 << 20 or i + 1 == len(draws):
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                    cols[-1] = cols[-1].cast(pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), *cols], ["row", *ADDED])
                    rows, size, first = [], 0, i + 1
    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: str = "1", unit: str = "char", plain_percent: int = 10,
                   spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS, carry: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """``id_col``, the ``carry`` columns, and per text: n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points; null if
    plain) and the ``output`` text. Other columns of ``docs`` are not read, so their names cannot clash; a carried column may not bear the
    name of a new one. A sentinel's first character may occur in none of them a second time: otherwise the end of a part and the start of a
    sentinel could read as another one."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    if len(set(sentinels)) != 3 or any(not s or s[0] != sentinels[0][0] or s.count(s[0]) != 1 for s in sentinels):
        raise ValueError("sentinels must differ, and share a first character that occurs in none of them again")
    if clash := {id_col, *carry} & set(ADDED):
        raise ValueError(f"columns named like new ones: {sorted(clash)}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    kept = list(dict.fromkeys([id_col, *carry]))
    rows = docs.select(F.struct(*kept).alias("row"), F.col(text_col).cast("string").cast("binary").alias("text"), *draw)
    schema = f"row {rows.schema['row'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(_transform(unit, block, plain_percent, spm_percent, tuple(sentinels)), schema).select("row.*", *ADDED)


def restored(output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text rebuilt from a transformed text and its form."""
    out = F.col(output)

    def rebuilt(first: str, second: str, order: tuple[int, int, int]) -> Column:
        two, three = F.instr(out, second), F.instr(out, sentinels[2])  # no part holds a sentinel, so the first ones count
        parts = (F.substring(out, F.lit(1 + len(first)), two - 1 - len(first)), F.substring(out, two + len(second), three - two - len(second)),
                 F.substring(out, three + len(sentinels[2]), F.length(out)))
        return F.concat(*(parts[k] for k in order))

    return (F.when(F.col(form) == "psm", rebuilt(sentinels[0], sentinels[1], (0, 2, 1)))
            .when(F.col(form) == "spm", rebuilt(sentinels[1], sentinels[0], (1, 2, 0))).otherwise(out))
