"""Streamed answers that stay closed (T5) and bounded re-framing of byte chunks (T1), with ``transformWithStateInPandas``.

State of a response is split into variables: a small ``head`` (what has arrived, as ranges of numbers; the time of the last arrival) and an
append-only list of pieces, which is read once, when the response closes. One event-time timer a response closes it when nothing has come for
``idle``, and later forgets it. A closed response keeps its head for ``remember``: whatever still comes for it is
reported once as late and never starts a second answer. (State TTL in Spark counts processing time, which a replay does not reproduce; the timer counts event time.)

Each column of a pandas frame and each row of state costs more than the work itself: rows of one response and clock that come together travel as one
pickled value (``packed``), pieces are kept as one value for each time they come, and what is given out is one value a call (``unpacked``).

Event time here is the time of *arrival* (``clock``): Spark drops rows behind the watermark before a processor sees them, so a watermark
on the lines' own time would lose the very rows that the late table is for.
"""

from __future__ import annotations

import os
import pickle
import sys
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from textloom.session import ensure_checkpoint_dir
from textloom.streaming.assemble import parse_stream
from textloom.streaming.packed import VALUE, packed, unpacked

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE_MS, REMEMBER_MS = 60_000, 24 * 3_600_000
MAX_PENDING = 4 << 20
# Before a stream starts, Spark loads its processor in a Python process beside the driver that gets no shipped files and may not find this
# package: the processors travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


_STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
               "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true"}


def state_conf(spark: SparkSession) -> None:
    """Several state variables a key need the RocksDB store; all stores of an executor share one bound on native memory."""
    for key, value in _STATE_CONF.items():
        spark.conf.set(key, value)


# --- ranges of numbers: [lo, hi, lo, hi, ...], ascending, apart ---------------

def holds(ranges: list[int], n: int) -> bool:
    i = bisect_right(ranges, n)
    return i % 2 == 1 or i > 0 and ranges[i - 1] == n


def with_number(ranges: list[int], n: int) -> list[int]:
    """``ranges`` (changed in place) and ``n``, neighbours joined: as long as there are gaps, whatever the number of numbers."""
    i = bisect_right(ranges, n)
    if i % 2 or i and ranges[i - 1] == n:
        return ranges
    left, right = i > 0 and ranges[i - 1] == n - 1, i < len(ranges) and ranges[i] == n + 1
    if left and right:
        del ranges[i - 1:i + 1]
    elif left:
        ranges[i - 1] = n
    elif right:
        ranges[i] = n
    else:
        ranges[i:i] = [n, n]
    return ranges


class _Closing(StatefulProcessor):
    """What both jobs share: the head, its timer, and the memory of closed responses."""

    HEAD = "ranges array<long>, last_ms long, timer_ms long, closed boolean, n1 long, n2 long, n3 long"
    names = [c.split(" ")[0] for c in HEAD.split(", ")]

    def __init__(self, idle_ms: int = IDLE_MS, remember_ms: int = REMEMBER_MS):
        self.idle_ms, self.remember_ms = idle_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", self.HEAD)
        self.pieces = handle.getListState("pieces", VALUE)

    def load(self) -> dict:
        got = self.head.get()
        h = dict(zip(self.names, got)) if got is not None else dict.fromkeys(self.names)
        h["ranges"] = [int(x) for x in h["ranges"] or []]
        return h

    def save(self, h: dict) -> None:
        wanted = h["last_ms"] + (self.remember_ms if h["closed"] else self.idle_ms)
        if h["timer_ms"] is None or h["closed"] and h["timer_ms"] < wanted:
            # Of an open response the timer is moved only when it fires: one a response, not one a batch.
            if h["timer_ms"] is not None:
                self.handle.deleteTimer(h["timer_ms"])
            h["timer_ms"] = wanted
            self.handle.registerTimer(wanted)
        self.head.update(tuple(h.values()))

    def close_state(self, h: dict) -> None:
        h["closed"] = True
        if h["n3"]:  # nothing was kept otherwise
            self.pieces.clear()

    def overdue(self, h: dict, now_ms: int) -> bool:
        return h["last_ms"] is not None and not h["closed"] and h["last_ms"] + self.idle_ms <= now_ms

    @staticmethod
    def arrived(pdf: pd.DataFrame) -> Iterator[tuple]:
        """The values of each row in packed rows, and its clock in milliseconds."""
        for value in pdf["rows"].tolist():
            ms, *columns = pickle.loads(value)
            for row in zip(*columns):
                yield *row, ms

    def kept(self, h: dict) -> Iterator[tuple]:
        for value, in self.pieces.get() if h["n3"] else ():
            yield from pickle.loads(value)

    @staticmethod
    def given(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"rows": [pickle.dumps(out, 5)]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        h, out = self.load(), []
        if self.overdue(h, timerValues.getCurrentWatermarkInMs()):
            out += self.expire(key, h)  # its timer would fire in this batch, after these rows
        for pdf in rows:
            out += self.take(key, h, self.arrived(pdf))
        self.save(h)
        if out:
            yield self.given(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        h = self.load()
        if h["last_ms"] is None or expiredTimerInfo.getExpiryTimeInMs() != h["timer_ms"]:
            return
        h["timer_ms"] = None
        now = timerValues.getCurrentWatermarkInMs()
        if h["closed"]:
            if h["last_ms"] + self.remember_ms <= now:
                self.head.clear()
                return
        elif self.overdue(h, now):
            out = self.expire(key, h)
            self.save(h)
            if out:
                yield self.given(out)
            return
        self.save(h)


def _text(x) -> str | None:
    return x if isinstance(x, str) else None


class _Answers(_Closing):
    """Head: n1 the number of the end line, n3 how many lines wait in the pieces."""

    COLUMNS = ["seq", "delta", "is_end"]
    OUTPUT = "kind string, conv_id long, turn long, seq long, delta string, text string, complete boolean"

    def answer(self, key, h: dict, new: list[tuple], complete: bool) -> list[tuple]:
        before = list(self.kept(h))
        self.close_state(h)
        lines = sorted([*before, *new], key=lambda x: x[0])
        end = h["n1"] if complete else None
        text = "".join(d for s, d in lines if d is not None and (end is None or s < end))
        late = [("late", *key, s, d, None, None) for s, d in lines if end is not None and s > end]
        return [("answer", *key, None, None, text, complete), *late]

    def take(self, key, h: dict, rows: Iterator[tuple]) -> list[tuple]:
        out, new = [], []
        for seq, delta, is_end, ms in rows:
            h["last_ms"] = max(ms, h["last_ms"] or ms)
            seq = int(seq)
            if holds(h["ranges"], seq):
                continue  # a line that comes again changes nothing
            h["ranges"] = with_number(h["ranges"], seq)
            if h["closed"]:
                out.append(("late", *key, seq, _text(delta), None, None))
                continue
            if is_end and (h["n1"] is None or seq < h["n1"]):
                h["n1"] = seq
            new.append((seq, None if is_end else _text(delta)))
            if h["n1"] is not None and h["ranges"][0] <= 0 and h["ranges"][1] >= h["n1"]:
                out += self.answer(key, h, new, True)
                new = []
        if new:
            self.pieces.appendValue((pickle.dumps(new, 5),))
            h["n3"] = (h["n3"] or 0) + len(new)
        return out

    def expire(self, key, h: dict) -> list[tuple]:
        return self.answer(key, h, [], False)


def assemble_with_late(lines: DataFrame, watermark: str = "10 minutes", clock: str = "arrived", idle_ms: int = IDLE_MS,
                       remember_ms: int = REMEMBER_MS) -> DataFrame:
    """T5: streaming wire lines (conv_id, turn, provider, seq, line, is_tail and the arrival time ``clock``) to tagged rows.

    ``answer`` rows (text, complete): once a response, when its end and every line before it have come, or, with complete = false,
    when none has come for ``idle_ms``. ``late`` rows (seq, delta): lines that come after that, once each; lines after the end are
    late too. A line that was part of the answer and comes again is neither. After ``remember_ms`` without a line a response is forgotten."""
    state_conf(lines.sparkSession)
    parsed = parse_stream(lines).withColumn("clock", F.col(clock)).withColumn("seq", F.col("seq").cast("long"))
    values = (packed(parsed, ["conv_id", "turn"], _Answers.COLUMNS).withWatermark("clock", watermark).groupBy("conv_id", "turn")
              .transformWithStateInPandas(_Answers(idle_ms, remember_ms), VALUE, "append", "EventTime"))
    return unpacked(values, _Answers.OUTPUT)


def answers(tagged: DataFrame) -> DataFrame:
    return tagged.where("kind = 'answer'").select("conv_id", "turn", "text", "complete")


def late_lines(tagged: DataFrame) -> DataFrame:
    return tagged.where("kind = 'late'").select("conv_id", "turn", "seq", "delta")


def _weight(pieces: dict[int, bytes]) -> int:
    """Bytes of waiting pieces, and one for each."""
    return len(pieces) + sum(map(len, pieces.values()))


class _Lines(_Closing):
    """Head: n1 the last chunk's number, n2 the next line's number, n3 the weight of what waits. Pieces: chunks that wait for earlier ones,
    and under number -1 the start of the next line."""

    COLUMNS = ["chunk_no", "bytes", "is_last"]
    OUTPUT = "kind string, conv_id long, turn long, provider string, seq long, line string, is_tail boolean"

    def __init__(self, idle_ms: int = IDLE_MS, remember_ms: int = REMEMBER_MS, max_pending: int = MAX_PENDING):
        super().__init__(idle_ms, remember_ms)
        self.max_pending = max_pending

    def ready(self, h: dict) -> int:
        """Number of chunks from the first on without a gap."""
        return h["ranges"][1] + 1 if h["ranges"] and h["ranges"][0] <= 0 else 0

    def take(self, key, h: dict, rows: Iterator[tuple]) -> list[tuple]:
        out, new = [], {}
        was_ready = self.ready(h)
        for no, data, last, ms in rows:
            h["last_ms"] = max(ms, h["last_ms"] or ms)
            no = int(no)
            if holds(h["ranges"], no):
                continue
            h["ranges"] = with_number(h["ranges"], no)
            if h["closed"]:
                out.append(("late", *key, no, None, None))
                continue
            new[no] = bytes(data)
            if last:
                h["n1"] = no
        if h["closed"] or not new:
            return out
        ready = self.ready(h)
        if ready == was_ready and (h["n3"] or 0) + _weight(new) <= self.max_pending:
            self.pieces.appendValue((pickle.dumps(list(new.items()), 5),))  # a gap is still open: nothing is read back
            h["n3"] = (h["n3"] or 0) + _weight(new)
            return out
        had, waiting = h["n3"], dict(self.kept(h))
        waiting.update(new)
        joined = waiting.pop(-1, b"") + b"".join(waiting.pop(n) for n in range(was_ready, ready))
        *lines, rest = joined.split(b"\n")  # a line feed byte is never part of another character
        at = h["n2"] or 0
        out += [("line", *key, at + k, x.decode("utf-8", "replace"), False) for k, x in enumerate(lines)]
        h["n2"] = at + len(lines)
        if h["n1"] is not None and ready > h["n1"]:
            out.append(("line", *key, h["n2"], rest.decode("utf-8", "replace"), True))
            out += [("late", *key, n, None, None) for n in sorted(waiting)]  # numbered after the last one
            self.close_state(h)
            return out
        if rest:
            waiting[-1] = rest
        h["n3"] = _weight(waiting)
        if h["n3"] > self.max_pending:
            return out + self.give_up(key, h, rest, "too_large")
        if waiting:
            self.pieces.put([(pickle.dumps(list(waiting.items()), 5),)])
        elif had:
            self.pieces.clear()
        return out

    def give_up(self, key, h: dict, rest: bytes, why: str) -> list[tuple]:
        """The unfinished line as the tail, and the reject row: its number is that of the first chunk that never came."""
        self.close_state(h)
        return [("line", *key, h["n2"] or 0, rest.decode("utf-8", "replace"), True), (why, *key, self.ready(h), None, None)]

    def expire(self, key, h: dict) -> list[tuple]:
        rest = dict(self.kept(h)).get(-1, b"")
        return self.give_up(key, h, rest, "unfinished")


def reframe_bounded(chunks: DataFrame, watermark: str = "10 minutes", clock: str = "arrived", idle_ms: int = IDLE_MS, remember_ms: int = REMEMBER_MS,
                    max_pending: int = MAX_PENDING) -> DataFrame:
    """Streaming byte chunks (conv_id, turn, provider, chunk_no, bytes, is_last and the arrival time ``clock``) to tagged rows.

    ``line`` rows (seq, line, is_tail): complete lines as soon as their bytes are there, and once a response its unterminated rest, the tail.
    A response leaves state when its last chunk and all before it have come; when none has come for ``idle_ms`` (reject row ``unfinished``);
    or when more than ``max_pending`` bytes wait, in an open line or behind a gap (``too_large``). The tail is given in each case. ``late`` rows: the
    numbers of chunks that come after that, once each. Reject rows carry the number of the first missing chunk as ``seq``."""
    state_conf(chunks.sparkSession)
    timed = chunks.withColumn("clock", F.col(clock)).withColumn("chunk_no", F.col("chunk_no").cast("long"))
    values = (packed(timed, ["conv_id", "turn", "provider"], _Lines.COLUMNS).withWatermark("clock", watermark).groupBy("conv_id", "turn", "provider")
              .transformWithStateInPandas(_Lines(idle_ms, remember_ms, max_pending), VALUE, "append", "EventTime"))
    return unpacked(values, _Lines.OUTPUT)


def run_steps(spark: SparkSession, rows: DataFrame, steps: int, job: Callable[[DataFrame], DataFrame], name: str,
              state_partitions: int | None = None) -> DataFrame:
    """Run the stream ``job`` over ``rows`` as they come in: the rows of each value of ``step`` (0 to steps - 1) are added to a folder in the shared
    checkpoint folder, and the query is started again from its checkpoint on what is new. Returns everything that it wrote.

    Each start is one micro-batch of the step's rows, and one without rows if timers are due."""
    base = os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")
    source, out, staged = (os.path.join(base, x) for x in ("in", "out", "staged"))
    rows.write.parquet(staged)
    staged_rows = spark.read.schema(rows.schema).parquet(staged)
    schema = rows.drop("step").schema
    partitions = "spark.sql.shuffle.partitions"
    old = {k: spark.conf.get(k, None) for k in (partitions, *_STATE_CONF)}
    tagged = None
    try:
        for step in range(steps):
            staged_rows.where(F.col("step") == step).drop("step").write.mode("append").parquet(source)
            spark.conf.set(partitions, str(state_partitions or spark.sparkContext.defaultParallelism))
            tagged = job(spark.readStream.schema(schema).parquet(source))
            (tagged.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", os.path.join(base, "ckpt"))
             .trigger(availableNow=True).start().awaitTermination())
            spark.conf.set(partitions, old[partitions])
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(tagged.schema).parquet(out)
