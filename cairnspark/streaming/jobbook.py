"""The books of running jobs, kept as a stream: running set, in-flight estimates, ledgers, commits, frames, barriers, control.

Messages of a job come from several source partitions, late and repeatedly. Each job is one key of transformWithState; its
state is what a job needs to go on: totals, the items in flight, changes that aren't committed and messages that wait. In
event time messages wait until the watermark has passed them and are then taken in the order of at and seq, so what comes
out doesn't depend on where micro-batches end; timers of event time end a batch or show a frame when no message does. In
processing time messages are taken as they come, and the same timers run on the clock.

A message has job_id, part (its source partition), seq (ascending in a partition), at (milliseconds), type, id (the item),
est (milliseconds of estimated work), video (whose lane it is), percent, src_size, dst_size and parts. Types:

- claimed: the item is in flight, with its estimate; progress: its percent, if it is in flight.
- started: it runs since at; a repeated one moves its start. done, failed, skipped, requeued: it runs no more and is no more
  in flight. The first three settle it: its estimate is gone, and done and failed ones that had started are credited.
- pause, volume_lost, resume, cancel: control. A pause or a lost volume requeues what runs, and until the resume all work is
  refused; after a cancel, for good.
- barrier, end: a marker of barrier number id, one in each of parts partitions. Once all have come, all rows that stand
  before them are taken and committed, whatever the watermark, and the barrier is acknowledged; rows behind a marker wait
  for that. end is a barrier after which a last frame is shown.

What comes out, by kind: change (a row of a batch, n being the batch), commit (the end of batch n), frame (n-th picture of the
books), ack (of barrier n), control. A batch ends with count changes, or millis after its first one, or at a barrier. A frame
is shown at the first message, then tick after the last frame at the earliest, if there was a message since.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cairnspark.functions.estimate import calibrated, wall_seconds
from cairnspark.plans.checkpoint import importable, shared_dir
from cairnspark.streaming.bookkeeping import BATCH_CHANGES, BATCH_MILLIS, TICK_MILLIS

MESSAGE = "job_id bigint, part bigint, seq bigint, at bigint, type string, id bigint, est bigint, video boolean, percent bigint, src_size bigint, dst_size bigint, parts bigint"
OUT = "kind string, job_id bigint, n bigint, at bigint, seq bigint, type string, id bigint, running array<bigint>, totals map<string,bigint>"
_FIELDS = [c.split()[0] for c in MESSAGE.split(", ")]
SETTLING, ENDING = ("done", "failed", "skipped"), ("done", "failed", "skipped", "requeued")
CONTROL, MARKERS = ("pause", "volume_lost", "resume", "cancel"), ("barrier", "end")
#: What a frame counts: items, bytes, and for each lane the milliseconds of estimates that are gone, those that were
#: credited and what they took, and the same of items half-way (estimates times percent).
LANES = ("video", "light")
TOTALS = ("running", "done", "failed", "skipped", "requeued", "src_bytes", "dst_bytes", *(f"{lane}_{x}" for lane in LANES for x in ("gone", "did", "took", "live_did", "live_took")))
_NEVER = -(1 << 62)
#: Files that the messages of a step are written into, and taken from, at once.
STEP_FILES = 4
_BOOK = "totals map<string,bigint>, clock map<string,bigint>, control string"


#: A message that waits, and an item in flight, as they are packed: numbers side by side, a few dozen bytes each.
_WAIT = np.dtype([(c, "i8") for c in ("epoch", "mark", "part", "seq", "at", "id", "est", "percent", "src_size", "dst_size", "parts")] + [("type", "i1"), ("video", "i1")])
_ITEM = np.dtype([(c, "i8") for c in ("id", "est", "percent", "start")] + [("video", "i1")])
#: What stands for null there.
_NONE = -(1 << 63)
#: Messages that are looked at as Python objects at once, and rows of a packed value of the state.
SLICE, PIECE = 5_000, 50_000
_TYPES = ("claimed", "progress", "started", *ENDING, *CONTROL, *MARKERS)
_CODES = {t: k for k, t in enumerate(_TYPES)}
_OUT_ROW = Row(*(c.split()[0] for c in OUT.replace("map<string,bigint>", "map").split(", ")))


def _number(x: int | None) -> int:
    return _NONE if x is None else x


def _value(x: int) -> int | None:
    return None if x == _NONE else x


def _flag(x: bool | None) -> int:
    return -1 if x is None else int(x)


def _joined(parts: list[np.ndarray], kind: np.dtype) -> np.ndarray:
    """One array of all parts; each is let go of once it is copied, so that they aren't held twice."""
    out, at = np.empty(sum(map(len, parts)), kind), 0
    parts.reverse()
    while parts:
        rows = parts.pop()
        out[at : at + len(rows)] = rows
        at += len(rows)
    return out


def _packed(rows: Iterator[Row]) -> np.ndarray:
    """Messages as they come, packed slice by slice."""
    out = []
    while part := [
        (0, m[4] in MARKERS, _number(m[1]), m[2], _number(m[3]), _number(m[5]), _number(m[6]), _number(m[8]), _number(m[9]), _number(m[10]), _number(m[11]), _CODES.get(m[4], -1), _flag(m[7]))
        for m in islice(rows, SLICE)
    ]:
        out.append(np.array(part, _WAIT))
    return _joined(out, _WAIT)


class JobBook(StatefulProcessor):
    """One job's books; count, millis and tick are the bounds of batches and frames. live takes messages as they come.

    Messages that wait and items in flight are packed in the state and in memory, and rows come out as they are made, so a
    task holds about a hundred bytes for a message: they lie in one array, each once, and an index of it puts them in order.
    Frames name what runs unless listed is off.
    """

    def __init__(self, count: int = BATCH_CHANGES, millis: int = BATCH_MILLIS, tick: int = TICK_MILLIS, live: bool = False, listed: bool = True):
        self.count, self.millis, self.tick, self.live, self.listed = count, millis, tick, live, listed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.book = handle.getValueState("book", _BOOK)
        # many rows are one value, so that state is read and written fast
        self.flight = handle.getMapState("flight", "piece bigint", "rows binary")
        self.waiting = handle.getMapState("waiting", "piece bigint", "rows binary")
        self.open = handle.getListState("open", "seq bigint, at bigint, type string, id bigint")

    def close(self) -> None:
        pass

    # --- state ------------------------------------------------------------------------------------------------------

    @staticmethod
    def _read(state, out: np.ndarray) -> np.ndarray:
        """Fill out with the rows of a packed state, piece by piece: an iterator has many pieces in memory, some times over."""
        pieces = -(-len(out) // PIECE)
        for (k,), (rows,) in state.iterator() if pieces == 1 else (((k,), state.getValue((k,))) for k in range(pieces)):
            out[k * PIECE : (k + 1) * PIECE] = np.frombuffer(rows, out.dtype)
        return out

    def _write(self, name: str, state, rows: np.ndarray, order: np.ndarray) -> None:
        before, now = (-(-n // PIECE) for n in (self.clock.get(name, 0), len(order)))
        for k in range(now):
            state.updateValue((k,), (rows[order[k * PIECE : (k + 1) * PIECE]].tobytes(),))
        for k in range(now, before):
            state.removeKey((k,))
        self.clock[name] = len(order)

    def _load(self, key) -> None:
        self.job = key[0]
        totals, clock, self.control = self.book.get() if self.book.exists() else ({}, {}, "run")
        self.totals = dict.fromkeys(TOTALS, 0) | dict(totals)
        self.clock = dict.fromkeys(("now", "since", "shown", "wake", "due"), _NEVER) | dict.fromkeys(("batch", "frame", "epoch"), 0) | dict(clock)
        self.half = {lane: [0, 0, 0] for lane in LANES}
        self.items: dict[int | None, tuple] = {}
        self.running: list[int] = []
        held = self._read(self.flight, np.empty(self.clock.get("flight", 0), _ITEM))
        for k in range(0, len(held), SLICE):
            for id, est, percent, start, video in held[k : k + SLICE].tolist():
                self._put(_value(id), (_value(est), None if video < 0 else bool(video), percent, _value(start)))
        self.changes = [tuple(r) for r in self.open.get()]
        self.out: list[Row] = []

    def _store(self) -> None:
        flight = np.array([(_number(k), _number(est), percent or 0, _number(start), _flag(video)) for k, (est, video, percent, start) in self.items.items()], _ITEM)
        self._write("flight", self.flight, flight, np.arange(len(flight)))
        self._write("waiting", self.waiting, self.waits, self.order)
        self.open.put(self.changes) if self.changes else self.open.clear()
        self._wake()
        self.book.update((self.totals, self.clock, self.control))

    def _wake(self) -> None:
        """One timer at what comes first: the end of the batch, the next frame, or a message that waits."""
        first = self.waits[self.order[0]] if len(self.order) and not self.live else None
        due = [int(first["at"]) + 1] if first is not None and first["epoch"] == self.clock["epoch"] and not first["mark"] else []
        due += [self.clock["since"] + self.millis] if self.changes else []
        due += [self.clock["due"] + 1] if self.clock["due"] != _NEVER else []
        wake = min(due, default=_NEVER)
        if wake != self.clock["wake"]:
            if self.clock["wake"] != _NEVER:
                self.handle.deleteTimer(self.clock["wake"])
            if wake != _NEVER:
                self.handle.registerTimer(wake)
            self.clock["wake"] = wake

    # --- items in flight --------------------------------------------------------------------------------------------

    def _put(self, id: int | None, item: tuple | None) -> tuple | None:
        """The item's entry (est, video, percent, start) as it was; now it is item. Sums of what is half-way are kept up."""
        was = self.items.pop(id, None)
        for sign, entry in ((-1, was), (1, item)):
            if entry and entry[3] is not None and entry[0] is not None and (entry[2] or 0) > 0:
                sums = self.half[LANES[not entry[1]]]
                sums[0] += sign * entry[0] * entry[2]
                sums[1] += sign
                sums[2] += sign * entry[3]
        if item:
            self.items[id] = item
        ran, runs = was is not None and was[3] is not None, item is not None and item[3] is not None
        if self.listed and ran != runs and id is not None:
            insort(self.running, id) if runs else self.running.pop(bisect_left(self.running, id))
        return was

    # --- what comes out ---------------------------------------------------------------------------------------------

    def _emit(self, kind: str, n: int, at: int, seq: int | None = None, type: str | None = None, id: int | None = None, running: list | None = None, totals: dict | None = None) -> None:
        self.out.append(_OUT_ROW(kind, self.job, n, at, seq, type, id, running, totals))

    def _commit(self, at: int, why: str) -> None:
        if self.changes:
            n = self.clock["batch"]
            for seq, when, type, id in self.changes:
                self._emit("change", n, when, seq, type, id)
            self._emit("commit", n, at, self.changes[-1][0], why, totals={"changes": len(self.changes)})
            self.changes, self.clock["batch"] = [], n + 1

    def _frame(self, at: int, last: bool = False) -> None:
        totals = dict(self.totals)
        for lane, (did, n, start) in self.half.items():
            totals[f"{lane}_live_did"] += did
            totals[f"{lane}_live_took"] += n * at - start
        self._emit("frame", self.clock["frame"], at, type="last" if last else "tick", running=list(self.running) if self.listed else None, totals=totals)
        self.clock |= {"frame": self.clock["frame"] + 1, "shown": at, "due": _NEVER}

    def _until(self, at: int) -> None:
        """What is due before messages of at are taken: frames before at, and batches that end by then."""
        ends = self.clock["since"] + self.millis if self.changes else None
        if self.clock["due"] != _NEVER and self.clock["due"] < at:
            self._frame(self.clock["due"])
        if ends is not None and ends <= at:
            self._commit(ends, "time")
        self.clock["now"] = max(self.clock["now"], at)

    def _changed(self, at: int) -> None:
        """A frame is due: now, or a tick after the last one. It is shown once all messages of its time are taken."""
        if self.clock["due"] == _NEVER:
            self.clock["due"] = max(at, self.clock["shown"] + self.tick)

    # --- messages ---------------------------------------------------------------------------------------------------

    def _push(self, seq: int, at: int, type: str, id: int) -> None:
        if not self.changes:
            self.clock["since"] = at
        self.changes.append((seq, at, type, id))
        if len(self.changes) >= self.count:
            self._commit(at, "count")

    def _stop(self, id: int) -> tuple | None:
        """The item's entry as it was, if it was in flight or running, and it is neither any more."""
        was = self._put(id, None)
        if was and was[3] is not None:
            self.totals["running"] -= 1
        return was

    def _take(self, m: tuple) -> None:
        _, _, _, seq, _, id, est, percent, src_size, dst_size, _, code, video = m
        at, type, id = self.clock["now"], _TYPES[code] if code >= 0 else "", _value(id)
        if type in CONTROL:
            self._steer(seq, type, at)
            return
        if self.control != "run":
            return
        t = self.totals
        if type == "claimed":
            start = self.items[id][3] if id in self.items else None
            self._put(id, (_value(est), video == 1, 0, start))
        elif type == "progress":
            was = self.items.get(id)
            if was and was[0] is not None:
                self._put(id, (was[0], was[1], _value(percent), was[3]))
        elif type == "started":
            was = self.items.get(id, (None, None, 0, None))
            self._put(id, (*was[:3], at))
            if was[3] is None:
                t["running"] += 1
                self._push(seq, at, type, id)
        elif type in ENDING:
            was = self._stop(id)
            t[type] += 1
            if type in SETTLING and was and was[0] is not None:
                lane = LANES[not was[1]]
                t[f"{lane}_gone"] += was[0]
                if type != "skipped" and was[3] is not None:
                    t[f"{lane}_did"] += was[0]
                    t[f"{lane}_took"] += at - was[3]
            if type == "done":
                t["src_bytes"] += _value(src_size) or 0
                t["dst_bytes"] += _value(dst_size) or 0
            self._push(seq, at, type, id)
        self._changed(at)

    def _steer(self, seq: int, type: str, at: int) -> None:
        if self.control == "cancel":
            return
        self.control = "run" if type == "resume" else type
        if self.control != "run":
            for id in sorted(k for k, v in self.items.items() if v[3] is not None):
                self._stop(id)
                self.totals["requeued"] += 1
                self._push(seq, at, "requeued", id)
            for id in list(self.items):
                self._put(id, None)
        self._emit("control", 0, at, seq, type)
        self._changed(at)

    def _flush(self) -> Iterator[Row]:
        out, self.out = self.out, []
        return iter(out)

    def _take_all(self, order: np.ndarray) -> Iterator[Row]:
        """Messages in order; what comes out of a slice is given before the next one."""
        for k in range(0, len(order), SLICE):
            for m in self.waits[order[k : k + SLICE]].tolist():
                if m[4] > self.clock["now"]:
                    self._until(m[4])
                self._take(m)
            yield from self._flush()

    def _ready(self, watermark: int) -> Iterator[Row]:
        """Take what is before the barriers that are complete, then what the watermark has passed."""
        low, complete = 0, True
        epochs = self.waits["epoch"][self.order]
        while complete:
            epoch = self.clock["epoch"]
            # in the order of barriers, and before each its rows in the order of time, so the next ones are always the first
            high = low + int(np.searchsorted(epochs[low:], epoch, "right"))
            mine = self.order[low:high]
            first = low + int(np.searchsorted(self.waits["mark"][mine], 1))
            marks = self.waits[self.order[first:high]]
            complete = len(marks) > 0 and len(marks) >= marks["parts"][0]
            end = first if complete or self.live else low + int(np.searchsorted(self.waits["at"][self.order[low:first]], watermark))
            yield from self._take_all(self.order[low:end])
            low = end
            if complete:
                low, kind = high, _TYPES[marks["type"][0]]
                at = max(self.clock["now"], int(marks["at"].max()))
                self._until(at)
                self._commit(at, kind)
                if kind == "end":
                    self._frame(at, last=True)
                self._emit("ack", epoch, at, int(marks["seq"].max()), kind, totals={"batches": self.clock["batch"], "settled": sum(self.totals[x] for x in SETTLING)})
                self.clock["epoch"] += 1
        self.order = self.order[low:]
        if watermark > self.clock["now"] and self.clock["now"] != _NEVER:
            self._until(watermark)
        if self.live and self.clock["due"] != _NEVER and self.clock["due"] <= watermark:
            self._frame(watermark)
        yield from self._flush()

    def _arrive(self, rows: Iterator[Row], now: int) -> None:
        """Put messages among those that wait, each behind the barriers of its part; repeated ones are left out."""
        new = _packed(rows)
        if self.live:
            new["at"] = now
        order = np.lexsort((new["seq"], new["part"]))  # the first of repeated ones stays the first
        parts, seqs, keep = new["part"][order], new["seq"][order], np.zeros(len(new), bool)
        for part in np.unique(parts).tolist():
            low, high = np.searchsorted(parts, part), np.searchsorted(parts, part, "right")
            seq = seqs[low:high]
            mine = order[low:high][(np.diff(seq, prepend=seq[0] - 1) > 0) & (seq > self.clock.get(f"last {part}", _NEVER))]  # a partition's messages come in order
            if len(mine):
                self.clock[f"last {part}"] = int(seq[-1])
                marks = np.cumsum(new["mark"][mine]) + self.clock.get(f"marks {part}", 0)
                new["epoch"][mine], self.clock[f"marks {part}"] = marks - new["mark"][mine], int(marks[-1])
                keep[mine] = True
        if not keep.all():
            new = new[keep]
        n = self.clock.get("waiting", 0)
        self.waits = np.empty(n + len(new), _WAIT)
        self._read(self.waiting, self.waits[:n])
        self.waits[n:] = new
        del new
        self.order = np.lexsort([self.waits[c] for c in ("part", "seq", "at", "mark", "epoch")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._load(key)
        now = timerValues.getCurrentProcessingTimeInMs() if self.live else timerValues.getCurrentWatermarkInMs()
        self._arrive(rows, now)
        yield from self._ready(now)
        self._store()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._load(key)
        now = timerValues.getCurrentProcessingTimeInMs() if self.live else timerValues.getCurrentWatermarkInMs()
        if self.clock["wake"] == expiredTimerInfo.getExpiryTimeInMs():
            self.clock["wake"] = _NEVER  # Spark drops a timer that has fired
        self._arrive(iter(()), now)
        yield from self._ready(now)
        self._store()


# --- running it ---------------------------------------------------------------------------------------------------

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_messages(spark: SparkSession, folder: str, files_per_batch: int = 4) -> DataFrame:
    """Message files as they arrive, so many a micro-batch: the stream's back-pressure."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def books(messages: DataFrame, delay: str, count: int = BATCH_CHANGES, millis: int = BATCH_MILLIS, tick: int = TICK_MILLIS, live: bool = False, listed: bool = True) -> DataFrame:
    """What the books of all jobs give, from a stream of messages. delay is how late a message may come in event time."""
    importable(messages.sparkSession)
    marked = messages.select(*_FIELDS, F.timestamp_millis("at").alias("time")).withWatermark("time", delay)
    processor = JobBook(count, millis, tick, live, listed)
    return marked.groupBy("job_id").transformWithState(processor, OUT, "Append", "ProcessingTime" if live else "EventTime")


def start(out: DataFrame, folder: str, checkpoint: str, **trigger):
    """Write what the books give into a folder, by kind. A micro-batch that is run again overwrites its own rows."""
    spark = out.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/batch={number}")

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # map and list state need it; a query takes it when it starts
    try:
        writer = out.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        return writer.foreachBatch(write).trigger(**(trigger or {"processingTime": f"{TICK_MILLIS} milliseconds"})).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def read_books(spark: SparkSession, folder: str) -> DataFrame:
    """All that the books have given so far, with the number of the micro-batch."""
    return spark.read.schema(f"{OUT}, batch bigint").parquet(folder)


def with_eta(frames: DataFrame, work: DataFrame, hardware: bool = False, gates: tuple[int, int] = (2, 8)) -> DataFrame:
    """frames with eta, the seconds that are left: work has the job_id and the seconds of each lane (video, light) at first.

    What is in flight counts as credited for the part that is done, so the pace shows before an item has ended.
    """

    def left(lane: str) -> Column:
        x = {c: F.col("totals")[f"{lane}_{c}"] / 1000.0 for c in ("gone", "did", "took", "live_did", "live_took")}
        half = x["live_did"] / 100.0
        rest = F.greatest(F.coalesce(F.col(f"_{lane}"), F.lit(0.0)) - x["gone"] - half, F.lit(0.0))
        return calibrated(rest, x["did"] + half, x["took"] + x["live_took"])

    seeds = work.select("job_id", *(F.col(lane).cast("double").alias(f"_{lane}") for lane in LANES))
    eta = wall_seconds(*(left(lane) for lane in LANES), hardware, gates)
    return frames.join(seeds, "job_id", "left").withColumn("eta", F.when(eta > 0, eta)).drop(*(f"_{lane}" for lane in LANES))


def run_to_end(spark: SparkSession, messages: DataFrame, step: str, delay: str, stops: int = 1, control: DataFrame | None = None, **bounds) -> DataFrame:
    """A table of messages as a stream, read to its end: those of a step (a column, from 0) arrive before the next one's.

    control is a second stream of messages beside it. With more stops the query is stopped in between, and goes on from
    its checkpoint.
    """
    at = f"{shared_dir(spark)}/books-{uuid.uuid4().hex}"
    tables = {"work": messages} | ({"control": control} if control is not None else {})
    for name, rows in tables.items():  # once: what makes the messages isn't done again for each step
        rows.select(*_FIELDS, F.col(step).cast("long").alias("step")).write.partitionBy("step").parquet(f"{at}/all/{name}")
    held = {name: spark.read.schema(f"{MESSAGE}, step bigint").parquet(f"{at}/all/{name}") for name in tables}
    steps = [r[0] for r in held["work"].select("step").distinct().orderBy("step").collect()]  # a few
    ends = [len(steps) * (k + 1) // stops - 1 for k in range(stops)]
    for k, s in enumerate(steps):
        for name, rows in held.items():
            # a job's messages of a step are in one file, as those of a partition must come in order
            rows.where(F.col("step") == s).select(*_FIELDS).repartition(STEP_FILES, "job_id").write.mode("append").parquet(f"{at}/{name}")
        if k in ends:
            streams = [read_messages(spark, f"{at}/{name}", STEP_FILES) for name in tables]
            out = books(reduce(DataFrame.unionByName, streams), delay, **bounds)
            start(out, f"{at}/out", f"{at}/checkpoint", availableNow=True).awaitTermination()
    return read_books(spark, f"{at}/out")
