"""The books of running jobs: one book with state in dictionaries, and a stream on the clock."""

import time
import uuid

from pyspark.sql import Row

from cairnspark.streaming import jobbook


class _State:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v if not isinstance(self.v, list | type(None)) else iter(self.v or [])

    def update(self, v):
        self.v = v

    put = update

    def clear(self):
        self.v = None


class _Map(dict):
    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, k, v):  # noqa: N802
        self[k] = v

    def removeKey(self, k):  # noqa: N802
        del self[k]


class _Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, *a):  # noqa: N802
        return _State()

    getListState = getValueState  # noqa: N815

    def getMapState(self, *a):  # noqa: N802
        return _Map()

    def registerTimer(self, t):  # noqa: N802
        self.timers.add(t)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.discard(t)


class _At:
    def __init__(self, t):
        self.t = t

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.t

    getCurrentProcessingTimeInMs = getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815


class Book:
    """A JobBook that is fed by hand; what comes out is kept."""

    def __init__(self, **bounds):
        self.handle, self.book, self.out, self.watermark = _Handle(), jobbook.JobBook(**bounds), [], 0
        self.book.init(self.handle)

    def feed(self, *rows, watermark=None):
        base = dict.fromkeys(jobbook._FIELDS) | {"job_id": 1, "part": 0}
        self.out += self.book.handleInputRows((1,), iter([Row(**(base | r)) for r in rows]), _At(self.watermark))
        self.watermark = max(self.watermark, watermark or 0)
        for t in sorted(self.handle.timers):
            if t <= self.watermark:
                self.handle.timers.discard(t)
                self.out += self.book.handleExpiredTimer((1,), _At(self.watermark), _At(t))
        return self

    def of(self, kind, *fields):
        return [tuple(r[f] for f in fields) for r in self.out if r["kind"] == kind]


def _m(seq, at, type, id=1, **more):
    return {"seq": seq, "at": at, "type": type, "id": id} | more


def test_batches_end_by_count_by_time_and_at_a_barrier():
    b = Book(count=2, millis=500)
    b.feed(_m(1, 10, "started"), _m(2, 20, "started", 2), _m(3, 30, "done"), watermark=200)
    assert b.of("commit", "n", "at", "type") == [(0, 20, "count")]
    b.feed(watermark=600)  # no message comes: a timer ends the batch
    assert b.of("commit", "n", "at", "type")[1:] == [(1, 530, "time")]
    b.feed(_m(4, 700, "done", 2), _m(5, 710, "barrier", 0, parts=1))
    assert b.of("commit", "n", "at", "type")[2:] == [(2, 710, "barrier")] and b.of("ack", "n", "at") == [(0, 710)]


def test_repeated_messages_do_nothing_and_late_ones_are_put_in_order():
    rows = [_m(1, 10, "claimed", est=100, video=True), _m(2, 20, "started"), _m(3, 30, "started", 2), _m(4, 40, "done", src_size=5, dst_size=3), _m(9, 50, "end", 0, parts=1)]
    once, twice = Book(), Book()
    once.feed(*rows)
    twice.feed(*rows[:3], rows[0]).feed(rows[2], rows[3], rows[3]).feed(rows[4], rows[3])
    assert [r for r in once.out if r["kind"] != "frame"] == [r for r in twice.out if r["kind"] != "frame"]
    last = once.out[-2]
    assert last["kind"] == "frame" and last["running"] == [2] and last["totals"]["video_did"] == 100 and last["totals"]["video_took"] == 20 and last["totals"]["done"] == 1


def test_a_barrier_waits_for_all_parts_and_later_rows_wait_for_it():
    b = Book()
    b.feed(_m(1, 10, "started"), _m(3, 20, "barrier", 0, parts=2), _m(5, 30, "started", 3), watermark=25)
    assert b.of("ack", "n") == [] and b.of("change", "id") == []
    b.feed(_m(2, 15, "started", 2, part=1), watermark=100)
    assert b.of("ack", "n") == []
    b.feed(_m(4, 120, "barrier", 0, parts=2, part=1))
    assert b.of("ack", "n", "at") == [(0, 120)] and b.of("change", "id") == [(1,), (2,)]
    b.feed(_m(7, 130, "end", 1, parts=2), _m(6, 130, "end", 1, parts=2, part=1))
    assert b.of("change", "id") == [(1,), (2,), (3,)]


def test_frames_are_throttled_and_the_first_and_last_are_shown():
    b = Book(tick=100)
    b.feed(*(_m(k, 1000 + 10 * k, "started", k) for k in range(30)), _m(99, 1400, "end", 0, parts=1))
    frames = b.of("frame", "at", "type")
    assert frames == [(1000, "tick"), (1100, "tick"), (1200, "tick"), (1300, "tick"), (1400, "last")]
    assert [len(x[0]) for x in b.of("frame", "running")] == [1, 11, 21, 30, 30]


def test_control_stops_resumes_and_cancels():
    b = Book()
    b.feed(_m(1, 10, "started"), _m(2, 20, "pause", None), _m(3, 30, "started", 2), _m(4, 40, "resume", None), _m(5, 50, "started", 3), _m(6, 60, "cancel", None), _m(7, 70, "done", 3), _m(8, 80, "resume", None), _m(9, 90, "started", 4), _m(10, 99, "end", 0, parts=1))
    assert b.of("change", "type", "id") == [("started", 1), ("requeued", 1), ("started", 3), ("requeued", 3)]
    assert b.of("control", "type") == [("pause",), ("resume",), ("cancel",)]


def test_a_live_stream_commits_on_the_clock(spark, tmp_path):
    base = dict.fromkeys(jobbook._FIELDS) | {"job_id": 1, "part": 0, "at": 0}
    rows = [base | _m(k, 0, "started", k) for k in range(7)]
    folder = f"{tmp_path}/in"
    spark.createDataFrame([tuple(r[c] for c in jobbook._FIELDS) for r in rows], jobbook.MESSAGE).coalesce(1).write.parquet(folder)
    out = jobbook.books(jobbook.read_messages(spark, folder), "1 second", count=5, millis=500, live=True)
    query = jobbook.start(out, f"{tmp_path}/out", f"{tmp_path}/{uuid.uuid4().hex}")
    try:
        for _ in range(120):
            time.sleep(0.5)
            if query.exception():
                raise query.exception()
            found = jobbook.read_books(spark, f"{tmp_path}/out").where("kind = 'commit'").collect() if (tmp_path / "out").exists() and any((tmp_path / "out").glob("batch=*/kind=commit")) else []
            if len(found) == 2:
                break
    finally:
        query.stop()
    assert sorted((r["n"], r["type"], r["totals"]["changes"]) for r in found) == [(0, "count", 5), (1, "time", 2)]


def test_a_frame_at_a_barriers_moment_has_all_messages_of_that_moment():
    b = Book(tick=100)
    b.feed(_m(1, 10, "started"), _m(2, 110, "started", 2), _m(3, 110, "barrier", 0, parts=1), _m(4, 110, "started", 3), _m(5, 400, "end", 1, parts=1))
    assert b.of("frame", "at", "running") == [(10, [1]), (110, [1, 2, 3]), (400, [1, 2, 3])]


def test_messages_that_wait_are_packed():
    b = Book()
    b.feed(*(_m(k, 1000 + k, "started", k) for k in range(20_000)), watermark=5)
    pieces = b.book.waiting
    assert b.of("change", "id") == [] and len(pieces) == 1 and sum(len(v[0]) for v in pieces.values()) <= 100 * 20_000
    b.feed(_m(20_000, 99_999, "end", 0, parts=1))
    assert b.of("change", "id") == [(k,) for k in range(20_000)] and not pieces


def test_frames_need_not_name_what_runs():
    b = Book(listed=False)
    b.feed(_m(1, 10, "claimed", est=100, video=True), _m(2, 10, "started"), _m(3, 20, "progress", percent=50), _m(4, 60, "end", 0, parts=1))
    last = b.out[-2]
    assert last["running"] is None and last["totals"]["running"] == 1 and (last["totals"]["video_live_did"], last["totals"]["video_live_took"]) == (5000, 50)


class _Outside(_Map):
    """A map state that is to be read piece by piece: a real one's iterator has all pieces in memory, some times over."""

    def iterator(self):
        assert len(self) <= 1
        return super().iterator()

    def getValue(self, k):  # noqa: N802
        return self[k]


def test_many_waiting_messages_are_read_piece_by_piece():
    b, n = Book(listed=False), 120_000
    b.book.waiting = _Outside()
    b.feed(*(_m(k, 1000 + k, "started", k) for k in range(n)), watermark=5)
    assert len(b.book.waiting) == 3
    b.feed(_m(n, 5000 + n, "started", n), _m(n - 1, 999 + n, "started", n - 1), watermark=51_000)  # the second is a repeated one
    assert len(b.book.waiting) == 2
    b.feed(_m(n + 1, 10**9, "end", 0, parts=1))
    assert b.of("change", "id") == [(k,) for k in range(n + 1)] and not b.book.waiting


def test_live_running_at_a_barriers_moment_equals_its_sql(spark, sf_dir, tmp_path):
    import duckdb

    import __spark_entry__

    at = f"{tmp_path}/events.parquet"
    # forty events a moment, and a barrier in the midst of one of them
    duckdb.sql(f"COPY (SELECT * REPLACE (TIMESTAMP '2024-01-01' + event_id // 40 * INTERVAL 10000 SECOND AS ts) FROM '{sf_dir}/events.parquet') TO '{at}' (FORMAT parquet)")
    found = __spark_entry__.queries()["live_running"](spark, str(tmp_path)).collect()
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW events AS FROM '{at}'")
        known = con.sql(__spark_entry__.oracle_sql()["live_running"]).fetchall()
    assert len(known) > 100 and sorted(map(tuple, found)) == sorted(known)


def test_no_message_is_lost_where_time_starts_anew(spark, sf_dir, tmp_path):
    import duckdb

    import __spark_entry__

    at = f"{tmp_path}/events.parquet"
    # copies with shifted ids and users at the same times: ids ascend, time starts anew with each copy
    columns = "event_id + k * 1000 AS event_id, user_id + k * 15 AS user_id"
    duckdb.sql(f"COPY (SELECT e.* REPLACE ({columns}) FROM (FROM '{sf_dir}/events.parquet' WHERE event_id < 1000) e, range(3) t(k) ORDER BY event_id) TO '{at}' (FORMAT parquet)")
    last = __spark_entry__.queries()["live_running"](spark, str(tmp_path)).collect()
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW events AS FROM '{at}'")
        known = con.sql(__spark_entry__.oracle_sql()["live_running"]).fetchall()
    ends = [{r[0]: tuple(r[2:]) for r in sorted(map(tuple, rows))} for rows in (last, known)]
    assert len(ends[1]) == 8 and ends[0] == ends[1]  # what runs at the last frame of each job, after all messages
