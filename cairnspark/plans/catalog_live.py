"""Queries of running jobs as a stream: batches, frames, running sets, barriers, control. They join catalog's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnspark.functions import estimate as est
from cairnspark.plans import adapters as v
from cairnspark.plans.catalog_more import ORACLE, QUERIES, query
from cairnspark.streaming import jobbook

__all__ = ["ORACLE", "QUERIES"]

#: Jobs and source partitions of the messages (the last one carries control), events between two barriers, and changes of a batch; a frame's tick and a
#: batch's time are the library's own.
JOBS, PARTS, STRIDE, COUNT = 8, 5, 500, 6
#: Microseconds that become a millisecond, so that a few messages of a job fall into a tenth of a second.
SQUEEZE = 100_000_000
#: Files that a source partition's messages arrive in, one after another, in the order of seq; partitions lag behind each other by up to 2.
CHUNKS = 4


def messages(spark: SparkSession, sf_dir: str, control: bool = False) -> DataFrame:
    """Events as messages of jobs, with barriers and an end, some of them twice; step is when they arrive.

    With control also pauses, lost volumes, resumes and cancels, in the last partition.

    Time is compressed so that a few messages of a job fall into half a second.
    """
    e = v.table(spark, sf_dir, "events").withColumn("at", F.call_function("div", F.unix_micros(F.col("ts").cast("timestamp")), F.lit(SQUEEZE)))
    k, none = F.col("event_id") % 3, F.lit(None)
    kind = F.when(F.col("event_type") == "view", F.when(k == 0, "claimed").when(k == 1, "started").otherwise("progress")).when(F.col("event_type") == "signup", "started")
    kind = kind.when(F.col("event_type") == "click", "done").when(F.col("event_type") == "purchase", F.when(F.col("event_id") % 2 == 0, "skipped").otherwise("started"))
    kind = kind.otherwise(F.when(F.col("event_id") % 2 == 0, "failed").otherwise("requeued"))
    cents = F.round(F.col("value") * 100).cast("long")
    work = e.select(
        (F.col("user_id") % JOBS).alias("job_id"), (F.col("event_id") % (PARTS - 1)).alias("part"), (F.col("event_id") * 2).alias("seq"), "at", kind.alias("type"), F.col("user_id").alias("id"), cents.alias("est"),
        (F.col("user_id") % 3 == 0).alias("video"), (F.col("event_id") % 101).alias("percent"), (cents * 10).alias("src_size"), cents.alias("dst_size"), none.cast("long").alias("parts"),
    )
    each = [F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(c) for n, c in ((JOBS, "job_id"), (PARTS, "part"))]
    last = e.agg(F.max("event_id").alias("event_id"), F.max("at").alias("at"))
    ends = last.selectExpr("event_id * 2 + 2 AS seq", "at + 1000 AS at", "'end' AS type", f"div(event_id + 1, {STRIDE}) AS id")
    marks = e.where(F.col("event_id") % STRIDE == STRIDE - 1).selectExpr("event_id * 2 + 1 AS seq", "at", "'barrier' AS type", f"div(event_id, {STRIDE}) AS id").unionByName(ends)
    marks = marks.select("*", each[0]).select("*", each[1]).withColumn("parts", F.lit(PARTS).cast("long"))
    all_rows = work.unionByName(marks, allowMissingColumns=True)
    if control:
        steer = F.when(F.col("event_id") % 997 == 603, "cancel")
        for rest, kind in ((50, "pause"), (90, "resume"), (130, "volume_lost"), (170, "resume")):
            steer = steer.when(F.col("event_id") % 211 == rest, kind)
        rows = e.select((F.col("event_id") % JOBS).alias("job_id"), F.lit(PARTS - 1).cast("long").alias("part"), (F.col("event_id") * 2 + 1).alias("seq"), "at", steer.alias("type"))
        all_rows = all_rows.unionByName(rows.where("type IS NOT NULL"), allowMissingColumns=True)
    span = e.agg(F.min("at").alias("low"), F.max("at").alias("high"), (F.min("event_id") * 2).alias("first"), (F.max("event_id") * 2 + 3).alias("behind"))
    # by seq and not by time: a partition's messages come in its order, and one that comes after a later one is taken for a repeated one
    chunk = F.floor((F.col("seq") - F.col("first")) * CHUNKS / (F.col("behind") - F.col("first")))
    timed = all_rows.crossJoin(F.broadcast(span)).withColumn("step", chunk + F.col("part") % 3)  # a row of bounds
    return timed.unionByName(timed.where("seq % 97 = 4").withColumn("step", F.col("step") + 1))


def _delay(messages: DataFrame) -> str:
    """Partitions lag by up to 2 of 4 chunks, and repeated messages by one more; the end is at a second after all others."""
    low, high = messages.select("low", "high").first()
    return f"{(high - low) + 1001} milliseconds"


def _run(spark: SparkSession, sf_dir: str, stops: int = 1, listed: bool = False) -> DataFrame:
    m = messages(spark, sf_dir)
    return jobbook.run_to_end(spark, m, "step", _delay(m), stops, count=COUNT, listed=listed)


#: Messages in the order in which a job's books take them, with what each does to its item.
_MESSAGES = f"""e AS (SELECT *, CAST(epoch_us(ts) // {SQUEEZE} AS BIGINT) AS t00, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
bounds AS (SELECT max(event_id) AS last, max(t00) + 1000 AS end_at FROM e),
marks AS (
  SELECT event_id // {STRIDE} AS epoch, t00 AS mark_at, 'barrier' AS mark, event_id * 2 + 1 AS mark_seq FROM e WHERE event_id % {STRIDE} = {STRIDE - 1}
  UNION ALL SELECT (last + 1) // {STRIDE}, end_at, 'end', last * 2 + 2 FROM bounds),
m0 AS (
  SELECT user_id % {JOBS} AS job_id, event_id * 2 AS seq, user_id AS id, event_id // {STRIDE} AS epoch, t00, user_id % 3 = 0 AS video, cents, event_id % 101 AS percent,
    CASE event_type WHEN 'view' THEN ['claimed', 'started', 'progress'][event_id % 3 + 1] WHEN 'signup' THEN 'started' WHEN 'click' THEN 'done'
      WHEN 'purchase' THEN ['skipped', 'started'][event_id % 2 + 1] ELSE ['failed', 'requeued'][event_id % 2 + 1] END AS type
  FROM e),
m AS (
  SELECT m0.*, greatest(t00, coalesce(mark_at, t00)) AS tm, row_number() OVER (PARTITION BY job_id ORDER BY m0.epoch, t00, seq) AS rn,
    type IN ('done', 'failed', 'skipped', 'requeued') AS ends
  FROM m0 LEFT JOIN marks ON marks.epoch = m0.epoch - 1)"""

_PUSHES = """life AS (SELECT *, lag(type) OVER (PARTITION BY job_id, id ORDER BY rn) AS was FROM m WHERE ends OR type = 'started'),
pushes AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY rn) AS pn FROM life WHERE ends OR was IS DISTINCT FROM 'started')"""

_BATCHES = f"""walk AS (
  SELECT job_id, pn, epoch, tm, tm AS t0, 1 AS k, 0 AS n FROM pushes WHERE pn = 1
  UNION ALL
  SELECT p.job_id, p.pn, p.epoch, p.tm, CASE WHEN w.k = {COUNT} OR p.tm >= w.t0 + {jobbook.BATCH_MILLIS} OR p.epoch <> w.epoch THEN p.tm ELSE w.t0 END,
    CASE WHEN w.k = {COUNT} OR p.tm >= w.t0 + {jobbook.BATCH_MILLIS} OR p.epoch <> w.epoch THEN 1 ELSE w.k + 1 END,
    CASE WHEN w.k = {COUNT} OR p.tm >= w.t0 + {jobbook.BATCH_MILLIS} OR p.epoch <> w.epoch THEN w.n + 1 ELSE w.n END
  FROM walk w JOIN pushes p ON p.job_id = w.job_id AND p.pn = w.pn + 1),
batches AS (
  SELECT job_id, n, count(*) AS changes, max(t0) AS t0, max(tm) AS last_at, max(epoch) AS epoch, max_by(pn, pn) AS pn FROM walk GROUP BY job_id, n),
commits AS (
  SELECT b.*, CASE WHEN changes = {COUNT} THEN 'count' WHEN t0 + {jobbook.BATCH_MILLIS} <= mark_at THEN 'time' ELSE mark END AS why,
    CASE WHEN changes = {COUNT} THEN last_at WHEN t0 + {jobbook.BATCH_MILLIS} <= mark_at THEN t0 + {jobbook.BATCH_MILLIS} ELSE mark_at END AS tm
  FROM batches b JOIN marks USING (epoch))"""


@query(f"""WITH RECURSIVE {_MESSAGES}, {_PUSHES}, {_BATCHES}
SELECT c.job_id, CAST(c.n AS BIGINT) AS n, c.tm AS at_ms, p.seq AS last_seq, why, CAST(changes AS BIGINT) AS changes FROM commits c JOIN pushes p ON p.job_id = c.job_id AND p.pn = c.pn""")
def live_commits(spark, sf_dir):
    out = _run(spark, sf_dir)
    return out.where("kind = 'commit'").select("job_id", "n", F.col("at").alias("at_ms"), F.col("seq").alias("last_seq"), F.col("type").alias("why"), F.col("totals")["changes"].alias("changes"))


@query(f"""WITH RECURSIVE {_MESSAGES}, {_PUSHES}, {_BATCHES} SELECT w.job_id, CAST(n AS BIGINT) AS n, p.seq, p.type, p.id, p.tm AS at_ms FROM walk w JOIN pushes p ON p.job_id = w.job_id AND p.pn = w.pn""")
def live_changes(spark, sf_dir):
    """Stopped twice on the way, and gone on from its checkpoint."""
    return _run(spark, sf_dir, stops=3).where("kind = 'change'").select("job_id", "n", "seq", "type", "id", F.col("at").alias("at_ms"))


_LIVE = [f"{lane}_{x}" for lane in jobbook.LANES for x in ("gone", "did", "took", "live_did", "live_took")]
_COUNTS = [c for c in jobbook.TOTALS if c not in _LIVE]


def _lane_sums() -> str:
    out = []
    for lane in jobbook.LANES:
        mine = "video" if lane == "video" else "NOT video"
        settled = f"{mine} AND type IN ('done', 'failed', 'skipped') AND est_was >= 0"
        credited = f"{settled} AND type <> 'skipped' AND start_was >= 0"
        live, lived = f"{mine} AND start_now >= 0 AND est_now >= 0 AND pct_now > 0", f"{mine} AND start_was >= 0 AND est_was >= 0 AND pct_was > 0"
        for name, value in (
            ("gone", f"CASE WHEN {settled} THEN est_was ELSE 0 END"), ("did", f"CASE WHEN {credited} THEN est_was ELSE 0 END"), ("took", f"CASE WHEN {credited} THEN tm - start_was ELSE 0 END"),
            ("live_did", f"CASE WHEN {live} THEN est_now * pct_now ELSE 0 END - CASE WHEN {lived} THEN est_was * pct_was ELSE 0 END"),
            ("live_n", f"CASE WHEN {live} THEN 1 ELSE 0 END - CASE WHEN {lived} THEN 1 ELSE 0 END"), ("live_start", f"CASE WHEN {live} THEN start_now ELSE 0 END - CASE WHEN {lived} THEN start_was ELSE 0 END"),
        ):
            out.append(f"sum({value}) OVER j AS {lane}_{name}")
    return ", ".join(out)


def _left(lane: str) -> str:
    did, took = f"({lane}_did / 1000.0::DOUBLE + {lane}_live_did / 1000.0::DOUBLE / 100.0::DOUBLE)", f"({lane}_took / 1000.0::DOUBLE + {lane}_live_took / 1000.0::DOUBLE)"
    rest = f"greatest(coalesce({lane}_seed, 0) / 1000.0::DOUBLE - {lane}_gone / 1000.0::DOUBLE - {lane}_live_did / 1000.0::DOUBLE / 100.0::DOUBLE, 0.0::DOUBLE)"
    return f"{rest} * CASE WHEN {did} >= 5 AND {took} > 0 THEN {took} / {did} ELSE 1.0::DOUBLE END"


#: The books after each message, and the frames that are shown of them.
_FRAMES = f"""st AS (
  SELECT *, last_value(CASE WHEN type = 'claimed' THEN cents WHEN ends THEN -1 END IGNORE NULLS) OVER w AS est_n,
    last_value(CASE WHEN type = 'claimed' OR ends THEN 0 WHEN type = 'progress' THEN percent END IGNORE NULLS) OVER w AS pct_n,
    last_value(CASE WHEN type = 'started' THEN tm WHEN ends THEN -1 END IGNORE NULLS) OVER w AS start_n
  FROM m WINDOW w AS (PARTITION BY job_id, id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sb AS (
  SELECT *, coalesce(est_n, -1) AS est_now, coalesce(pct_n, 0) AS pct_now, coalesce(start_n, -1) AS start_now, coalesce(lag(est_n) OVER i, -1) AS est_was,
    coalesce(lag(pct_n) OVER i, 0) AS pct_was, coalesce(lag(start_n) OVER i, -1) AS start_was, lead(rn) OVER i AS until
  FROM st WINDOW i AS (PARTITION BY job_id, id ORDER BY rn)),
cum AS (
  SELECT job_id, rn, tm, sum(CAST(start_now >= 0 AS INT) - CAST(start_was >= 0 AS INT)) OVER j AS running, {", ".join(f"sum(CAST(type = '{t}' AS INT)) OVER j AS {t}" for t in ("done", "failed", "skipped", "requeued"))},
    sum(CASE WHEN type = 'done' THEN cents * 10 ELSE 0 END) OVER j AS src_bytes, sum(CASE WHEN type = 'done' THEN cents ELSE 0 END) OVER j AS dst_bytes, {_lane_sums()}
  FROM sb WINDOW j AS (PARTITION BY job_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
moments AS (SELECT job_id, tm, max(rn) AS rn, row_number() OVER (PARTITION BY job_id ORDER BY tm) AS k FROM m GROUP BY job_id, tm),
shown AS (
  SELECT job_id, k, rn, tm AS due, 0 AS n FROM moments WHERE k = 1
  UNION ALL
  SELECT x.job_id, x.k, x.rn, CASE WHEN x.tm > s.due THEN greatest(x.tm, s.due + {jobbook.TICK_MILLIS}) ELSE s.due END, CASE WHEN x.tm > s.due THEN s.n + 1 ELSE s.n END
  FROM shown s JOIN moments x ON x.job_id = s.job_id AND x.k = s.k + 1),
ticks AS (SELECT job_id, n, max(due) AS at_ms, max(rn) AS rn, false AS is_last FROM shown GROUP BY job_id, n),
frames AS (SELECT * FROM ticks UNION ALL SELECT job_id, max(n) + 1, max(end_at), max(rn), true FROM ticks, bounds GROUP BY job_id),
full_frames AS (
  SELECT f.job_id, CAST(f.n AS BIGINT) AS n, at_ms, is_last, f.rn, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _COUNTS)},
    {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _LIVE if "live_took" not in c)}, {", ".join(f"CAST({x}_live_n * at_ms - {x}_live_start AS BIGINT) AS {x}_live_took" for x in jobbook.LANES)}
  FROM frames f JOIN cum ON cum.job_id = f.job_id AND cum.rn = f.rn)"""


def _frames(spark: SparkSession, sf_dir: str, listed: bool = False) -> DataFrame:
    out = _run(spark, sf_dir, listed=listed).where("kind = 'frame'")
    return out.select("job_id", "n", F.col("at").alias("at_ms"), (F.col("type") == "last").alias("is_last"), "running", "totals")


@query(f"WITH RECURSIVE {_MESSAGES}, {_FRAMES} SELECT * EXCLUDE (rn, {', '.join(_LIVE)}) FROM full_frames")
def live_frames(spark, sf_dir):
    return _frames(spark, sf_dir).select("job_id", "n", "at_ms", "is_last", *(F.col("totals")[c].alias(c) for c in _COUNTS))


@query(f"""WITH RECURSIVE {_MESSAGES}, {_FRAMES}, runs AS (SELECT job_id, id, rn, coalesce(until, 9000000000000000000) AS until FROM sb WHERE start_now >= 0)
SELECT f.job_id, f.n, f.running AS n_running, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id), '') AS ids
FROM full_frames f LEFT JOIN runs r ON r.job_id = f.job_id AND r.rn <= f.rn AND f.rn < r.until GROUP BY ALL""")
def live_running(spark, sf_dir):
    """What runs at each frame, by id."""
    return _frames(spark, sf_dir, listed=True).select("job_id", "n", F.col("totals")["running"].alias("n_running"), F.array_join(F.transform("running", lambda x: x.cast("string")), ",").alias("ids"))


@query(f"""WITH RECURSIVE {_MESSAGES}, {_FRAMES},
seeds AS (SELECT job_id, sum(cents) FILTER (video) AS video_seed, sum(cents) FILTER (NOT video) AS light_seed FROM m WHERE type = 'claimed' GROUP BY job_id),
etas AS (SELECT f.*, ({_left("video")}) / {est.video_divisor(False, 2)!r}::DOUBLE + ({_left("light")}) / {est.light_divisor(8)!r}::DOUBLE AS eta FROM full_frames f LEFT JOIN seeds USING (job_id))
SELECT job_id, n, at_ms, {", ".join(_LIVE)}, CASE WHEN eta > 0 THEN round(eta, 3) END AS eta FROM etas""")
def live_ledger(spark, sf_dir):
    """Each lane's ledger at each frame, with the work in flight, and the time that is left."""
    m = messages(spark, sf_dir).where("type = 'claimed'").dropDuplicates(["part", "seq"])
    work = m.groupBy("job_id").agg(*(F.sum(F.when(F.col("video") == (lane == "video"), F.col("est"))).alias(lane) for lane in jobbook.LANES))
    seeds = work.select("job_id", *((F.coalesce(lane, F.lit(0)) / 1000.0).alias(lane) for lane in jobbook.LANES))
    frames = jobbook.with_eta(_frames(spark, sf_dir), seeds)
    return frames.select("job_id", "n", "at_ms", *(F.col("totals")[c].alias(c) for c in _LIVE), F.round("eta", 3).alias("eta"))


@query(f"""WITH RECURSIVE {_MESSAGES}, {_PUSHES}, {_BATCHES}, per AS (SELECT DISTINCT job_id FROM m)
SELECT per.job_id, k.epoch AS barrier, k.mark AS kind, k.mark_at AS at_ms, (SELECT count(*) FROM batches b WHERE b.job_id = per.job_id AND b.epoch <= k.epoch) AS batches,
  (SELECT count(*) FROM m WHERE m.job_id = per.job_id AND m.epoch <= k.epoch AND type IN ('done', 'failed', 'skipped')) AS settled,
  (SELECT count(*) FROM pushes p WHERE p.job_id = per.job_id AND p.epoch <= k.epoch) AS committed
FROM per, marks k""")
def flush_barriers(spark, sf_dir):
    """Each barrier's acknowledgement, and how many changes from before it were in the committed table by then."""
    out = _run(spark, sf_dir)
    acks = out.where("kind = 'ack'").select("job_id", F.col("n").alias("barrier"), F.col("type").alias("kind"), F.col("at").alias("at_ms"), "totals", F.col("seq").alias("mark"), F.col("batch").alias("acked"))
    changes = out.where("kind = 'change'").select("job_id", "seq", "batch")
    # acknowledgements come in the order of barriers: a change counts from the first one on that is behind it and isn't earlier
    marks = acks.select("job_id", F.col("mark").alias("at"), "barrier", "acked")
    by_seq = Window.partitionBy("job_id").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    behind = marks.select("job_id", "at", "barrier", F.lit(None).cast("long").alias("batch")).unionByName(changes.select("job_id", F.col("seq").alias("at"), F.lit(None).cast("long").alias("barrier"), "batch"))
    placed = behind.withColumn("first", F.min("barrier").over(by_seq)).where("batch IS NOT NULL").groupBy("job_id", "first", "batch").agg(F.count("*").alias("n"))
    by_batch = Window.partitionBy("job_id").orderBy(F.desc("batch")).rangeBetween(Window.unboundedPreceding, 0)
    seen = marks.select("job_id", F.col("acked").alias("batch"), "barrier", F.lit(None).cast("long").alias("first"), F.lit(0).cast("long").alias("n"))
    both = seen.unionByName(placed.select("job_id", "batch", F.lit(None).cast("long").alias("barrier"), "first", "n")).withColumn("acked", F.min("barrier").over(by_batch))
    found = both.where("first IS NOT NULL AND acked IS NOT NULL").groupBy("job_id", F.greatest("first", "acked").alias("barrier")).agg(F.sum("n").alias("n"))
    so_far = Window.partitionBy("job_id").orderBy("barrier").rowsBetween(Window.unboundedPreceding, 0)
    before = marks.join(found, ["job_id", "barrier"], "left").select("job_id", "barrier", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("committed"))
    return acks.join(before, ["job_id", "barrier"]).select("job_id", "barrier", "kind", "at_ms", *(F.col("totals")[c].alias(c) for c in ("batches", "settled")), "committed")


@query(f"""WITH {_MESSAGES},
steer AS (
  SELECT event_id % {JOBS} AS job_id, event_id * 2 + 1 AS seq, event_id // {STRIDE} AS epoch, t00,
    CASE WHEN event_id % 997 = 603 THEN 'cancel' WHEN event_id % 211 = 50 THEN 'pause' WHEN event_id % 211 IN (90, 170) THEN 'resume' WHEN event_id % 211 = 130 THEN 'volume_lost' END AS control
  FROM e),
both_rows AS (SELECT job_id, seq, epoch, t00, type, id, NULL AS control FROM m0 UNION ALL SELECT job_id, seq, epoch, t00, NULL, NULL, control FROM steer WHERE control IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY epoch, t00, seq) AS rn FROM both_rows),
ruled AS (
  SELECT *, coalesce(last_value(control IGNORE NULLS) OVER w, 'resume') AS state, coalesce(bool_or(control = 'cancel') OVER b, false) AS over
  FROM placed WINDOW w AS (PARTITION BY job_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY job_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
live AS (SELECT *, NOT over AND control IS NOT NULL AND control <> 'resume' AS stops FROM ruled WHERE NOT over AND (control IS NOT NULL OR state = 'resume')),
next_stop AS (
  SELECT *, min(CASE WHEN stops THEN rn END) OVER (PARTITION BY job_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop_rn FROM live),
last_change AS (
  SELECT * FROM next_stop WHERE type IN ('started', 'done', 'failed', 'skipped', 'requeued') QUALIFY row_number() OVER (PARTITION BY job_id, id ORDER BY rn DESC) = 1),
ends_as AS (SELECT job_id, max_by(control, rn) AS control FROM live WHERE control IS NOT NULL GROUP BY job_id)
SELECT c.job_id, c.id, CASE WHEN type = 'started' THEN CASE WHEN c.stop_rn IS NULL THEN 'running' ELSE 'pending' END WHEN type = 'requeued' THEN 'pending' ELSE type END AS status,
  CASE WHEN type = 'started' AND c.stop_rn IS NOT NULL THEN 'requeued' ELSE type END AS last_change,
  CASE WHEN coalesce(ends_as.control, 'resume') = 'resume' THEN 'run' ELSE ends_as.control END AS job
FROM last_change c LEFT JOIN ends_as USING (job_id)""")
def live_control(spark, sf_dir):
    """Items as a second stream of pauses, lost volumes, resumes and cancels leaves them, and their jobs."""
    m = messages(spark, sf_dir, control=True)
    steers = F.col("part") == PARTS - 1
    out = jobbook.run_to_end(spark, m.where(~steers), "step", _delay(m), control=m.where(steers), count=COUNT, listed=False)
    last = out.where("kind = 'change'").groupBy("job_id", "id").agg(F.max_by("type", F.struct("at", "seq")).alias("last_change"))
    job = out.where("kind = 'control'").groupBy("job_id").agg(F.max_by("type", F.struct("at", "seq")).alias("job"))
    status = F.when(F.col("last_change") == "started", "running").when(F.col("last_change") == "requeued", "pending").otherwise(F.col("last_change"))
    state = F.when(F.coalesce("job", F.lit("resume")) == "resume", "run").otherwise(F.col("job"))
    return last.join(job, "job_id", "left").select("job_id", "id", status.alias("status"), "last_change", state.alias("job"))
