"""Jobs and runs, descriptions, progress, throttling, compaction, against small models."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from cairnspark.functions import media, probe
from cairnspark.functions.policy import Profile
from cairnspark.operators import jobs, near, queue
from cairnspark.streaming import bookkeeping


def _jpeg(w: int, h: int) -> bytes:
    return b"\xff\xd8" + b"\xff\xe0" + struct.pack(">H", 6) + b"JFIF" + b"\xff\xc4" + struct.pack(">H", 4) + b"\0\0" + b"\xff\xc2" + struct.pack(">HBHH", 8, 8, h, w) + b"\0"


HEADS = [
    (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 300, 70_000), (300, 70_000)), (b"GIF89a" + struct.pack("<HH", 12, 34), (12, 34)), (b"BM" + bytes(16) + struct.pack("<ii", 5, -6), (5, 6)),
    (_jpeg(640, 480), (640, 480)), (b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (199).to_bytes(3, "little"), (100, 200)),
    (b"RIFF\0\0\0\0WEBPVP8L" + bytes(5) + (99 | 199 << 14).to_bytes(4, "little"), (100, 200)), (b"RIFF\0\0\0\0WEBPVP8 " + bytes(10) + struct.pack("<HH", 100, 200), (100, 200)),
    (b"", (0, 0)), (b"\xff\xd8\xff", (0, 0)), (b"\x89PNG\r\n\x1a\n", (0, 0)), (b"GIF89a\1", (0, 0)), (b"text", (0, 0)),
]


def test_sizes_of_pictures(spark):
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HEADS)] + [(99, None)], "i int, content binary")
    got = {r.i: (r.s.width, r.s.height) for r in rows.select("i", media.image_size(F.col("content")).alias("s")).collect()}
    assert got == {**{i: want for i, (_, want) in enumerate(HEADS)}, 99: (0, 0)}


def test_jobs_begin_with_their_settings(spark):
    old = spark.createDataFrame([(3, "a", "[]", None, "{}", "done", 1, 2, None), (4, "b", "[]", None, "{}", "running", 1, None, 7)], jobs.JOBS)
    items = spark.createDataFrame([(1, 3), (2, 4)], "id bigint, job_id bigint")
    after, left, number = jobs.open_job(old, items, ["/x/y", "/z"], Profile(), 50)
    rows = {r.id: r for r in after.collect()}
    assert number == 5 and set(rows) == {4, 5} and [r.id for r in left.collect()] == [2]
    assert (rows[5].name, rows[5].status, rows[5].created_at, rows[5].finished_at) == ("y、z", "scanning", 50, None)
    assert Profile.from_json(rows[5].profile_json) == Profile()
    assert {r.id: r.est_out_bytes for r in jobs.set_estimate(after, 5, -9).collect()} == {4: 7, 5: 0}
    assert jobs.open_job(old.limit(0), items, ["/"], Profile(), 1)[2] == 1


def test_progress_is_kept_until_there_is_more(spark):
    r, rows, want = random.Random(2), [], []
    for p in range(3):
        now = dict.fromkeys(probe.PROGRESS_KEYS)
        for seq in range(60):
            key = r.choice(["frame", "fps", "out_time_us", "out_time_ms", "total_size", "speed", "progress", "other", ""])
            value = r.choice(["end", "continue"]) if key == "progress" else r.choice(["N/A", "12", "3.5", " 7 ", "2x", ""])
            rows.append((p, seq, f"{key}={value}" if key else "no pair"))
            name = "out_time_us" if key == "out_time_ms" else key
            text = value.strip()
            if name == "speed":
                text = text.rstrip("x")
            if name in now:
                try:
                    now[name] = int(text) if name in ("frame", "out_time_us", "total_size") else float(text)
                except ValueError:
                    pass
            if key == "progress":
                want.append((p, seq, *now.values(), value == "end"))
    df = spark.createDataFrame(rows, "process int, seq int, line string").repartition(3)
    assert sorted(map(repr, map(tuple, probe.progress_frames(df).collect()))) == sorted(map(repr, want))


def test_frames_are_thinned_out(spark):
    r = random.Random(6)
    rows = sorted({(k, r.randint(0, 2000)) for k in range(3) for _ in range(120)})
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "id int, at int, frame int")
    got = {(x.id, x.at) for x in bookkeeping.throttled(df, "at").collect()}
    for k in range(3):
        mine = [t for j, t in rows if j == k]
        assert {t for j, t in got if j == k} == {mine[0], *{t // 100: t for t in mine}.values()}


def test_batches_end_by_count_and_by_time(spark):
    df = spark.createDataFrame([(i, 0 if i < 450 else 501) for i in range(460)], "seq int, at int")
    got = {(x.interval, x.chunk): x.n for x in bookkeeping.result_batches(df, "at").groupBy("interval", "chunk").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, 0): 200, (0, 1): 200, (0, 2): 50, (1, 0): 10}


def test_stream_folders_fold_into_one(spark, tmp_path):
    from cairnspark.plans.catalog import blank_items

    rows = [(i, ["started", "done", "failed", "requeued"][i * 7 % 4], i % 5, f"/o{i}", i, i, "c", "m", None) for i in range(40)]
    df, at = spark.createDataFrame(rows, bookkeeping.CHANGES), f"file://{tmp_path}"
    df.repartition(4).write.parquet(f"{at}/in")
    bookkeeping.start(bookkeeping.read_changes(spark, f"{at}/in", 1), f"{at}/out", f"{at}/cp", availableNow=True).awaitTermination()
    bookkeeping.compact(spark, f"{at}/out", f"{at}/one")
    want = sorted(map(tuple, queue.fold_results(blank_items(df), df).collect()))
    assert sorted(map(tuple, bookkeeping.states(blank_items(df), f"{at}/one").collect())) == want and len(list((tmp_path / "one").iterdir())) == 1


@pytest.mark.parametrize("block", [2000, 7])
def test_separation_is_over_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near, "SEPARATION_BLOCK", block)
    r = random.Random(4)
    rows = [(f"/{i}", r.getrandbits(8), r.randint(0, 3)) for i in range(60)]
    got = {x.same: tuple(x)[1:] for x in near.separation(spark.createDataFrame(rows, "path string, fp0 bigint, label int"), ["fp0"]).collect()}
    for same in (True, False):
        d = [(a[1] ^ b[1]).bit_count() for k, a in enumerate(rows) for b in rows[:k] if (a[2] == b[2]) == same]
        mean = sum(d) / len(d)
        sd = (sum((x - mean) ** 2 for x in d) / len(d)) ** 0.5
        assert got[same] == (len(d), min(d), max(d), pytest.approx(mean, abs=1e-6), pytest.approx(sd, abs=1e-6))


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from cairnspark.plans.checkpoint import shared_dir

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(far)


def test_pairs_of_bands_are_named_once_in_a_small_plan(spark):
    rows = spark.createDataFrame([(["a", "b", "c"],)], "fine array<string>").select(near.band_pairs("fine", 3).alias("x"))
    assert rows.first().x == ["0,1/a/b", "0,2/a/c", "1,2/b/c"]
    plan = spark.createDataFrame([(["a"] * 18,)], "fine array<string>").select(F.explode(near.band_pairs("fine", 18)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat_ws") == 1
