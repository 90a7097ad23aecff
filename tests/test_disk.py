"""Clustered pages, walks, pictures, and files that are put in place or away."""

import os
import random
import statistics
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnspark.functions import pictures
from cairnspark.functions.policy import Profile
from cairnspark.operators import clustered, filework, near, queue
from cairnspark.plans import adapters as v
from cairnspark.plans import catalog_more
from cairnspark.plans.checkpoint import shared_dir
from cairnspark.sources import tree


# --- clustered pages ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def table(spark, sf_dir, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('clustered')}/t"
    rows = v.items(spark, sf_dir)
    first = F.min(F.struct(*[c for c in rows.columns if c != "id"]))
    items = rows.groupBy("id").agg(first.alias("r")).select("id", "r.*").select(*rows.columns)  # ids are unique
    clustered.write(items, folder, 150)
    return folder, items


def test_pages_are_those_of_the_whole_table(spark, table):
    folder, items = table
    for job, status, limit, offset in ((3, "skipped", 20, 60), (3, None, 100, 0), (5, "pending", 30, 10_000), (99, None, 5, 0), (2, "done", 7, 33)):
        want = queue.page(items, job, status, limit, offset).orderBy("id").collect()
        assert clustered.page(spark, folder, job, status, limit, offset).orderBy("id").collect() == want
    for job, kinds, after, limit in ((3, ["image", "audio"], 1000, 32), (3, [], 0, 5), (1, ["video"], -1, 500), (7, ["image"], 10**9, 5)):
        want = queue.take_pending(items, job, kinds, after, limit).orderBy("id").collect()
        assert clustered.take_pending(spark, folder, job, kinds, after, limit).orderBy("id").collect() == want


def test_a_page_opens_a_file_or_two(spark, table):
    folder, items = table
    files = clustered.index(spark, folder).select("file").distinct().count()
    assert files > 20
    assert 1 <= len(clustered.page(spark, folder, 3, None, 40, 200).inputFiles()) <= 2
    assert 1 <= len(clustered.take_pending(spark, folder, 3, ["image"], 5000, 5).inputFiles()) <= 3


# --- the walk -----------------------------------------------------------------------------------------------------


def test_a_walk_prunes_counts_errors_and_follows_no_link(spark, tmp_path, monkeypatch):
    for p in ("a/x.jpg", "a/.hidden/y.jpg", "a/B.photoslibrary/z.jpg", "a/$RECYCLE.BIN/w.jpg", "b/c/d/e.mov", "b/.f.jpg"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"1234")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    (tmp_path / "b" / "loop").symlink_to(tmp_path)
    os.link(tmp_path / "a/x.jpg", tmp_path / "b/hard.jpg")
    for tasks in (1, 2, 50):
        rows = tree.walk(spark, [f"file://{tmp_path}", f"{tmp_path}/none", f"{tmp_path}/b/.f.jpg"], tasks).collect()
        found = sorted((r.kind, r.path.removeprefix(str(tmp_path)), r.nlink) for r in rows)
        assert found == sorted([("ok", "", None), ("missing", "/none", None), ("denied", "/b/.f.jpg", None), ("bundle", "/a/B.photoslibrary", None), ("file", "/a/x.jpg", 2), ("file", "/b/hard.jpg", 2), ("file", "/b/c/d/e.mov", 1), ("file", "/b/.f.jpg", 1)])
    real = os.scandir

    def refused(folder):
        if str(folder).endswith("/c"):
            raise PermissionError(folder)
        return real(folder)

    monkeypatch.setattr(os, "scandir", refused)
    reader = tree.WalkReader([str(tmp_path)], 3)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[2] for r in rows if r[1] == "error"] == [f"{tmp_path}/b/c"]


# --- pictures -----------------------------------------------------------------------------------------------------


def _cells(grey: np.ndarray) -> list[list[int]]:
    """Area sums one by one: every pixel is cut into 16 x 16 parts."""
    fine = np.repeat(np.repeat(grey.astype(int), 16, 0), 16, 1)
    h, w = grey.shape
    return [[int(fine[k * h : (k + 1) * h, j * w : (j + 1) * w].sum()) for j in range(16)] for k in range(16)]


def _bmp(grey: np.ndarray) -> bytes:
    h, w = grey.shape
    line = (w * 3 + 3) // 4 * 4
    body = b"".join(np.repeat(r[:, None], 3, 1).astype(np.uint8).tobytes().ljust(line, b"\0") for r in grey[::-1])
    return struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def test_prints_are_those_of_areas_cut_out_one_by_one(spark):
    r = np.random.default_rng(1)
    rows = []
    for h, w in ((1, 1), (3, 50), (16, 16), (17, 31), (64, 5), (40, 48)):
        grey = r.integers(0, 256, (h, w)).astype(np.uint8)
        cells = _cells(grey)
        assert pictures.area_sums(grey).tolist() == cells
        total = sum(map(sum, cells))
        bits = sum(1 << i for i, c in enumerate(x for line in cells for x in line) if 256 * c >= total)
        for data in (b"P5 %d %d 255\n" % (w, h) + grey.tobytes(), b"P5\n# by hand\n%d\n%d\n255\n" % (w, h) + grey.tobytes(), _bmp(grey), b"P6 %d %d 255\n" % (w, h) + np.repeat(grey[..., None], 3, 2).tobytes()):
            rows.append((data, bits, float(grey.std())))
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(rows)], "i int, content binary").select("i", pictures.picture_print(F.col("content")).alias("p"), pictures.picture_hex(F.col("content")).alias("hex"))
    for x in df.collect():
        assert sum((x.p[f"fp{k}"] % (1 << 64)) << 64 * k for k in range(4)) == rows[x.i][1] and x.p.spread == pytest.approx(rows[x.i][2])
        assert len(x.hex) == 64


def test_what_is_no_picture_has_no_print(spark):
    bad = [None, b"", b"text", b"P5", b"P5 3 3 255\n12", b"P5 0 4 255\n", b"P5 2 2 70000\n1234", b"BM" + b"\0" * 10, b"BM" + b"\xff" * 80]
    df = spark.createDataFrame([(x,) for x in bad], "content binary")
    assert df.select(pictures.picture_hex(F.col("content")).alias("h")).where("h IS NOT NULL").count() == 0


# --- files --------------------------------------------------------------------------------------------------------


def _read(path):
    return path.read_bytes() if path.exists() else None


def test_outputs_are_put_in_place_once_whatever_is_done_twice(spark, tmp_path):
    root, aside = tmp_path / "out", tmp_path / "aside"
    root.mkdir()
    (root / "b.bin").write_bytes(b"old")
    rows = [(1, "/a.bin", b"x" * 10, 100, 1000), (2, "/b.bin", b"y" * 99, 100, 1000), (3, "/c/d.bin", b"", 100, None), (4, "/e.bin", b"z" * 50, 100, None)]
    outputs = spark.createDataFrame(rows, "id bigint, target string, content binary, src_size bigint, mtime bigint")
    filework.stage(outputs, f"file://{aside}")  # an attempt that came to nothing
    manifest = filework.stage(outputs, f"file://{aside}")
    [lost] = [r.staged for r in manifest.collect() if r.id == 4]
    os.unlink(lost)
    for _ in range(2):
        done = {r.id: r.outcome for r in filework.publish(manifest, f"file://{root}", Profile()).collect()}
        assert done == {1: "written", 2: "no_gain", 3: "error", 4: "failed"}
        assert _read(root / "a.bin") == b"x" * 10 and (root / "a.bin").stat().st_mtime == 1000
        assert _read(root / "b.bin") == b"old" and not (root / "c").exists() and not (root / "e.bin").exists()
    assert not [p for p in root.rglob("*") if p.name.endswith(".tmp")]


def test_removals_look_once_more_and_may_be_done_twice(spark, tmp_path):
    root, trash = tmp_path / "files", tmp_path / "trash"
    root.mkdir()
    members, half = [], 1_700_000_000
    for i, change in enumerate(("keep", "plain", "grown", "touched", "gone", "link")):
        path = root / f"{i}.jpg"
        if change != "gone":
            path.write_bytes(b"same" + b"+" * (change == "grown"))
            os.utime(path, (half + (change == "touched"),) * 2)
        if change == "link":
            path.unlink()
            path.symlink_to(root / "0.jpg")
        members.append((i, 1, f"/{i}.jpg", 4, half, int(i == 0), None))
    members += [(10, 2, "/10.jpg", 4, half, 0, None), (11, 2, "/11.jpg", 4, half, 0, None)]
    for i in (10, 11):
        (root / f"{i}.jpg").write_bytes(b"same")
        os.utime(root / f"{i}.jpg", (half, half))
    m = spark.createDataFrame(members, "id bigint, group_id bigint, path string, size bigint, mtime bigint, keep int, disposal string")
    want = {1: ("trashed", None), 2: ("skipped", "size_changed"), 3: ("skipped", "mtime_changed"), 4: ("skipped", "missing"), 5: ("skipped", "symlink"), 10: ("skipped", "no_keeper"), 11: ("skipped", "no_keeper")}
    for _ in range(2):
        assert {r.id: (r.outcome, r.note) for r in filework.apply_removals(m, f"file://{root}", f"file://{trash}").collect()} == want
    assert sorted(p.name for p in root.iterdir()) == ["0.jpg", "10.jpg", "11.jpg", "2.jpg", "3.jpg", "5.jpg"] and [p.read_bytes() for p in trash.rglob("*.jpg")] == [b"same"]


# --- near prints --------------------------------------------------------------------------------------------------


def _prints(spark, seed: int, n: int):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(20)]
    rows = []
    for i in range(n):
        x = r.choice(base)
        for _ in range(r.randrange(6)):
            x ^= 1 << r.randrange(64)
        rows.append((i, x - (1 << 64) if x >> 63 else x, r.randrange(3)))
    return rows, spark.createDataFrame(rows, "ord bigint, fp0 bigint, label bigint")


def _distance(a: int, b: int) -> int:
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


@pytest.mark.parametrize("least", [near.LEAST_BLOCK, 40])
def test_blocks_give_all_pairs_once(spark, monkeypatch, least):
    monkeypatch.setattr(near, "LEAST_BLOCK", least)
    monkeypatch.setattr(near, "BLOCK", least * 2)
    rows, df = _prints(spark, 3, 300)
    assert near.is_wide(18, 64) and not near.is_wide(16, 256)
    got = sorted(map(tuple, near.pairs(df, 18, ["fp0"]).collect()))
    assert got == sorted((a, b, _distance(x, y)) for a, x, _ in rows for b, y, _ in rows if a < b and _distance(x, y) <= 18)


@pytest.mark.parametrize("block", [near.BLOCK, 1])
def test_separation_is_that_of_all_pairs(spark, block):
    rows, df = _prints(spark, 4, 150)
    of: dict = {}
    for a, x, p in rows:
        for b, y, q in rows:
            if a < b:
                of.setdefault(p == q, []).append(_distance(x, y))
    want = sorted((k, len(d), min(d), max(d), round(statistics.fmean(d), 6), round(statistics.pstdev(d), 6)) for k, d in of.items())
    assert sorted(map(tuple, near.separation(df, ["fp0"], block=block).collect())) == want
    one = near.separation(df.where("label = 1").limit(1), ["fp0"], block=block)
    assert one.count() == 0


# --- passes of a job, and scans of content ------------------------------------------------------------------------


def test_a_job_writes_its_queue_once_whatever_its_batches(spark, sf_dir, monkeypatch):
    rows = v.items(spark, sf_dir)
    items = rows.groupBy("id").agg(F.min(F.struct(*[c for c in rows.columns if c != "id"])).alias("r")).select("id", "r.*").select(*rows.columns)
    now = items.select(F.col("src_path").alias("path"), F.col("src_size").alias("size"), F.col("src_mtime").alias("mtime"))
    folds = []
    monkeypatch.setattr(queue, "fold_results", lambda a, b, f=queue.fold_results: folds.append(1) or f(a, b))

    def work(fed):
        return fed.selectExpr("0L AS seq", "'done' AS type", "id", "dst AS dst_path", "1L AS dst_size", "1L AS elapsed_ms", "CAST(NULL AS string) AS code", "CAST(NULL AS string) AS msg", "CAST(NULL AS string) AS reason")

    n = items.where("job_id = 3 AND status = 'pending'").count()
    done, status = queue.run_job(items, now, 3, F.concat(F.lit("/out/"), F.col("id").cast("string")), work, n // 3 + 1)
    assert status == "done" and len(folds) == 1 and done.where("job_id = 3 AND status = 'pending'").count() == 0
    assert done.where("dst_size = 1").count() == n - items.where("job_id = 3 AND status = 'pending' AND skip_reason IS NOT NULL").count()
    calls = iter([False, True])
    half, status = queue.run_job(items, now, 3, F.concat(F.lit("/out/"), F.col("id").cast("string")), work, n // 2, lambda: next(calls))
    assert status == "paused" and half.where("job_id = 3 AND status = 'pending'").count() == n - n // 2


def test_the_cascade_scans_content_twice_at_most(spark, sf_dir, monkeypatch):
    from cairnspark.operators import exact

    scans = []
    for name in ("sample_hash", "full_hash"):
        monkeypatch.setattr(exact, name, lambda *a, f=getattr(exact, name), n=name: scans.append(n) or f(*a))
    c = v.candidates(spark, sf_dir)
    none = spark.createDataFrame([], "path string, algo string, size bigint, mtime bigint, hash string")
    rows, hashed, _, counts = exact.counted_cascade(c, none, 1024)
    assert scans == ["sample_hash", "full_hash"]
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, exact.groups(c, 1024).collect()))
    assert counts.collect() == exact.stage_counts(c, 1024).collect() and hashed.count() > 0


def test_only_names_that_meet_are_walked_through(spark):
    rows = [(i, f"/s/{i}", "/o/scan.avif") for i in range(1200)] + [(2000 + i, f"/s/x{i}", f"/o/scan-{i:03}.avif") for i in range(1, 900)] + [(5000, "/s/y", "/o/scan-5-2.avif"), (5001, "/s/z", "/o/other.avif"), (5002, "/s/w", "/o/other.avif"), (5003, "/s/v", "/o/other-900.avif")]
    t = spark.createDataFrame(rows, "id bigint, src string, dst string")
    names = t.groupBy(queue.name_family(F.col("dst")).alias("family"), "dst").agg(F.count("*").alias("n"), F.lit(0).alias("old")).withColumn("clash", F.col("n") > 1)
    met = {r.dst for r in queue.met_names(names).collect()}
    # of the names with three digits only those without a leading zero can be met, and 900 is out of reach of two claims
    assert met == {"/o/scan.avif"} | {f"/o/scan-{i}.avif" for i in range(100, 900)}
    got = {r.id: r.final for r in queue.resolve_names(t).collect()}
    used, want = set(), {}
    for i, _, dst in rows:
        stem, k, name = dst.removesuffix(".avif"), 0, dst
        while name in used and k < 999:
            k += 1
            name = f"{stem}-{k}.avif"
        want[i] = None if name in used else name
        used.add(name)
    assert got == want


def test_a_jobs_batches_grow(spark, sf_dir):
    items = v.items(spark, sf_dir)
    items = items.join(items.groupBy("id").count().where("count = 1").select("id"), "id", "left_semi").cache()
    mine = items.where("job_id = 3 AND status = 'pending'")
    now, n, fed = mine.select(F.col("src_path").alias("path"), F.col("src_size").alias("size"), F.col("src_mtime").alias("mtime")), mine.count(), []

    def work(rows):
        fed.append([r.id for r in rows.select("id").collect()])
        none = F.lit(None).cast("string")
        return rows.select(F.lit(0).cast("long").alias("seq"), F.lit("done").alias("type"), "id", F.col("dst").alias("dst_path"), F.lit(1).cast("long").alias("dst_size"), F.lit(1).cast("long").alias("elapsed_ms"), none.alias("code"), none.alias("msg"), none.alias("reason"))

    first = max(1, n // 20)
    _, status = queue.run_job(items.withColumn("skip_reason", F.lit(None).cast("string")), now, 3, F.concat(F.lit("/out/"), F.col("id").cast("string")), work, first)
    assert status == "done" and [len(x) for x in fed][:3] == [first, 2 * first, 4 * first] and len(fed) <= 6
    assert sorted(sum(fed, [])) == sorted(r.id for r in mine.collect()) and all(max(a) < min(b) for a, b in zip(fed, fed[1:], strict=False))
    items.unpersist()


@pytest.mark.parametrize(("bits", "lanes", "threshold", "keys", "hot"), [(64, 4, 18, (1, 2), 2000), (64, 4, 18, (1, 3), 3), (60, 1, 7, (2, 3), 2000), (64, 1, 5, (1, 1), 4), (64, 4, 3, (1, 1), 2)])
def test_prints_meet_at_keys_of_mixed_bits(spark, monkeypatch, bits, lanes, threshold, keys, hot):
    monkeypatch.setattr(near, "MEET", 64)
    r = random.Random(bits + threshold)
    some = [[r.getrandbits(bits) for _ in range(lanes)] for _ in range(6)]
    rows = {}
    for i in range(160):
        x = list(r.choice(some))
        for _ in range(r.randint(0, threshold)):
            x[r.randrange(lanes)] ^= 1 << r.randrange(bits)
        rows.setdefault(tuple(v - (1 << 64) if v >> 63 else v for v in x), i)
    names = [f"fp{k}" for k in range(lanes)]
    df = spark.createDataFrame([(i, *x) for x, i in rows.items()], "ord bigint, " + ", ".join(f"{n} bigint" for n in names))
    want = sorted((a, b, d) for x, a in rows.items() for y, b in rows.items() if a < b and (d := sum(map(_distance, x, y))) <= threshold)
    assert len(want) > 50 and sorted(map(tuple, near.distinct_pairs(df, threshold, names, bits, hot=hot, keys=keys).collect())) == want


def test_keys_keep_pace_with_the_prints(spark):
    for n in (100_000, 1_000_000, 3_000_000):
        cuts, picks = near.scheme(n, 18, 4, 64)
        masks = near.key_masks(18, 4, 64, cuts, picks)
        assert len(masks) <= 140 and min(m.bit_count() for _, m in masks) >= 20
    assert near.scheme(1000, 18, 4, 64) is None and near.scheme(3_000_000, 18, 1, 64) is None and near.scheme(1_000_000, 7, 1, 64)


def test_extremes_are_searched_in_few_steps(spark):
    assert near.steps(50_000, 64)[:3] == [3, 9, 10] and near.steps(600_000, 64)[:3] == [3, 7, 8] and near.steps(2, 64)[-1] == 64
    rows, df = _prints(spark, 5, 60)
    df = df.select(F.col("ord").alias("rep"), "fp0")
    want = sorted((a, b, 64 - _distance(x, y)) for a, x, _ in rows for b, y, _ in rows if a < b and _distance(x, y) >= 34)
    assert want and sorted(map(tuple, near.block_pairs(df, 30, ["fp0"], 64).collect())) == want


def test_scanned_files_share_folders(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(catalog_more, "FOLDERS", 2)
    at = tree.local_path(shared_dir(spark))
    before = set(os.listdir(at))
    n = catalog_more.QUERIES["scanned_files"](spark, sf_dir).count()
    (new,) = (x for x in os.listdir(at) if x.startswith("scan-") and x not in before)
    assert n > 20 and sum(len(folders) for _, folders, _ in os.walk(f"{at}/{new}")) <= 6


def test_staged_files_share_many_folders(spark, tmp_path):
    rows = spark.range(200).selectExpr("id", "concat('/a/', id) AS target", "encode('x', 'utf-8') AS content", "9L AS src_size", "5L AS mtime")
    staged = [r.staged for r in filework.stage(rows, str(tmp_path)).collect()]
    assert all(os.path.isfile(x) for x in staged) and len({os.path.dirname(x) for x in staged}) > 50


def test_files_of_one_task_are_written_by_many(spark, tmp_path):
    from pyspark.sql import functions as F

    from cairnspark.sources import tree

    rows = spark.range(40).coalesce(1).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("path"), F.lit("x").alias("content"), F.lit(5).alias("mtime"))
    spark.sparkContext.setJobGroup("files-of-one-task", "")
    try:
        assert tree.write_files(rows, f"file://{tmp_path}") == 40
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    seen = spark.sparkContext.statusTracker()
    stages = [s for j in seen.getJobIdsForGroup("files-of-one-task") for s in seen.getJobInfo(j).stageIds]
    assert len(list((tmp_path / "d").iterdir())) == 40 and max(seen.getStageInfo(s).numTasks for s in stages) >= 16
