"""Operators against small literal tables and sequential models."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from cairnspark.functions import bits
from cairnspark.operators import exact, near, queue, review, scan
from cairnspark.plans.checkpoint import cut


def test_exact_tiers(spark):
    mid = b"x" * 70_000
    rows = [("/a", b"same bytes"), ("/b", b"same bytes"), ("/c", b"different!"), ("/d", mid + b"1" + mid), ("/e", mid + b"2" + mid), ("/f", b"z" * 31), ("/g/a", mid * 2), ("/g-a", mid * 2), ("/n", None)]
    files = spark.createDataFrame([(p, len(c or b"1234567"), 1, c) for p, c in rows], "path string, size bigint, mtime bigint, content binary")
    got = [(r.group_rank, r.files, r.reclaimable, r.member_rank, r.path) for r in exact.groups(files).orderBy("group_rank", "member_rank").collect()]
    assert got == [(1, 2, 140_000, 1, "/g/a"), (1, 2, 140_000, 2, "/g-a"), (2, 2, 10, 1, "/a"), (2, 2, 10, 2, "/b")]
    s = exact.stage_counts(files).first()
    assert (s.candidates, s.after_size, s.after_sample, s.fully_read, s.sample_was_final, s.groups, s.members) == (9, 7, 6, 4, 2, 2, 4)
    assert exact.groups(files.limit(0)).count() == 0


def _walk(prints, t):
    order = sorted(prints, key=lambda p: p[0].split("/"))
    taken, out = set(), []
    for i, (p, x) in enumerate(order):
        if p in taken:
            continue
        for q, y in order[i + 1 :]:
            if q not in taken and bin(x ^ y).count("1") <= t:
                taken.add(q)
                out.append((p, q))
    return sorted(out)


def test_near_groups_are_the_walks(spark):
    r = random.Random(7)
    cases = [[(f"/p{i:03d}", (1 << i) - 1) for i in range(20)]]
    cases += [[(f"/p{i}", r.getrandbits(8) * 0x0101) for i in range(40)] for _ in range(3)]
    for prints in cases:
        for rounds in (64, 1):
            rows = spark.createDataFrame([(p, 100, x) for p, x in prints], "path string, size bigint, fp0 bigint")
            ord_ = cut(near.with_order(rows))
            names = {x.ord: x.path for x in ord_.collect()}
            found = near.representatives(cut(near.pairs(ord_, 4, ["fp0"])), cut, rounds).collect()
            assert sorted((names[x.seed], names[x.member]) for x in found) == _walk(prints, 4)


def test_near_group_rows(spark):
    rows = spark.createDataFrame([("/a", 100, 0), ("/b", 200, 0b11), ("/z", 50, -1)], "path string, size bigint, fp0 bigint")
    got = [tuple(r) for r in near.groups(rows, 4, ["fp0"], cut).orderBy("member_rank").collect()]
    assert got == [(1, "/a", 200, 0, "/a", 100, 0), (1, "/a", 200, 1, "/b", 200, 2)]
    assert near.groups(rows.limit(0), 4, ["fp0"], cut).count() == 0


def test_neutral_groups_of_both_modes(spark):
    prints = spark.createDataFrame([("/a", 100, 0xAB), ("/b", 200, 0xA8), ("/z", 50, -1)], "path string, size bigint, fp0 bigint")
    e = spark.createDataFrame([("ff", "/c", 7), ("ff", "/d", 7)], "hash string, path string, size bigint")
    got = sorted(tuple(r) for r in review.neutral(e, near.groups(prints, 4, ["fp0"], cut, seed_print=True)).collect())
    seed = "00000000000000ab" + "0" * 48
    assert got == [("exact", "ff", "/c", 7, 0), ("exact", "ff", "/d", 7, 0), ("perceptual", seed, "/a", 100, 0), ("perceptual", seed, "/b", 200, 2)]


def test_pairs_over_four_lanes(spark):
    r = random.Random(1)
    base = [r.getrandbits(63) for _ in range(4)]
    rows = []
    for i in range(30):
        x = list(base) if i % 2 else [r.getrandbits(63) for _ in range(4)]
        for _ in range(r.randint(0, 9)):
            x[r.randrange(4)] ^= 1 << r.randrange(63)
        rows.append((i, *x))
    df = spark.createDataFrame(rows, "ord bigint, fp0 bigint, fp1 bigint, fp2 bigint, fp3 bigint")
    want = sorted((a[0], b[0], d) for a in rows for b in rows if a[0] < b[0] and (d := sum(bin(x ^ y).count("1") for x, y in zip(a[1:], b[1:], strict=True))) <= 16)
    assert sorted(tuple(x) for x in near.pairs(df, 16, ["fp0", "fp1", "fp2", "fp3"]).collect()) == want
    # prints that are alike crowd the bands, which are split then
    lanes = {tuple(sum({1 << r.randrange(63) for _ in range(r.randint(0, 3))}) for _ in range(4)) for _ in range(60)}
    sparse = [(i, *x) for i, x in enumerate(sorted(lanes))]
    df = spark.createDataFrame(sparse, df.schema)
    want = sorted((a[0], b[0], d) for a in sparse for b in sparse if a[0] < b[0] and (d := sum(bin(x ^ y).count("1") for x, y in zip(a[1:], b[1:], strict=True))) <= 9)
    for hot in (5, 2000):
        got = sorted(tuple(x) for x in near.distinct_pairs(df, 9, ["fp0", "fp1", "fp2", "fp3"], hot=hot).collect())
        assert len(want) > 100 and got == want


def test_leaders_are_found_without_pairs(spark):
    r = random.Random(2)
    some = [[r.getrandbits(63) for _ in range(2)] for _ in range(9)]
    prints = {}
    for i in range(300):
        x = list(r.choice(some)) if i % 3 else [r.getrandbits(63) for _ in range(2)]
        for _ in range(r.randint(0, 8)):
            x[r.randrange(2)] ^= 1 << r.randrange(64)
        prints.setdefault(tuple(v - (1 << 64) if v >> 63 else v for v in x), i)
    seeds, want = [], []
    for x, i in prints.items():
        near_by = [(s, d) for y, s in seeds if (d := sum((v % (1 << 64) ^ w % (1 << 64)).bit_count() for v, w in zip(x, y, strict=True))) <= 9]
        want += [(i, *near_by[0])] if near_by else []
        seeds += [] if near_by else [(x, i)]
    df = spark.createDataFrame([(i, *x) for x, i in prints.items()], "rep bigint, fp0 bigint, fp1 bigint")
    for walk in (20, 8192):
        assert len(want) > 50 and sorted(map(tuple, near.leaders(df, 9, ["fp0", "fp1"], walk).collect())) == want
    assert near.leaders(df.limit(0), 9, ["fp0", "fp1"]).count() == 0


def test_prints_of_bits_that_are_seldom_set_do_not_meet_at_keys(spark, monkeypatch):
    r = random.Random(3)
    few = {tuple(sum({1 << r.randrange(63) for _ in range(3)}) for _ in range(4)) for _ in range(400)}
    share = np.full((4, 64), 3 / 64)
    assert near.scheme(10_000, 16, 4, 64) == near.scheme(10_000, 16, 4, 64, set_=np.full((4, 64), 0.5)) == (1, 1)
    assert near.scheme(10_000, 16, 4, 64, set_=share) is None and near.scheme(50_000, 16, 4, 64, set_=share) is None
    # crowded keys: neither side of the join is broadcast, however small the rows look that it is made of
    monkeypatch.setattr(near, "MEET", 64)
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(few)], "ord bigint, fp0 bigint, fp1 bigint, fp2 bigint, fp3 bigint")
    pairs = near.distinct_pairs(df, 9, ["fp0", "fp1", "fp2", "fp3"], hot=5, keys=(1, 1))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    # a print that lacks a lane is near none
    lacks = df.unionByName(df.limit(3).selectExpr("ord + 1000 AS ord", "fp0", "CAST(NULL AS bigint) AS fp1", "fp2", "fp3"))
    assert sorted(map(tuple, near.distinct_pairs(lacks, 9, ["fp0", "fp1", "fp2", "fp3"]).collect())) == sorted(map(tuple, pairs.collect()))


def test_mean_prints_take_the_mean_once(spark):
    from cairnspark.functions.bits import mean_print

    rows = [([1.0, 3.0, 2.5, 2.0],), ([],), (None,), ([1.0, None, 5.0],), ([4.0] * 70 + [9.0],)]
    df = spark.createDataFrame(rows, "v array<double>")
    assert [tuple(x) for x in df.select(mean_print(F.col("v")), mean_print(F.col("v"), offset=0.5)).collect()] == [(6, 2), (0, 0), (None, None), (0, 0), (0, 0)]
    plan = df.select(mean_print(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and not re.search(r"> \(+aggregate", plan)


def test_running_items_count_by_their_fractions(spark):
    rows = [(1, 1, "video", "running", 8.0, None), (2, 2, "video", "running", 40.0, None), (3, 2, "video", "pending", 10.0, None), (4, 3, "image", "running", 3.0, None), (5, 4, "video", "done", 10.0, 5000), (6, 4, "video", "running", 20.0, None)]
    items = spark.createDataFrame(rows, "id bigint, job_id bigint, kind string, status string, est_secs double, elapsed_ms bigint")
    progress = spark.createDataFrame([(1, 0.5, 9000), (2, 0.5, 10_000), (4, 0.0, 100), (6, 0.5, None)], "id bigint, fraction double, elapsed_ms bigint")
    got = {r.job_id: r.eta and round(r.eta * 1.21, 6) for r in queue.time_left(items, progress=progress).collect()}
    # 4 s of work are too few to calibrate by; 20 s of work in 10 s halve what is left; not started, no credit
    assert (got[1], got[2], got[4]) == (4.0, 15.0, 10.0) and round(got[3], 6) == round(3.0 / 8**0.9 * 1.21, 6)
    assert {r.job_id for r in queue.time_left(items).where("eta IS NOT NULL").collect()} == {2}


def test_cached_prints_are_checked(spark):
    files = spark.createDataFrame([("/a", 1, 1, "0" * 63 + "1"), ("/b", 1, 1, "f" * 64), ("/c", 1, 1, None), ("/d", 1, 2, "0" * 64)], "path string, size bigint, mtime bigint, digits string")
    cache = spark.createDataFrame([("/a", "ahash", 1, 1, "0" * 63 + "2"), ("/b", "ahash", 1, 1, "not hex"), ("/c", "ahash", 1, 1, "0" * 63), ("/d", "ahash", 1, 1, "f" * 64)], "path string, algo string, size bigint, mtime bigint, hash string")
    got = sorted((r.path, r.fp0, r.fp3, r.hit) for r in near.cached_prints(files, cache, F.col("digits"), "ahash").collect())
    assert got == [("/a", 0, 2, True), ("/b", -1, -1, False), ("/d", 0, 0, False)]


def test_whole_files_are_looked_up_in_the_cache(spark):
    files = spark.createDataFrame([(p, 9, 1, c) for p, c in (("/a", b"ab12345yz"), ("/b", b"ab12345yz"), ("/c", b"ab99999yz"), ("/d", b"ab12345yz"))], "path string, size bigint, mtime bigint, content binary")
    cache = spark.createDataFrame([("/c", bits.FULL_HASH_ALGO, 9, 1, "same"), ("/d", bits.FULL_HASH_ALGO, 9, 1, "same"), ("/a", bits.FULL_HASH_ALGO, 9, 0, "old")], "path string, algo string, size bigint, mtime bigint, hash string")
    paths = lambda c: sorted((r.group_rank, r.path) for r in exact.groups(files, 2, c).collect())
    assert sorted(p for _, p in paths(cache)) == ["/a", "/b", "/c", "/d"] and len({g for g, _ in paths(cache)}) == 2
    assert [p for _, p in paths(None)] == ["/a", "/b", "/d"]
    hashed = exact.full_hashes(files, files, cache)
    groups = spark.createDataFrame([(1, 9), (2, 9)], "id bigint, reclaimable bigint")
    assert tuple(review.run_summary(groups, hashed).first()) == (2, 18, 4, 2)
    rows, hashed, puts = exact.cached_cascade(files, cache, 2)
    assert rows.count() == 4 and sorted((r.path, r.hit) for r in hashed.collect()) == [("/a", False), ("/b", False), ("/c", True), ("/d", True)]
    assert sorted(r.path for r in puts.collect()) == ["/a", "/b"]


def test_files_that_changed_since_they_were_listed_drop_out(spark):
    rows = [("/a", 4, b"abcd"), ("/b", 4, b"abcd"), ("/c", 4, b"abcde"), ("/d", 4, None), ("/e", 4, b"abc")]
    files = spark.createDataFrame([(p, n, 1, c) for p, n, c in rows], "path string, size bigint, mtime bigint, content binary")
    assert sorted(r.path for r in exact.groups(files).collect()) == ["/a", "/b"]
    s = exact.stage_counts(files).first()
    assert (s.candidates, s.after_size, s.errors, s.after_sample) == (5, 5, 3, 2)


def test_pages_of_groups_have_their_members(spark):
    groups = spark.createDataFrame([(1, "x", 5), (2, "y", 50), (3, "z", 5)], "id bigint, hash string, reclaimable bigint")
    m = spark.createDataFrame([(i, g, f"/{i}", 5, 1, 0, 1, None) for i, g in ((4, 3), (3, 1), (1, 1), (2, 2))], "id bigint, group_id bigint, path string, size bigint, mtime bigint, distance bigint, keep int, disposal string")
    page = lambda *a: [(r.id, [x.id for x in r.members]) for r in review.group_page(groups, m, *a).collect()]
    assert page() == [(2, [2]), (1, [1, 3]), (3, [4])] and page(1, 1) == [(1, [1, 3])]


def test_counters_of_states(spark):
    from cairnspark.streaming import bookkeeping

    s = spark.createDataFrame([(1, "done"), (2, "running"), (3, "pending"), (4, "failed"), (5, "skipped"), (6, "done")], "id bigint, status string")
    assert bookkeeping.counters(s).first().asDict() == {"done": 2, "skipped": 1, "failed": 1, "running": 1, "pending": 2}


MEMBER = "id bigint, group_id bigint, path string, size bigint, mtime bigint, keep int, disposal string"


def test_policies(spark):
    r, rows = random.Random(12), []
    for i in range(90):
        path = "/" + "/".join(r.choice("pqr") for _ in range(r.randint(1, 5))) + f"/{i % 4}"
        rows.append((i, i % 11, path, 10 + i % 11, r.randint(0, 6), 1, "trashed" if r.random() < 0.2 else None))
    m = spark.createDataFrame(rows, MEMBER)
    for policy, first in (("shallowest_path", lambda x: x[2].count("/")), ("oldest", lambda x: x[4])):
        best = {}
        for x in rows:
            rank = (first(x), x[2].split("/"), x[0])
            if x[6] is None and (x[1] not in best or rank < best[x[1]]):
                best[x[1]] = rank
        keepers = {rank[2] for rank in best.values()}
        after = review.apply_policy(m, policy)
        assert {x.id for x in after.where("keep = 1 AND disposal IS NULL").collect()} == keepers
        gone = [x for x in rows if x[6] is None and x[0] not in keepers]
        assert tuple(review.pending_removals(after).first()) == (len(gone), sum(x[3] for x in gone))
        plans = {p.group_id: ([x.id for x in p["keep"]], [x.id for x in p["remove"]]) for p in review.delete_plans(after).collect()}
        assert plans == {g: ([best[g][2]], sorted(x[0] for x in gone if x[1] == g)) for g in {x[1] for x in gone}}
        long = {(x.group_id, x.action, x.id) for x in review.delete_rows(after).collect()}
        assert long == {(g, a, i) for g, both in plans.items() for a, ids in zip(("keep", "remove"), both, strict=True) for i in ids}
    assert review.apply_policy(m, "manual").where("keep = 0").count() == 0


def test_deletes_are_careful(spark):
    rows = [(1, 1, "/k", 5, 1, 1, None), (2, 1, "/gone", 5, 1, 0, None), (3, 1, "/size", 5, 1, 0, None), (4, 1, "/time", 5, 1, 0, None), (5, 1, "/link", 5, 1, 0, None), (6, 1, "/ok", 5, 1, 0, None), (7, 2, "/no", 5, 1, 0, None), (8, 3, "/k", 5, 1, 0, None), (9, 3, "/k2", 5, 1, 1, None), (10, 3, "/k2", 5, 1, 0, None)]
    now = spark.createDataFrame([("/k", 5, 1, False), ("/size", 6, 1, False), ("/time", 5, 2, False), ("/link", 5, 1, True), ("/ok", 5, 1, False), ("/no", 5, 1, False)], "path string, size bigint, mtime bigint, is_symlink boolean")
    m = spark.createDataFrame(rows, MEMBER)
    got = review.decide_deletes(m, now)
    assert {r.id: r.note for r in got.collect()} == {2: "missing", 3: "size_changed", 4: "mtime_changed", 5: "symlink", 6: None, 7: "no_keeper", 8: None, 10: "also_kept"}
    s = review.apply_summary(got).first()
    assert (s.trashed, s.skipped, s.failed, s.reclaimed, s.notes) == (2, 6, 0, 10, "missing,size_changed,mtime_changed,symlink,no_keeper,also_kept")
    assert [r.id for r in review.record_disposals(m, got).where("disposal = 'trashed'").orderBy("id").collect()] == [6, 8]
    assert {r.note for r in review.decide_deletes(m, now, cancelled=True).collect()} == {"cancelled", "no_keeper"}


def test_names_are_given_in_order(spark):
    rows = [(1, "/s/a.heic", "/o/a.avif"), (2, "/s/a.jpg", "/o/a.avif"), (3, "/s/a-1.jpg", "/o/a-1.avif"), (4, "/s/a.png", "/o/a.avif"), (5, "/p/x", "/p/x"), (6, "/s/b", "/o2/b.avif"), (7, "/p/y", "/p/x")]
    t = spark.createDataFrame(rows, "id bigint, src string, dst string")
    assert [r.final for r in queue.resolve_names(t).orderBy("id").collect()] == ["/o/a.avif", "/o/a-1.avif", "/o/a-1-1.avif", "/o/a-2.avif", "/p/x", "/o2/b.avif", "/p/x-1"]
    taken = spark.createDataFrame([("/o2/b.avif",)], "dst string")
    assert [r.final for r in queue.resolve_names(t, taken).where("id = 6").collect()] == ["/o2/b-1.avif"]
    assert [r.final for r in queue.resolve_names(t, taken, "replace").where("id = 6").collect()] == ["/o2/b.avif"]


def _one_by_one(rows, disk, existing):
    """Names given out in the order of id, as a single process would."""
    used, out = set(), {}
    for i, src, dst in sorted(rows):
        name = dst
        if dst != src and (dst in used or existing == "rename" and dst in disk):
            folder, _, base = dst.rpartition("/")
            stem, dot, ext = base.rpartition(".") if "." in base[1:] else (base, "", "")
            name = None
            for n in range(1, 1000):
                tail = f"-{n}{dot}{ext}"
                c = f"{folder}/{stem.encode()[: 255 - len(tail.encode())].decode(errors='ignore')}{tail}"
                if c not in used and c not in disk:
                    name = c
                    break
        used.add(name)
        out[i] = name
    return out


def test_names_are_those_of_one_process(spark):
    r = random.Random(21)
    long = "ä" * 124
    stems = ["a", "a-1", "a-1-1", "a-2", "b", "b-07", ".c", "d.e", long, long + "x", long[:-2] + "-1"]
    for existing in ("rename", "replace"):
        rows = []
        for i in range(300):
            dst = f"/o{r.randint(0, 2)}/{r.choice(stems)}{r.choice(['.avif', '.avif', '.mp4', ''])}"
            rows.append((i, dst if r.random() < 0.05 else f"/s/{i}", dst))
        disk = {r.choice(rows)[2] for _ in range(12)} | {"/o0/a-3.avif", "/o9/z"}
        t = spark.createDataFrame(rows, "id bigint, src string, dst string")
        got = {x.id: x.final for x in queue.resolve_names(t, spark.createDataFrame([(d,) for d in disk], "dst string"), existing).collect()}
        assert got == _one_by_one(rows, disk, existing)


def test_names_run_out_loudly(spark):
    t = spark.range(1005).select("id", F.concat(F.lit("/s/"), F.col("id").cast("string")).alias("src"), F.lit("/o/a.avif").alias("dst"))
    got = {x.id: x.final for x in queue.resolve_names(t).collect()}
    assert got == {i: "/o/a.avif" if i == 0 else f"/o/a-{i}.avif" if i < 1000 else None for i in range(1005)}


def test_folds_are_in_order(spark):
    ddl = "seq bigint, type string, id bigint, dst_path string, dst_size bigint, elapsed_ms bigint, code string, msg string, reason string"
    r = spark.createDataFrame([(3, "started", 1, None, None, None, None, None, None), (1, "failed", 1, None, None, None, "io", "bad", None), (2, "requeued", 1, None, None, None, None, None, None), (1, "done", 2, "/o", 5, 7, None, None, None), (2, "started", 2, None, None, None, None, None, None), (1, "skipped", 3, None, None, None, None, None, "no_gain")], ddl)
    from cairnspark.plans.catalog import blank_items

    items = blank_items(r).unionByName(blank_items(r.limit(1)).withColumn("id", F.lit(9).cast("long")))
    got = {x.id: x for x in queue.fold_results(items, r).collect()}
    assert (got[1].status, got[1].error_code) == ("running", "io") and (got[2].status, got[2].dst_size) == ("done", 5) and (got[3].status, got[3].skip_reason) == ("skipped", "no_gain") and got[9].status == "pending"


def test_empty_kinds_take_nothing(spark):
    items = spark.createDataFrame([(1, 1, "/a", 1, 1, "image", "pending", 1.0)], "id bigint, job_id bigint, src_path string, src_size bigint, src_mtime bigint, kind string, status string, est_secs double")
    assert queue.take_pending(items, 1, [], 0).count() == 0 and queue.take_pending(items, 1, ["image"], 0).count() == 1 and queue.take_pending(items, 1, ["image"], 1).count() == 0


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v bigint")
    puts = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (1, "c", 7)], "seq bigint, k string, v bigint")
    assert sorted(tuple(r) for r in queue.upsert(old, puts, ["k"], "seq").collect()) == [("a", 6), ("b", 2), ("c", 7)]
    assert sorted(tuple(r) for r in queue.insert_or_ignore(old, puts, ["k"], "seq").collect()) == [(1, "c", 7)]


def test_prune_keeps_by_null_safe_id(spark):
    jobs = spark.createDataFrame([(1, "done"), (2, "running"), (3, "paused")], "id bigint, status string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(queue.prune_jobs(jobs, 3)) == [2, 3] and ids(queue.prune_jobs(jobs, None)) == [2]
    assert ids(queue.prune_runs(jobs)) == [3] and queue.prune_runs(jobs.limit(0)).count() == 0
    assert ids(queue.cascade_delete(jobs, "id", jobs.where("id = 1"))) == [1]


def test_roots(spark):
    r, roots = random.Random(31), ["/media/disk", "/media/disk/trips", "/media", "/archive/old"]
    paths = ["/".join(["", *(r.choice(["media", "disk", "trips", "archive", "old", "2020"]) for _ in range(r.randint(1, 5))), f"f{i}.png"]) for i in range(80)]
    df = spark.createDataFrame([(p,) for p in paths], "p string")

    def holders(p):
        return [x for x in roots if p.startswith(x + "/")]

    def mirrored(p):
        found = sorted(holders(p), key=lambda x: -x.count("/"))
        if not found:
            return "/mirror"
        return "/mirror/" + found[0].rpartition("/")[2] + p[len(found[0]) :].rpartition("/")[0]

    def bucket(p):
        if not (found := holders(p)):
            return p.rpartition("/")[0] or "/"
        inside = p[len(found[0]) + 1 :].split("/")
        return found[0] + ("/" + inside[0] if len(inside) > 1 else "")

    col = lambda c: [x[0] for x in df.select(c).collect()]
    assert col(scan.output_dir(F.col("p"), roots, "/mirror")) == [mirrored(p) for p in paths]
    assert col(scan.output_dir(F.col("p"), ["/media"], "/mirror")) == ["/mirror" + p[6:].rpartition("/")[0] if p.startswith("/media/") else "/mirror" for p in paths]
    assert col(scan.output_dir(F.col("p"), roots, None)) == [p.rpartition("/")[0] or "/" for p in paths]
    assert col(scan.bucket(F.col("p"), roots)) == [bucket(p) for p in paths]
    assert scan.job_name(["/m/one", "/n/two/", "/k/one", "/"]) == "one、two、/"


def test_top_dirs_fold_the_rest(spark):
    rows = [(f"/r/d{i:02d}/f", 100 - i) for i in range(20)] + [("/r/loose", 1000)]
    got = scan.top_dirs(spark.createDataFrame(rows, "path string, size bigint"), ["/r"]).orderBy("rank").collect()
    assert [r.path for r in got][:2] == ["/r", "/r/d00"] and len(got) == 9 and (got[-1].path, got[-1].dirs, got[-1].files) == ("", 13, 13)
    assert sum(r.bytes for r in got) == sum(s for _, s in rows)


def test_hard_links(spark):
    f = spark.createDataFrame([("/a-b", 1, 1, 2), ("/a/b", 1, 1, 2), ("/c", 1, 1, 1), ("/d", 1, 1, 1), ("/e/b", 2, 1, 2)], "path string, dev bigint, inode bigint, nlink bigint")
    assert sorted(r.path for r in scan.drop_hard_links(f).collect()) == ["/a/b", "/c", "/d", "/e/b"]


def test_row_numbers_are_those_of_a_sort(spark):
    from cairnspark.operators.ranking import descending, row_numbers

    r = random.Random(3)
    rows = [(i, r.choice([None, 1, 2, 2, 2, 2])) for i in range(300)]
    df = spark.createDataFrame(rows, "i bigint, x bigint").repartition(7)
    got = {x.i: x.rn for x in row_numbers(df, [descending("x"), "i"]).collect()}
    order = sorted(rows, key=lambda t: (t[1] is None, -(t[1] or 0), t[0]))
    assert got == {i: n + 1 for n, (i, _) in enumerate(order)}


def test_changes_may_come_late_and_twice(spark, tmp_path):
    from cairnspark.plans.catalog import blank_items
    from cairnspark.streaming import bookkeeping

    r = random.Random(8)
    kinds = ["started", "done", "failed", "skipped", "requeued"]
    rows = [(i, r.choice(kinds), r.randint(0, 9), f"/o{i}", i, i, f"c{i}", f"m{i}", f"r{i}") for i in range(120)]
    df = spark.createDataFrame(rows, bookkeeping.CHANGES)
    want = sorted(map(tuple, queue.fold_results(blank_items(df), df).collect()))
    model = {}
    for seq, kind, i, dst, size, ms, code, msg, reason in rows:
        s = model.setdefault(i, ["pending", None, None, None, None, None, None])
        if kind == "started":
            s[0] = "running" if s[0] == "pending" else s[0]
        elif kind == "requeued":
            s[0] = "pending"
        elif kind == "done":
            s[:] = ["done", None, dst, size, ms, None, None]
        elif kind == "failed":
            s[0], s[5], s[6] = "failed", code, msg
        else:
            s[0], s[1] = "skipped", reason
    assert want == sorted((i, *s) for i, s in model.items())
    late = df.unionByName(df.where("seq % 3 = 0")).withColumn("_at", -F.col("seq"))
    at = f"file://{tmp_path}/in"
    for k in range(3):
        late.where(f"seq % 3 = {2 - k}").drop("_at").coalesce(1).write.mode("append").parquet(at)
    bookkeeping.start(bookkeeping.read_changes(spark, at, 1), f"file://{tmp_path}/out", f"file://{tmp_path}/cp", availableNow=True).awaitTermination()
    assert sorted(map(tuple, bookkeeping.states(blank_items(df), f"file://{tmp_path}/out").collect())) == want


def test_sessions(spark, sf_dir):
    from cairnspark.plans import adapters, sessions

    tables = sessions.scan_session(adapters.media(spark, sf_dir), ["/vol"], 5)
    assert tables["items"].count() == tables["progress"].first().analyzed
    assert tables["kinds"].agg(F.sum("files")).first()[0] == tables["estimate"].first().files
    files = adapters.candidates(spark, sf_dir)
    members = cut(sessions.dedup_session(files))
    groups = members.select("group_id").distinct().count()
    assert groups > 0 and members.where("keep = 1").count() == groups
    after, summary = sessions.apply_session(members, files.select("path", "size", "mtime", F.lit(False).alias("is_symlink")))
    assert summary.first().trashed == members.count() - groups == after.where("disposal = 'trashed'").count()
    prints = spark.createDataFrame([("/a.jpg", 5, 1, 0), ("/b.png", 6, 1, 1), ("/c.cr2", 7, 1, 0), ("/d.jpg", 8, 1, -1)], "path string, size bigint, mtime bigint, fp0 bigint")
    near_members = sessions.dedup_session(prints, "perceptual", 4, ["fp0"]).collect()
    assert sorted((r.path, r.distance, r.keep) for r in near_members) == [("/a.jpg", 0, 1), ("/b.png", 1, 1)]
