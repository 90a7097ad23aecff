"""The work queue: pages, counts, state changes, recovery and the time that is left."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.functions import estimate as est
from cairnspark.functions.naming import fit
from cairnspark.functions.paths import file_name, is_temp_file, parent
from cairnspark.functions.policy import SKIP_REASONS
from cairnspark.plans.checkpoint import cut, shared_dir

PAGE_MAX = 500
STATUSES = ("pending", "running", "done", "skipped", "failed")
KINDS = ("image", "video", "audio")


def reasons(spark) -> DataFrame:
    """The skip reasons with their messages, in order."""
    rows = F.array(*(F.struct(F.lit(k).alias("skip_reason"), F.lit(m).alias("skip_message")) for k, m in SKIP_REASONS.items()))
    return spark.range(1).select(F.inline(rows))


def page(items: DataFrame, job_id: int, status: str | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of a job's items by id, with the message of each skip reason; an unknown reason has none."""
    rows = items.where(F.col("job_id") == job_id)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    columns = ["id", "src_path", "src_size", "kind", "status", "skip_reason", "dst_size", "elapsed_ms", "error_code", "error_msg"]
    cut = rows.select(*columns).orderBy("id").offset(offset).limit(min(limit, PAGE_MAX))
    return cut.join(F.broadcast(reasons(items.sparkSession)), "skip_reason", "left").select(*columns, "skip_message")


def take_pending(items: DataFrame, job_id: int, kinds: list[str], after_id: int, limit: int = 32, more: list[str] | None = None) -> DataFrame:
    """The next items to do after an id; no kinds, no items. more names further columns to take along."""
    rows = items.where((F.col("job_id") == job_id) & (F.col("status") == "pending") & (F.col("id") > after_id))
    rows = rows.where(F.col("kind").isin(*kinds)) if kinds else rows.where(F.lit(False))
    return rows.select("id", "src_path", "src_size", "src_mtime", "kind", "est_secs", *(more or [])).orderBy("id").limit(limit)


def count_items(items: DataFrame, job_id: int, status: str | None = None) -> DataFrame:
    rows = items.where(F.col("job_id") == job_id)
    return (rows if status is None else rows.where(F.col("status") == status)).agg(F.count("*").alias("n"))


def _sum_when(condition: Column, value: str, kind: str = "long") -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0).cast(kind))


def job_progress(items: DataFrame) -> DataFrame:
    """Counts by status and bytes of finished items, a row a job."""
    by = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    done = F.col("status") == "done"
    return items.groupBy("job_id").agg(F.count("*").alias("total"), *by, _sum_when(done, "src_size").alias("src_bytes"), _sum_when(done, "dst_size").alias("dst_bytes"))


def pending_work(items: DataFrame) -> DataFrame:
    """Estimated seconds that are left in each lane."""
    open_ = F.col("status").isin("pending", "running")
    video = F.col("kind") == "video"
    return items.groupBy("job_id").agg(_sum_when(open_ & video, "est_secs", "double").alias("video_secs"), _sum_when(open_ & ~video, "est_secs", "double").alias("light_secs"))


def queue_summary(items: DataFrame) -> DataFrame:
    """Bytes in and out of all that was looked at; what was left alone for no gain or low quality counts at its own size."""
    kept = (F.col("status") == "skipped") & F.col("skip_reason").isin("no_gain", "low_quality")
    done = F.col("status") == "done"
    out = F.when(done, F.col("dst_size")).when(kept, F.col("src_size"))
    return items.groupBy("job_id").agg(F.count_if(done).alias("written"), F.count_if(kept).alias("kept"), F.count_if(F.col("status") == "failed").alias("failed"), _sum_when(done | kept, "src_size").alias("src_bytes"), F.coalesce(F.sum(out), F.lit(0)).alias("dst_bytes"))


def size_report(items: DataFrame) -> DataFrame:
    """Finished files and bytes by kind and in all, with the output's share in percent."""
    g = items.where("status = 'done'").rollup("kind").agg(F.count("*").alias("files"), F.sum("src_size").alias("src_bytes"), F.sum("dst_size").alias("dst_bytes"))
    return g.select(F.coalesce("kind", F.lit("total")).alias("kind"), "files", "src_bytes", "dst_bytes", F.round(F.try_divide(F.col("dst_bytes") * 100.0, F.col("src_bytes")), 1).alias("percent"))


def skip_breakdown(items: DataFrame) -> DataFrame:
    g = items.where("status = 'skipped'").groupBy(F.coalesce("skip_reason", F.lit("?")).alias("reason"))
    return g.agg(F.count("*").alias("files"), F.sum("src_size").alias("bytes"))


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of new to append: the first of each key by order, without keys that exist."""
    value = F.struct(order, *[c for c in new.columns if c not in (*keys, order)])
    first = new.groupBy(*keys).agg(F.min(value).alias("_row")).select(*keys, "_row.*")
    return first.join(existing.select(*keys).distinct(), keys, "left_anti").select(*new.columns)


def upsert(existing: DataFrame, puts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """existing with puts over it, the last put of each key by order; existing rows are older than all puts.

    Ties of order go to the greatest row. Keys are reduced before the shuffle.
    """
    rest = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, F.lit(None).cast("long").alias("_at"), *rest)
    both = old.unionByName(puts.select(*keys, F.col(order).cast("long").alias("_at"), *rest))
    last = both.groupBy(*keys).agg(F.max(F.struct(F.coalesce("_at", F.lit(-(2**63)).cast("long")).alias("_at"), *rest)).alias("_row"))
    return last.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def feed(items: DataFrame, current: DataFrame, job_id: int, kinds: list[str], after_id: int, dst: Column, taken: DataFrame | None = None, limit: int = 32, existing: str = "rename") -> DataFrame:
    """The next batch of a job, each item with what becomes of it: id, src_path, kind, est_secs, action, reason, dst.

    Items are taken in the order of id. One whose source is gone or has changed is skipped for that; then one that the
    scan chose to skip is skipped for its reason; the others are dispatched to dst, made unique against each other and
    against taken. dst is a column over src_path and kind. An item without a free name is failed.
    """
    why = items.where(F.col("job_id") == job_id).select("id", "skip_reason")
    return decide_batch(take_pending(items, job_id, kinds, after_id, limit).join(why, "id"), current, dst, taken, existing)


def decide_batch(batch: DataFrame, current: DataFrame, dst: Column, taken: DataFrame | None = None, existing: str = "rename") -> DataFrame:
    """What becomes of a batch of items (as take_pending() gives them, and skip_reason): the rows of feed()."""
    # the batch is written down: naming looks at it many times, and must not read the whole queue for each
    checked = cut(source_check(batch, current).withColumn("reason", F.coalesce("problem", "skip_reason")).withColumn("dst", dst))
    named = resolve_names(checked.where("reason IS NULL").select("id", F.col("src_path").alias("src"), "dst"), taken, existing).select("id", F.lit(True).alias("_go"), "final")
    action = F.when(F.col("_go").isNull(), "skip").when(F.col("final").isNull(), "fail").otherwise("dispatch")
    return checked.join(named, "id", "left").select("id", "src_path", "kind", "est_secs", action.alias("action"), "reason", F.col("final").alias("dst"))


def preserve_originals(items: DataFrame, mirror: Column) -> DataFrame:
    """src_path, dst and transformed of the whole output tree: outputs that were written, and a copy of every source that
    was left alone or whose output wasn't taken, at mirror, a column over src_path. Failed and open items have no row."""
    done, skipped = F.col("status") == "done", F.col("status") == "skipped"
    return items.where(done | skipped).select("src_path", F.when(done, F.col("dst_path")).otherwise(mirror).alias("dst"), done.alias("transformed"))


def quality_report(items: DataFrame, scores: DataFrame) -> DataFrame:
    """id, name, percent of its source's size and score of every written item; scores (id, window, score) are averaged,
    and items without one have a null."""
    mean = scores.groupBy("id").agg(F.avg("score").alias("score"), F.count("score").alias("windows"))
    rows = items.where("status = 'done'").join(mean, "id", "left")
    percent = F.round(F.try_divide(F.col("dst_size") * 100.0, F.col("src_size")), 1)
    return rows.select("id", file_name(F.col("src_path")).alias("name"), percent.alias("percent"), "score", F.coalesce("windows", F.lit(0).cast("long")).alias("windows"))


def orphan_temps(items: DataFrame, dirs: DataFrame, found: DataFrame) -> DataFrame:
    """Paths of found (path) that a crash left: temporary files in the folders that running items would have written to."""
    where = orphan_dirs(items, dirs).withColumnRenamed("dst_dir", "_dir")
    return found.where(is_temp_file(file_name(F.col("path")))).join(where, parent(F.col("path")) == F.col("_dir"), "left_semi")


def recover_all(jobs: DataFrame, items: DataFrame, dirs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, items, files to delete) after a crash. What was running is read before it is made pending again."""
    return recover_jobs(jobs), recover(items), orphan_temps(items, dirs, found)


def cached_probe(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files with probe_json and hit: a hit has the path, size and mtime of the cache and JSON that can be read."""
    c = cache.select("path", "size", "mtime", F.col("probe_json").alias("_json"))
    ok = F.col("_json").isNotNull() & F.get_json_object("_json", "$").isNotNull()
    return files.join(c, ["path", "size", "mtime"], "left").withColumn("hit", ok).withColumn("probe_json", F.when(ok, F.col("_json"))).drop("_json")


def source_check(claimed: DataFrame, current: DataFrame) -> DataFrame:
    """claimed with problem: src_missing, src_changed or null, against what is there now (path, size, mtime)."""
    now = current.select(F.col("path").alias("src_path"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.lit(True).alias("_there"))
    changed = (F.col("_size") != F.col("src_size")) | (F.col("_mtime") != F.col("src_mtime"))
    return claimed.join(now, "src_path", "left").withColumn("problem", F.when(F.col("_there").isNull(), "src_missing").when(changed, "src_changed")).drop("_size", "_mtime", "_there")


# --- state changes of the whole table -----------------------------------------------------------------------------


def recover(items: DataFrame) -> DataFrame:
    """After a crash: what ran is pending again, one attempt more."""
    ran = F.col("status") == "running"
    return items.withColumn("attempt", F.when(ran, F.col("attempt") + 1).otherwise(F.col("attempt"))).withColumn("status", F.when(ran, "pending").otherwise(F.col("status")))


def recover_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("status", F.when(F.col("status") == "running", "paused").otherwise(F.col("status")))


def running_items(items: DataFrame) -> DataFrame:
    return items.where("status = 'running'").select("job_id", "src_path")


def release(items: DataFrame, job_id: int) -> DataFrame:
    """After a stop on purpose: as recover, but it was no attempt."""
    ran = (F.col("status") == "running") & (F.col("job_id") == job_id)
    return items.withColumn("status", F.when(ran, "pending").otherwise(F.col("status")))


def retry_failed(items: DataFrame, job_id: int) -> DataFrame:
    again = (F.col("status") == "failed") & (F.col("job_id") == job_id)
    clear = {c: F.when(~again, F.col(c)) for c in ("error_code", "error_msg")}
    return items.withColumns({**clear, "status": F.when(again, "pending").otherwise(F.col("status"))})


def set_job_status(jobs: DataFrame, job_id: int, status: str, now: int) -> DataFrame:
    """finished_at is set with done and failed, and else left as it is."""
    mine = F.col("id") == job_id
    end = F.when(mine & F.lit(status in ("done", "failed")), F.lit(now).cast("long")).otherwise(F.col("finished_at"))
    return jobs.withColumns({"finished_at": end, "status": F.when(mine, status).otherwise(F.col("status"))})


def set_run_status(runs: DataFrame, run_id: int, status: str, now: int) -> DataFrame:
    """Of duplicate runs: finished_at is set with done and cancelled, and else taken away."""
    mine = F.col("id") == run_id
    end = F.when(mine, F.lit(now if status in ("done", "cancelled") else None).cast("long")).otherwise(F.col("finished_at"))
    return runs.withColumns({"finished_at": end, "status": F.when(mine, status).otherwise(F.col("status"))})


def prune_jobs(jobs: DataFrame, keep: int | None) -> DataFrame:
    """Jobs that stay: those that run, and keep; without keep only those that run."""
    return jobs.where((F.col("status") == "running") | F.col("id").eqNullSafe(F.lit(keep).cast("long")))


def prune_runs(runs: DataFrame) -> DataFrame:
    """The last duplicate run stays."""
    return runs.join(F.broadcast(runs.agg(F.max("id").alias("id"))), "id", "left_semi")


def cascade_delete(children: DataFrame, key: str, parents: DataFrame, parent_key: str = "id") -> DataFrame:
    """children whose parent still is there."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")


def resumable_job(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """The last job that was running or paused and has pending items: at most one row."""
    waiting = items.where("status = 'pending'").select(F.col("job_id").alias("id"))
    return jobs.where(F.col("status").isin("running", "paused")).join(waiting, "id", "left_semi").orderBy(F.desc("id")).limit(1)


def finish_status(items: DataFrame) -> DataFrame:
    """The status of each job after a pass: paused if anything is pending still, else done."""
    return items.groupBy("job_id").agg(F.when(F.count_if(F.col("status") == "pending") > 0, "paused").otherwise("done").alias("status"))


def resume_frame(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """The progress of the job that can be resumed: at most one row."""
    job = resumable_job(jobs, items).select(F.col("id").alias("job_id"), "name")
    return job.join(job_progress(items.join(F.broadcast(job.select("job_id")), "job_id", "left_semi")), "job_id")


def read_through(files: DataFrame, cache: DataFrame, probed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with probe_json, the cache after): misses take what a probe gave (path, probe_json) and are cached.

    A probe that failed gives a null, which is cached, too, as an empty object.
    """
    looked = cached_probe(files, cache)
    new = looked.where("NOT hit").drop("probe_json").join(probed.select("path", "probe_json"), "path", "left").withColumn("probe_json", F.coalesce("probe_json", F.lit("{}")))
    all_rows = looked.where("hit").unionByName(new.select(looked.columns))
    puts = new.select("path", "size", "mtime", "probe_json", F.lit(1).cast("long").alias("at"))
    return all_rows, upsert(cache.select("path", "size", "mtime", "probe_json"), puts, ["path"], "at")


def orphan_dirs(items: DataFrame, dirs: DataFrame) -> DataFrame:
    """Folders to look through for temporary files after a crash: those that running items would have written to."""
    return running_items(items).join(dirs, ["job_id", "src_path"]).select("dst_dir").distinct()


# --- folds --------------------------------------------------------------------------------------------------------


def change_marks(results: DataFrame) -> DataFrame:
    """The last change of each kind that decides a column, a row an id: what fold_results needs of all changes.

    Maxima, so changes may come in any order and more than once, and a stream of changes is reduced the same way.
    """
    kind = F.col("type")

    def last(kinds: tuple[str, ...], *fields: str) -> Column:
        return F.max(F.when(kind.isin(*kinds), F.struct("seq", *fields)))

    return results.groupBy("id").agg(
        last(("done", "failed", "skipped", "requeued"), "type").alias("_set"), last(("started",)).alias("_started"), last(("done", "skipped"), "type", "reason").alias("_reason"),
        last(("done",), "dst_path", "dst_size", "elapsed_ms").alias("_done"), last(("done", "failed"), "type", "code", "msg").alias("_error"),
    )


def apply_marks(items: DataFrame, marks: DataFrame) -> DataFrame:
    """items with the changes applied that marks stand for."""
    both = items.join(marks, "id", "left")
    base = F.when(F.col("_set").isNull(), F.col("status")).when(F.col("_set.type") == "requeued", "pending").otherwise(F.col("_set.type"))
    begun = F.col("_started").isNotNull() & (F.col("_started.seq") > F.coalesce(F.col("_set.seq"), F.lit(-(2**63)).cast("long"))) & (base == "pending")

    def over(mark: str, new: Column, old: str) -> Column:
        return F.when(F.col(mark).isNotNull(), new).otherwise(F.col(old)).alias(old)

    new = {
        "status": F.when(begun, "running").otherwise(base).alias("status"),
        "skip_reason": over("_reason", F.when(F.col("_reason.type") == "skipped", F.col("_reason.reason")), "skip_reason"),
        **{c: over("_done", F.col(f"_done.{c}"), c) for c in ("dst_path", "dst_size", "elapsed_ms")},
        **{c: over("_error", F.when(F.col("_error.type") == "failed", F.col(f"_error.{f}")), c) for c, f in (("error_code", "code"), ("error_msg", "msg"))},
    }
    return both.select(*[new.get(c, F.col(c)) for c in items.columns])


def fold_results(items: DataFrame, results: DataFrame) -> DataFrame:
    """items with all changes applied in the order of seq.

    started counts only for pending items; done clears reason and error; failed leaves the output as it was; skipped sets
    the reason; requeued makes an item pending again. What each column ends as depends on the last change of a few kinds
    alone, so changes are reduced to those before the shuffle, and no item's changes are ever gathered.
    """
    return apply_marks(items, change_marks(results))


def time_left(items: DataFrame, hardware: bool = False, gates: tuple[int, int] = (2, 8), progress: DataFrame | None = None) -> DataFrame:
    """eta seconds of every job, null when nothing is pending: estimates of open items, scaled by how finished ones ran.

    progress (id, fraction, elapsed_ms; a row an id) tells how far running items are. What they have done is no longer
    left and counts, with the time it took, as finished work; and a job whose last items run still has time left.
    """
    if progress is not None:
        far = progress.select("id", F.when((F.col("fraction") > 0) & F.col("elapsed_ms").isNotNull(), F.col("fraction").cast("double")).alias("_part"), F.col("elapsed_ms").alias("_spent"), F.lit(True).alias("_flies"))
        items = items.join(far, "id", "left")
    else:
        items = items.withColumns({"_part": F.lit(None).cast("double"), "_spent": F.lit(None).cast("long"), "_flies": F.lit(None).cast("boolean")})
    flies = (F.col("status") == "running") & F.col("_flies")
    part = F.when(flies, F.col("_part"))
    items = items.withColumns({"_done_est": F.coalesce(F.col("est_secs") * part, F.lit(0.0)), "_done_ms": F.when(part.isNotNull(), F.col("_spent")).otherwise(0)})
    video, open_, done = F.col("kind") == "video", F.col("status").isin("pending", "running"), F.col("status") == "done"
    sums = [F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(flies).alias("flying")]
    for lane, mine in (("video", video), ("light", ~video)):
        half, spent = _sum_when(mine, "_done_est", "double"), _sum_when(mine, "_done_ms")
        sums += [(_sum_when(open_ & mine, "est_secs", "double") - half).alias(f"{lane}_rem"), (_sum_when(done & mine, "est_secs", "double") + half).alias(f"{lane}_did"), ((_sum_when(done & mine, "elapsed_ms") + spent) / 1000.0).alias(f"{lane}_act")]
    g = items.groupBy("job_id").agg(*sums)
    left = {lane: est.calibrated(F.col(f"{lane}_rem"), F.col(f"{lane}_did"), F.col(f"{lane}_act")) for lane in ("video", "light")}
    wall = est.wall_seconds(left["video"], left["light"], hardware, gates)
    return g.select("job_id", "pending", F.when((F.col("pending") + F.col("flying") > 0) & (wall > 0), wall).alias("eta"))


#: Highest number that is put behind a name. More equal names than that are a sign of something else gone wrong.
LAST_SUFFIX = 999
_NAME_BYTES = 255


def name_family(dst: Column) -> Column:
    """What two names must share so that one, with numbers behind it, may meet the other: the folder, the extension, and the
    stem without numbers (its first 60 characters, as long names are cut)."""
    folder, base = F.regexp_extract(dst, r"(?s)^(.*/)?([^/]*)\z", 1), F.regexp_extract(dst, r"(?s)^(.*/)?([^/]*)\z", 2)
    stem, ext = F.regexp_extract(base, r"(?s)^(.+?)(\.[^.]*)?\z", 1), F.regexp_extract(base, r"(?s)^(.+?)(\.[^.]*)?\z", 2)
    return F.struct(folder.alias("folder"), F.substring(F.regexp_replace(stem, r"(-[0-9]{1,3})+\z", ""), 1, 60).alias("stem"), ext.alias("ext"))


def _numbered(dst: str, n: int) -> str:
    """dst with -n before its extension, cut to the longest name that a file may have."""
    folder, slash, base = dst.rpartition("/")
    stem, dot, ext = base.rpartition(".") if "." in base[1:] else (base, "", "")
    tail = f"-{n}{dot}{ext}"
    return f"{folder}{slash}{stem.encode()[: _NAME_BYTES - len(tail.encode())].decode(errors='ignore')}{tail}"


def met_names(names: DataFrame) -> DataFrame:
    """dst of the names that may meet another's numbered ones: from family, dst, n (claims), old (lies there) and clash.

    A name that is numbered gets at most as many numbers as it has claims, besides those that other names hold. So it meets
    a name with the number k behind it only if k is no more than its claims and such names together. A name that meets one
    before it may be numbered for that, so its own followers meet it, too. Names so long that numbers cut them may meet any
    of their family.
    """
    base = F.regexp_extract("dst", r"(?s)^(.*/)?([^/]*)\z", 2)
    stem, ext = F.regexp_extract(base, r"(?s)^(.+?)(\.[^.]*)?\z", 1), F.regexp_extract(base, r"(?s)^(.+?)(\.[^.]*)?\z", 2)
    number = F.regexp_extract(stem, r"(?s)^.+-([1-9][0-9]{0,2})\z", 1)
    before = F.concat(F.regexp_extract("dst", r"(?s)^(.*/)?([^/]*)\z", 1), F.regexp_extract(stem, r"(?s)^(.+)-[1-9][0-9]{0,2}\z", 1), ext)
    follows = names.withColumn("k", F.when(number != "", number.cast("int"))).withColumn("before", before).where("k IS NOT NULL").select("dst", "k", "before")
    lead = names.join(follows.groupBy(F.col("before").alias("dst")).agg(F.count("*").alias("followers")), "dst")
    second = follows.select("dst", F.lit(True).alias("second"))  # it may be numbered for the name before it
    lead = lead.join(second, "dst", "left").where("n > 0 AND (clash OR second)")
    pairs = follows.join(lead.select(F.col("dst").alias("before"), (F.col("n") + F.col("followers")).alias("reach")), "before").where("k <= reach")
    several = names.groupBy("family").agg(F.count("*").alias("names"), F.max(F.octet_length(base)).alias("most")).where((F.col("names") > 1) & (F.col("most") > _NAME_BYTES - len(f"-{LAST_SUFFIX}")))
    return pairs.select("dst").union(pairs.select("before")).union(names.join(several, "family").select("dst")).distinct()


def resolve_names(targets: DataFrame, taken: DataFrame | None = None, existing: str = "rename") -> DataFrame:
    """targets (id, src, dst; ids differ) with final: dst, or dst-1, dst-2, ... where it is taken, in the order of id.

    taken (dst) is what lies there already: with existing "rename" it is as good as given out, with "replace" it may be
    overwritten under its own name, but never under a numbered one. A file that replaces its source keeps its name.
    final is null where all numbers up to LAST_SUFFIX are taken: such files have no output, and must be reported.

    A name is numbered if it is claimed twice or lies there, so a file's number is its rank by id, unless a numbered name is
    a target, or lies there, itself. Only such names (met_names) are walked through, a task for each family, and of equal
    targets those after the first LAST_SUFFIX + 1 are never gathered.
    """
    if existing not in ("rename", "replace"):
        raise ValueError(f"existing is rename or replace, not {existing}")
    rows = targets.select("id", "src", "dst", name_family(F.col("dst")).alias("family"), (F.col("src").eqNullSafe(F.col("dst"))).alias("itself"))
    old = (taken.select("dst") if taken is not None else rows.select("dst").limit(0)).distinct().withColumn("family", name_family(F.col("dst")))
    both = rows.select("family", "dst", F.lit(1).alias("n"), F.lit(0).alias("old")).unionByName(old.select("family", "dst", F.lit(0).alias("n"), F.lit(1).alias("old")))
    names = both.groupBy("family", "dst").agg(F.sum("n").alias("n"), F.max("old").alias("old")).withColumn("clash", (F.col("n") > 1) | (F.col("n") > 0) & (F.col("old") > 0))
    names = cut(names)
    met = cut(met_names(names))
    kinds = names.join(met, "dst", "left_anti").where("clash").select("dst", "old")
    plain = rows.join(met, "dst", "left_anti")
    alone = plain.join(kinds.select("dst"), "dst", "left_anti").select("id", "src", "dst", F.col("dst").alias("final"))

    equal = plain.join(kinds, "dst")
    kept = equal.where("itself").select("id", "src", "dst", F.col("dst").alias("final"))
    place = F.row_number().over(Window.partitionBy("dst").orderBy("id"))
    first = equal.where("NOT itself").withColumn("place", place).where(F.col("place") <= LAST_SUFFIX + 1)
    own = equal.where("itself").groupBy("dst").agg(F.min("id").alias("own_id"))
    lead = first.where("place = 1").join(own, "dst", "left").select("dst", ((F.col("old") > 0) & F.lit(existing == "rename") | F.coalesce(F.col("own_id") < F.col("id"), F.lit(False))).alias("held"))
    given = first.join(lead, "dst").withColumn("number", F.col("place") - F.when(F.col("held"), 0).otherwise(1)).where(F.col("number") <= LAST_SUFFIX)
    base = F.regexp_extract("dst", r"(?s)^(.*/)?([^/]*)\z", 2)
    stem, ext = F.regexp_extract(base, r"(?s)^(.+?)(\.[^.]*)?\z", 1), F.regexp_extract(base, r"(?s)^(.+?)(\.[^.]*)?\z", 2)
    tail = F.concat(F.lit("-"), F.col("number").cast("string"), ext)
    final = F.when(F.col("number") == 0, F.col("dst")).otherwise(F.concat(F.regexp_extract("dst", r"(?s)^(.*/)?([^/]*)\z", 1), fit(stem, tail)))
    given = given.select("id", "src", "dst", final.alias("final"))
    late = equal.where("NOT itself").join(given.select("id"), "id", "left_anti").select("id", "src", "dst", F.lit(None).cast("string").alias("final"))

    if met.isEmpty():
        return alone.unionByName(kept).unionByName(given).unionByName(late)
    theirs = rows.join(met, "dst")
    ranked = theirs.where("NOT itself").withColumn("place", place)
    hard = ranked.where(F.col("place") <= LAST_SUFFIX + 1).drop("place").unionByName(theirs.where("itself")).select("id", "src", "dst", "family", F.lit(False).alias("old"))
    over = ranked.where(F.col("place") > LAST_SUFFIX + 1).select("id", "src", "dst", F.lit(None).cast("string").alias("final"))
    there = old.join(met, "dst").select(F.lit(-1).cast("long").alias("id"), F.lit("").alias("src"), "dst", "family", F.lit(True).alias("old"))

    def give(pdf):
        disk = set(pdf.loc[pdf["old"], "dst"])
        todo = pdf[~pdf["old"]].sort_values("id").reset_index(drop=True)
        used, last, out = set(), {}, []
        for src, dst in zip(todo["src"], todo["dst"], strict=True):
            name = dst
            if dst != src and (dst in used or existing == "rename" and dst in disk):
                numbers = range(last.get(dst, 0) + 1, LAST_SUFFIX + 1)
                n = next((k for k in numbers if (c := _numbered(dst, k)) not in used and c not in disk), LAST_SUFFIX + 1)
                last[dst], name = n, _numbered(dst, n) if n <= LAST_SUFFIX else None
            used.add(name)
            out.append(name)
        todo["final"] = out
        return todo[["id", "src", "dst", "final"]].astype({"id": "int64"})

    walked = hard.unionByName(there).groupBy("family").applyInPandas(give, "id bigint, src string, dst string, final string")
    return alone.unionByName(kept).unionByName(given).unionByName(late).unionByName(over).unionByName(walked)


def run_job(items: DataFrame, current: DataFrame, job_id: int, dst: Column, work, batch: int = 100_000, stopped=lambda: False) -> tuple[DataFrame, str]:
    """(items, status) after passes over a job's pending items, batch by batch, until none is left or stopped() says so.

    work gets what feed() dispatches and returns changes (of types done, failed or skipped) for it; what feed() skips or
    fails is noted here. What is still pending makes the job paused, else it is done.

    Pending items are written down once, clustered, so a batch opens only the files that it lies in; an item behind the
    cursor is never looked at again, so each batch only writes its changes, and all are folded in at the end. The first has
    batch items, each further one twice as many as the one before: passes, each of which looks at all of current, grow with
    the logarithm of the queue. stopped() is asked on the driver, between them.
    """
    from cairnspark.operators import clustered

    spark, after = items.sparkSession, -(2**63)
    folder = f"{shared_dir(spark)}/job-{uuid.uuid4().hex}"
    clustered.write(items.where((F.col("job_id") == job_id) & (F.col("status") == "pending")), f"{folder}/queue", min(batch, clustered.FILE_ROWS))
    none, done, taken = F.lit(None).cast("string"), 0, 0
    while not stopped():
        rows = clustered.pending_range(spark, f"{folder}/queue", job_id, list(KINDS), after, taken, batch << done)
        fed = cut(decide_batch(rows.select("id", "src_path", "src_size", "src_mtime", "kind", "est_secs", "skip_reason"), current, dst))
        last, n = fed.agg(F.max("id"), F.count("*")).first()
        if last is None:
            break
        taken += n
        left = fed.where("action <> 'dispatch'").select(
            F.lit(0).cast("long").alias("seq"), F.when(F.col("action") == "skip", "skipped").otherwise("failed").alias("type"), "id", none.alias("dst_path"), F.lit(None).cast("long").alias("dst_size"),
            F.lit(None).cast("long").alias("elapsed_ms"), F.when(F.col("action") == "fail", "other").alias("code"), F.when(F.col("action") == "fail", "no free name").alias("msg"), "reason",
        )
        left.unionByName(work(fed.where("action = 'dispatch'"))).write.parquet(f"{folder}/changes/batch={done}")
        after, done = last, done + 1
    if done:
        items = cut(fold_results(items, spark.read.parquet(*(f"{folder}/changes/batch={k}" for k in range(done)))))
    pending = items.where((F.col("job_id") == job_id) & (F.col("status") == "pending"))
    return items, "done" if pending.isEmpty() else "paused"


def lower_median(df: DataFrame, column: str) -> Column:
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column})")


def compare_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """path and verdict of a full comparison: missing, extra, size_differs, hash_differs or same."""
    m = manifest.select("path", F.col("size").alias("m_size"), F.col("hash").alias("m_hash"), F.lit(True).alias("m"))
    f = found.select("path", F.col("size").alias("f_size"), F.col("hash").alias("f_hash"), F.lit(True).alias("f"))
    verdict = F.when(F.col("f").isNull(), "missing").when(F.col("m").isNull(), "extra").when(F.col("m_size") != F.col("f_size"), "size_differs").when(F.col("m_hash") != F.col("f_hash"), "hash_differs").otherwise("same")
    return m.join(f, "path", "full_outer").select("path", verdict.alias("verdict"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by order, reduced before the shuffle."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_row")).select(key, "_row.*").select(*df.columns)
