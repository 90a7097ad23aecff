"""Reviewing duplicate groups: which copy stays, what would go, and what became of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.functions.paths import depth, path_key
from cairnspark.operators.ranking import one_row

POLICIES = ("shallowest_path", "oldest", "manual")
NOTES = 20


def neutral(exact: DataFrame, near: DataFrame) -> DataFrame:
    """Exact and near groups (with seed_print) in one shape: mode, group_hash, path, size, distance.

    A near group's hash is the hex of its seed's print, which no other seed can have.
    """
    a = exact.select(F.lit("exact").alias("mode"), F.col("hash").alias("group_hash"), "path", "size", F.lit(0).cast("long").alias("distance"))
    return a.unionByName(near.select(F.lit("perceptual").alias("mode"), F.col("seed_print").alias("group_hash"), "path", "size", "distance"))


def group_page(groups: DataFrame, members: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of groups (id, hash, reclaimable), those that free most first, each with its members by id in one array."""
    page = groups.select("id", "hash", "reclaimable").orderBy(F.desc("reclaimable"), "id").offset(offset).limit(limit)
    fields = ["id", "path", "size", "mtime", "distance", "keep", "disposal"]
    inside = members.join(F.broadcast(page.select(F.col("id").alias("group_id"))), "group_id").groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("members"))
    full = page.join(inside, page["id"] == inside["group_id"], "left").select(page["id"], "hash", "reclaimable", F.coalesce("members", F.array()).alias("members"))
    return full.orderBy(F.desc("reclaimable"), "id")


def run_summary(groups: DataFrame, hashed: DataFrame) -> DataFrame:
    """One row: groups, the bytes they could free, files hashed (path, hit), and how many hashes were cached."""
    return one_row(
        groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("reclaimable"), F.lit(0)).cast("long").alias("reclaimable")),
        hashed.agg(F.count("*").alias("hashed"), F.count_if("hit").alias("cache_hits")),
    )


def apply_policy(members: DataFrame, policy: str) -> DataFrame:
    """members (id, group_id, path, mtime, disposal) with keep decided anew for all that still are there.

    shallowest_path keeps the path with the fewest components, oldest that with the smallest mtime; ties go by path.
    manual keeps all. Members that are gone keep their mark and are no candidates.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    here = F.col("disposal").isNull()
    if policy == "manual":
        return members.withColumn("keep", F.when(here, 1).otherwise(F.col("keep")))
    first = depth(F.col("path")) if policy == "shallowest_path" else F.col("mtime")
    # the least of each group, summed up before the shuffle, and back by id: a huge group is no huge task
    best = members.where(here).groupBy("group_id").agg(F.min(F.struct(first, path_key(F.col("path")), F.col("id").alias("id"))).alias("_best"))
    keepers = best.select(F.col("_best.id").alias("id"), F.lit(True).alias("_keeper"))
    return members.join(keepers, "id", "left").withColumn("keep", F.when(~here, F.col("keep")).when(F.col("_keeper"), 1).otherwise(0)).select(*members.columns)


def set_keep(members: DataFrame, changes: DataFrame) -> DataFrame:
    """members with the keep marks of changes (id, keep)."""
    return members.join(changes.select("id", F.col("keep").alias("_keep")), "id", "left").withColumn("keep", F.coalesce("_keep", "keep")).drop("_keep")


def pending_removals(members: DataFrame) -> DataFrame:
    """One row: files and bytes that are marked to go and still are there."""
    gone = (F.col("keep") == 0) & F.col("disposal").isNull()
    return members.agg(F.count_if(gone).alias("files"), F.coalesce(F.sum(F.when(gone, F.col("size"))), F.lit(0)).alias("bytes"))


def delete_rows(members: DataFrame) -> DataFrame:
    """What still is there of groups that would lose a member, a row a member: group_id, action (keep or remove), id, path,
    size, mtime. Groups of any size."""
    here = members.where("disposal IS NULL")
    loses = here.where("keep = 0").select("group_id").distinct()
    action = F.when(F.col("keep") == 1, "keep").otherwise("remove")
    return here.join(loses, "group_id", "left_semi").select("group_id", action.alias("action"), "id", "path", "size", "mtime")


def delete_plans(members: DataFrame) -> DataFrame:
    """delete_rows with a row a group, which must fit in a task: group_id, keep and remove (arrays of id, path, size, mtime) of groups that would lose a member."""
    item = F.struct("id", "path", "size", "mtime")
    here = members.where("disposal IS NULL")
    g = here.groupBy("group_id").agg(F.sort_array(F.collect_list(F.when(F.col("keep") == 1, item))).alias("keep"), F.sort_array(F.collect_list(F.when(F.col("keep") == 0, item))).alias("remove"))
    return g.where(F.size("remove") > 0)


def decide_deletes(members: DataFrame, current: DataFrame, cancelled: bool = False) -> DataFrame:
    """id, group_id, size, outcome (trashed or skipped) and note of every member marked to go.

    current is what is there now: path, size, mtime, is_symlink. A group without a keeper loses nothing, nor does a path
    that the group itself keeps; then what is missing, a link or changed is left alone. Nothing is deleted here.
    """
    here = members.where("disposal IS NULL")
    kept = here.where("keep = 1").select("group_id").distinct().withColumn("_keeper", F.lit(True))
    kept_paths = here.where("keep = 1").select("group_id", "path").distinct().withColumn("_kept", F.lit(True))
    now = current.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), "is_symlink", F.lit(True).alias("_there"))
    rows = here.where("keep = 0").join(kept, "group_id", "left").join(kept_paths, ["group_id", "path"], "left").join(now, "path", "left")
    note = (
        F.when(F.col("_keeper").isNull(), "no_keeper").when(F.lit(cancelled), "cancelled").when(F.col("_kept").isNotNull(), "also_kept").when(F.col("_there").isNull(), "missing")
        .when(F.col("is_symlink"), "symlink").when(F.col("_size") != F.col("size"), "size_changed").when(F.col("_mtime") != F.col("mtime"), "mtime_changed")
    )
    return rows.withColumn("note", note).select("id", "group_id", "path", "size", F.when(F.col("note").isNull(), "trashed").otherwise("skipped").alias("outcome"), "note")


def disposal(outcome):
    """What a member's row records: skipped ones stay as they are."""
    return F.when(outcome.isin("trashed", "failed"), outcome)


def record_disposals(members: DataFrame, outcomes: DataFrame) -> DataFrame:
    new = outcomes.select("id", disposal(F.col("outcome")).alias("_new"))
    return members.join(new, "id", "left").withColumn("disposal", F.coalesce("_new", "disposal")).drop("_new")


def apply_summary(outcomes: DataFrame) -> DataFrame:
    """One row: trashed, skipped, failed, reclaimed bytes (of trashed ones), and the first distinct notes in id order."""
    done = F.col("outcome") == "trashed"
    one = outcomes.agg(F.count_if(done).alias("trashed"), F.count_if(F.col("outcome") == "skipped").alias("skipped"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.coalesce(F.sum(F.when(done, F.col("size"))), F.lit(0)).alias("reclaimed"))
    first = outcomes.where("note IS NOT NULL").groupBy("note").agg(F.min("id").alias("at")).orderBy("at").limit(NOTES)
    notes = first.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "note"))), lambda x: x["note"]), ",").alias("notes"))
    return one_row(one, notes)
