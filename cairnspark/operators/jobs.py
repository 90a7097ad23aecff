"""Rows of jobs and of searches for duplicates: how they begin, what is noted on them, and how they go."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.functions.paths import path_key
from cairnspark.functions.policy import Profile
from cairnspark.operators.queue import cascade_delete, prune_jobs, set_job_status
from cairnspark.operators.ranking import row_numbers
from cairnspark.operators.scan import job_name

JOBS = "id bigint, name string, roots_json string, output_root string, profile_json string, status string, created_at bigint, finished_at bigint, est_out_bytes bigint"
RUNS = "id bigint, roots_json string, mode string, status string, threshold int, created_at bigint, finished_at bigint"


def create_job(spark: SparkSession, job_id: int, roots: list[str], profile: Profile, now: int, output_root: str | None = None) -> DataFrame:
    """The row of a new job. It holds its settings as they are now, so that later changes don't touch it."""
    row = (job_id, job_name(roots), json.dumps(roots, ensure_ascii=False), output_root, profile.to_json(), "pending", now, None, None)
    return spark.createDataFrame([row], JOBS)


def open_job(jobs: DataFrame, items: DataFrame, roots: list[str], profile: Profile, now: int) -> tuple[DataFrame, DataFrame, int]:
    """(jobs, items, id of the new job): old jobs that don't run go, with their items, and a new one is scanning.

    Its number is above all that ever were in jobs.
    """
    job_id = (jobs.agg(F.max("id")).first()[0] or 0) + 1
    left = prune_jobs(jobs, None)
    new = set_job_status(create_job(jobs.sparkSession, job_id, roots, profile, now), job_id, "scanning", now)
    return left.unionByName(new, allowMissingColumns=True).select(*jobs.columns), cascade_delete(items, "job_id", left), job_id


def set_estimate(jobs: DataFrame, job_id: int, est_out_bytes: int) -> DataFrame:
    """jobs with the expected bytes of a job's output; never below 0."""
    return jobs.withColumn("est_out_bytes", F.when(F.col("id") == job_id, F.lit(max(0, est_out_bytes)).cast("long")).otherwise(F.col("est_out_bytes")))


def set_output_root(jobs: DataFrame, job_id: int, root: str | None) -> DataFrame:
    return jobs.withColumn("output_root", F.when(F.col("id") == job_id, F.lit(root).cast("string")).otherwise(F.col("output_root")))


def create_run(spark: SparkSession, run_id: int, roots: list[str], mode: str, now: int, threshold: int | None = None) -> DataFrame:
    """The row of a new search for duplicates; exact ones have no threshold. A root that is named twice counts once."""
    kept = json.dumps(list(dict.fromkeys(roots)), ensure_ascii=False)
    return spark.createDataFrame([(run_id, kept, mode, "scanning", threshold if mode == "perceptual" else None, now, None)], RUNS)


def save_groups(rows: DataFrame, run_id: int, first_group: int = 1, first_member: int = 1) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of a run, from rows of group_rank, hash, reclaimable, member_rank, path, size, mtime, distance.

    Numbers follow the order of display, and every member is marked to stay.
    """
    group_id = (F.col("group_rank") + first_group - 1).cast("long")
    groups = rows.groupBy("group_rank").agg(F.first("hash").alias("hash"), F.first("reclaimable").alias("reclaimable"))
    groups = groups.select(group_id.alias("id"), F.lit(run_id).cast("long").alias("run_id"), "hash", "reclaimable")
    numbered = row_numbers(rows, ["group_rank", "member_rank", path_key(F.col("path"))], "at")
    none = F.lit(None).cast("string").alias("disposal")
    return groups, numbered.select((F.col("at") + first_member - 1).alias("id"), group_id.alias("group_id"), "path", "size", "mtime", "distance", F.lit(1).alias("keep"), none)


def delete_run(runs: DataFrame, groups: DataFrame, members: DataFrame, run_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """runs, groups and members without a run; cached hashes stay, as they belong to files."""
    left = runs.where(F.col("id") != run_id)
    kept = cascade_delete(groups, "run_id", left)
    return left, kept, cascade_delete(members, "group_id", kept)
