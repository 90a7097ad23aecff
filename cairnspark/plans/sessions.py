"""The three whole programs: a scan, a search for duplicates, and what a review comes to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.functions.paths import accepts, classify
from cairnspark.functions.policy import Profile, clamp_threshold
from cairnspark.operators import exact, near, review, scan
from cairnspark.plans.checkpoint import cut


def scan_session(media: DataFrame, roots: list[str], job_id: int, profile: Profile | None = None) -> dict[str, DataFrame]:
    """Probed media files to the report's tables and the rows of a new job. The planned rows are written once and reused."""
    planned = cut(scan.plan_items(media, profile))
    return {
        "kinds": scan.kind_groups(planned), "skipped": scan.skip_groups(planned), "dirs": scan.top_dirs(planned, roots), "progress": scan.progress(planned),
        "estimate": scan.estimate_summary(planned), "output": scan.estimated_output(planned), "items": scan.queue_rows(planned, job_id),
    }


def dedup_session(files: DataFrame, mode: str = "exact", threshold: int | None = None, lanes: list[str] | None = None, window: int = exact.WINDOW_BYTES) -> DataFrame:
    """Members of duplicate groups with keep marks: id, group_id, path, size, mtime, distance, keep, disposal.

    exact takes files with content and marks all but the shallowest path of each group; perceptual takes still images
    with fingerprint lanes and marks nothing, as near copies are for people to judge.
    """
    chosen = files.where(accepts(classify(F.col("path")), mode)) if mode != "exact" else files
    none = F.lit(None).cast("string")
    if mode == "exact":
        g = exact.groups(chosen, window).select(F.col("group_rank").alias("group_id"), F.col("member_rank").alias("at"), "path", "size", "mtime", F.lit(0).cast("long").alias("distance"))
    else:
        g = near.groups(chosen, clamp_threshold(threshold), lanes or ["fp0", "fp1", "fp2", "fp3"], cut)
        g = g.join(chosen.select("path", "mtime"), "path").select(F.col("group_rank").alias("group_id"), F.col("member_rank").alias("at"), "path", "size", "mtime", "distance")
    from cairnspark.operators.ranking import row_numbers

    rows = cut(row_numbers(g, ["group_id", "at"], "id").select("id", "group_id", "path", "size", "mtime", "distance", F.lit(1).alias("keep"), none.alias("disposal")))
    return review.apply_policy(rows, "shallowest_path" if mode == "exact" else "manual")


def apply_session(members: DataFrame, current: DataFrame, cancelled: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members with disposals, summary) of deleting what is marked. Only the decisions are made here."""
    outcomes = cut(review.decide_deletes(members, current, cancelled))
    return review.record_disposals(members, outcomes), review.apply_summary(outcomes)
