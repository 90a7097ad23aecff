"""Exact duplicates by a cascade: same size, same hash of both ends, same hash of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.functions.bits import FULL_HASH_ALGO, full_hash, sample_hash
from cairnspark.functions.paths import path_key
from cairnspark.operators.ranking import descending, one_row, row_numbers
from cairnspark.plans.checkpoint import cut

WINDOW_BYTES = 64 << 10
#: Bytes of paths that may be broadcast to pick the files of the second scan.
BROADCAST_BYTES = 32 << 20


def in_groups(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key occurs twice or more.

    Keys are counted with partial sums and joined back, so a key with very many rows is no single task's window, and
    the join's skewed partitions can be split.
    """
    many = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return df.join(many, list(keys), "left_semi")


def cascade(files: DataFrame, window: int = WINDOW_BYTES, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(same size, same sample, all with final hash). A file of up to two windows is hashed as a whole by its sample.

    cache (path, algo, size, mtime, hash) is looked in for the hashes of whole files, which are not read if found there.

    files has path, size, mtime and content; a content that is null, or isn't as long as size says, drops out: the file
    can't be read or has changed. So the cache serves only files that passed this check. Content is never shuffled: the
    ends of files are hashed as they are scanned, and a second scan hashes the whole of those that need it.
    """
    sized, same = sampled(files, window)
    return sized, same, final_tier(same, full_hashes(files, same.where(F.col("size") > 2 * window), cache), window)


def sampled(files: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The first tiers: files of the same size, and those of the same sample, written down. Content is scanned once."""
    narrow = cut(files.where("size IS NOT NULL").select("path", "size", "mtime", sample_hash(F.col("content"), F.col("size"), window).alias("sample")))
    sized = in_groups(narrow, "size")
    return sized, cut(in_groups(sized.where("sample IS NOT NULL"), "size", "sample"))


def final_tier(same: DataFrame, full: DataFrame, window: int) -> DataFrame:
    """Members of groups of the same final hash: that of a small file is its sample, that of a large one is in full."""
    small = same.where(F.col("size") <= 2 * window).select("path", "size", "mtime", F.col("sample").alias("hash"))
    large = same.where(F.col("size") > 2 * window).join(full.select("path", "size", "mtime", "hash"), ["path", "size", "mtime"])
    return in_groups(small.unionByName(large.select("path", "size", "mtime", "hash")), "size", "hash")


def full_hashes(files: DataFrame, chosen: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """path, size, mtime, hash and hit of the chosen files: the cache's hash, else that of the content.

    The rows without a hit are what is to be put into the cache.
    """
    todo, found = chosen.select("path", "size", "mtime").distinct(), None
    if cache is not None:
        looked = cut(with_cached_hash(todo, cache, FULL_HASH_ALGO, F.lit(None).cast("string")))
        todo, found = looked.where("NOT hit").select("path", "size", "mtime"), looked.where("hit").select("path", "size", "mtime", "hash", "hit")
    large = todo.select("path").distinct()
    size = large.agg(F.sum(F.octet_length("path") + 32)).first()[0] or 0
    pick = F.broadcast(large) if size <= BROADCAST_BYTES else large
    read = files.join(pick, "path", "left_semi").groupBy("path", "size", "mtime").agg(F.min(full_hash(F.col("content"))).alias("hash")).withColumn("hit", F.lit(False))
    if found is None:
        return read
    return found.unionByName(read.join(todo, ["path", "size", "mtime"], "left_semi"))


def groups(files: DataFrame, window: int = WINDOW_BYTES, cache: DataFrame | None = None) -> DataFrame:
    """A row a member: group_rank, hash, size, files, reclaimable, member_rank, path, mtime.

    Groups by reclaimable bytes (all copies but one), then hash; members by path, component by component.
    """
    return ranked_groups(cascade(files.select("path", "size", "mtime", "content"), window, cache)[2])


def ranked_groups(members: DataFrame) -> DataFrame:
    """The rows of groups(), from the members of the last tier."""
    members = cut(members.select("path", "size", "mtime", "hash"))
    g = members.groupBy("hash", "size").agg(F.count("*").alias("files")).withColumn("reclaimable", F.col("size") * (F.col("files") - 1))
    ranked = cut(row_numbers(g, [descending("reclaimable"), "hash"], "group_rank"))
    rows = members.join(ranked, ["hash", "size"])
    # a group's members stand together in the order of all rows, however many they are
    rows = cut(row_numbers(rows, ["group_rank", path_key(F.col("path"))], "place"))
    first = rows.groupBy("group_rank").agg(F.min("place").alias("first"))
    return rows.join(first, "group_rank").select("group_rank", "hash", "size", "files", "reclaimable", (F.col("place") - F.col("first") + 1).alias("member_rank"), "path", "mtime")


def cached_cascade(files: DataFrame, cache: DataFrame, window: int = WINDOW_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, hashed, puts): the groups' members as groups() gives them, path and hit of each file at the last tier,
    and the rows that are to be put into the cache."""
    return counted_cascade(files, cache, window)[:3]


def counted_cascade(files: DataFrame, cache: DataFrame, window: int = WINDOW_BYTES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """cached_cascade() and the row of stage_counts(), from one scan of the samples and one of the large files' content."""
    files = files.select("path", "size", "mtime", "content")
    sized, same = sampled(files, window)
    hashed = cut(full_hashes(files, same.where(F.col("size") > 2 * window), cache))
    puts = hashed.where("NOT hit").select("path", F.lit(FULL_HASH_ALGO).alias("algo"), "size", "mtime", "hash")
    last = cut(final_tier(same, hashed, window))
    return ranked_groups(last), hashed.select("path", "hit"), puts, _counted(files, sized, same, last, window)


def stage_counts(files: DataFrame, window: int = WINDOW_BYTES) -> DataFrame:
    """One row: candidates, after_size, after_sample, fully_read, sample_was_final, errors, groups, members.

    errors are files that had to be read and couldn't be, or had changed.
    """
    return _counted(files, *cascade(files.select("path", "size", "mtime", "content"), window), window)


def _counted(files: DataFrame, sized: DataFrame, same: DataFrame, last: DataFrame, window: int) -> DataFrame:
    small = F.col("size") <= 2 * window
    parts = [
        files.where("size IS NOT NULL").agg(F.count("*").alias("candidates")),
        sized.agg(F.count("*").alias("after_size"), F.count_if(F.col("sample").isNull()).alias("errors")),
        same.agg(F.count("*").alias("after_sample"), F.count_if(~small).alias("fully_read"), F.count_if(small).alias("sample_was_final")),
        last.groupBy("size", "hash").agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("members")),
    ]
    return one_row(*parts)


def with_cached_hash(files: DataFrame, cache: DataFrame, algo: str, compute: Column) -> DataFrame:
    """files with hash and hit: the cached hash where path, size and mtime are the cache's, else compute."""
    c = cache.where(F.col("algo") == algo).select("path", "size", "mtime", F.col("hash").alias("cached"))
    return files.join(c, ["path", "size", "mtime"], "left").withColumn("hit", F.col("cached").isNotNull()).withColumn("hash", F.coalesce("cached", compute)).drop("cached")
