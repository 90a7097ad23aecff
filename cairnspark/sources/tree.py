"""Folder trees: a walk that prunes while it lists, and files written by tasks.

Paths are of file systems that the executors share, mounted or named by a file: URI.
"""

from __future__ import annotations

import json
import os
import stat
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairnspark.functions.paths import BUNDLES, SYSTEM_DIRS
from cairnspark.plans.checkpoint import importable

#: Folders that the driver opens at most to find subtrees for the tasks, for each task that it wants.
OPENED = 4


def local_path(uri: str) -> str:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"not a mounted file system: {uri}")
    return uri


# --- the walk -----------------------------------------------------------------------------------------------------

WALKED = "root string, kind string, path string, name string, size bigint, mtime bigint, dev bigint, inode bigint, nlink bigint"


def is_bundle_name(name: str) -> bool:
    return "." in name and name.rpartition(".")[2].lower() in BUNDLES


def is_pruned_name(name: str) -> bool:
    """Folders that a walk never opens."""
    return name.startswith(".") or name.lower() in SYSTEM_DIRS


def list_folder(root: str, folder: str) -> tuple[list[tuple], list[str]]:
    """(rows, folders): what stands in a folder and counts, and the folders below it that are to be walked.

    Links are neither rows nor followed; nor is anything that is no regular file or folder. A bundle is a row and stays
    closed. What can't be read is an error.
    """
    rows, folders = [], []

    def row(kind: str, path: str, s: os.stat_result | None = None) -> None:
        numbers = (s.st_size, int(s.st_mtime), s.st_dev, s.st_ino, s.st_nlink) if s else (None,) * 5
        rows.append((root, kind, path, path.rpartition("/")[2], *numbers))

    try:
        with os.scandir(folder) as entries:
            found = list(entries)
    except OSError:
        row("error", folder)
        return rows, folders
    for e in found:
        try:
            if e.is_symlink():
                continue
            if e.is_dir(follow_symlinks=False):
                if is_bundle_name(e.name):
                    row("bundle", e.path)
                elif not is_pruned_name(e.name):
                    folders.append(e.path)
            elif e.is_file(follow_symlinks=False):
                row("file", e.path, e.stat(follow_symlinks=False))
        except OSError:
            row("error", e.path)
    return rows, folders


class WalkReader(DataSourceReader):
    """A partition for each subtree; folders above subtrees are listed by partitions of their own."""

    def __init__(self, roots: list[str], tasks: int):
        self.roots, self.tasks = roots, tasks

    def partitions(self) -> list[InputPartition]:
        done, waiting = [], []
        for root in self.roots:
            try:
                os.scandir(root).close()
            except FileNotFoundError:
                done.append((root, "missing", root))
            except OSError:
                done.append((root, "denied", root))
            else:
                done.append((root, "ok", root))
                waiting.append((root, root))
        # the driver opens a few folders, broadest first, and leaves what stands in them to the tasks
        opened = 0
        while waiting and len(waiting) < self.tasks and opened < OPENED * self.tasks:
            root, folder = waiting.pop(0)
            done.append((root, "folder", folder))
            waiting += [(root, f) for f in list_folder(root, folder)[1]]
            opened += 1
        return [InputPartition(x) for x in (*done, *((root, "subtree", f) for root, f in waiting))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        root, kind, folder = partition.value
        if kind in ("missing", "denied", "ok"):
            yield (root, kind, folder, folder.rpartition("/")[2], None, None, None, None, None)
            return
        left = [folder]
        while left:
            rows, folders = list_folder(root, left.pop())
            yield from rows
            if kind == "subtree":
                left += folders


class Walk(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cairn_walk"

    def schema(self) -> str:
        return WALKED

    def reader(self, schema) -> WalkReader:
        return WalkReader(json.loads(self.options["roots"]), int(self.options.get("tasks", "8")))


def _tasks(spark: SparkSession) -> int:
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def walk(spark: SparkSession, roots: list[str], tasks: int | None = None) -> DataFrame:
    """What stands below roots: kind is file, bundle or error, and a row for each root is ok, denied or missing.

    Hidden, system and bundle folders are never opened, and no link is followed. A root that a second root holds is walked
    twice, as it would be by two walks. Executors walk subtrees, each a task.
    """
    importable(spark)
    spark.dataSource.register(Walk)
    n = tasks or _tasks(spark)
    return spark.read.format("cairn_walk").option("roots", json.dumps([local_path(r) for r in roots])).option("tasks", str(n)).load()


# --- writing ------------------------------------------------------------------------------------------------------


def replace_file(path: str, content: bytes, mtime: int | None = None) -> None:
    """Write beside path, then rename: a reader finds the old file or the new one."""
    folder, _, name = path.rpartition("/")
    os.makedirs(folder, exist_ok=True)
    aside = f"{folder}/.{uuid.uuid4().hex}.zz-{name[:40]}.tmp"
    try:
        with open(aside, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        if mtime is not None:
            os.utime(aside, (mtime, mtime))
        os.replace(aside, path)
    finally:
        if os.path.lexists(aside):
            os.unlink(aside)


def write_files(rows: DataFrame, root: str) -> int:
    """Write a file below root for each row of path (relative), content and mtime; a null content is an empty file, a null
    mtime is now. Returns how many. A repeated task writes the same again."""
    importable(rows.sparkSession)
    at = local_path(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, mtime in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                replace_file(f"{at}/{path.lstrip('/')}", content or b"", mtime)
            yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64())})

    # files cost by their number, so they are dealt out evenly, however few tasks read the rows
    dealt = rows.select("path", F.col("content").cast("binary"), F.col("mtime").cast("long")).repartition(_tasks(rows.sparkSession))
    done = dealt.mapInArrow(run, "n bigint")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def link_files(rows: DataFrame, root: str) -> int:
    """Make a link below root for each row of path, target (both relative) and hard; those that are there are left."""
    importable(rows.sparkSession)
    at = local_path(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, target, hard in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                here, there = f"{at}/{path.lstrip('/')}", f"{at}/{target.lstrip('/')}"
                os.makedirs(here.rpartition("/")[0], exist_ok=True)
                if not os.path.lexists(here):
                    (os.link if hard else os.symlink)(there, here)
            yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64())})

    return rows.select("path", "target", "hard").repartition(_tasks(rows.sparkSession)).mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def file_states(paths: DataFrame, root: str) -> DataFrame:
    """path, size, mtime, is_symlink and content (null for links) of those paths (relative to root) that are there now."""
    importable(paths.sparkSession)
    at = local_path(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                whole = f"{at}/{path.lstrip('/')}"
                try:
                    s = os.lstat(whole)
                except OSError:
                    continue
                link = stat.S_ISLNK(s.st_mode)
                out.append((path, s.st_size, int(s.st_mtime), link, None if link else open(whole, "rb").read()))
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.record_batch([pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], ["path", "size", "mtime", "is_symlink", "content"])

    return paths.select("path").mapInArrow(run, "path string, size bigint, mtime bigint, is_symlink boolean, content binary")
