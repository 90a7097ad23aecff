"""Outputs put in place and duplicates put away, as work on files that tasks do, may lose and may do again.

Every step is a table in the shared folder before the next one begins. Outputs: stage() writes each under a name of the task
attempt, its manifest names those that count; publish() renames them, and finds on a second try what the first has done.
Removals: intend() writes what is to go and where to; remove() looks at each file once more and moves it. A file is moved by
one rename, so it is in one place or the other whenever a task is lost.
"""

from __future__ import annotations

import hashlib
import os
import stat
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.functions.policy import Profile, commit_gate
from cairnspark.operators.review import decide_deletes
from cairnspark.plans.checkpoint import cut, importable
from cairnspark.sources.tree import local_path, replace_file

STAGED = "id bigint, target string, staged string, src_size bigint, bytes bigint, sha256 string, mtime bigint"


def _mapped(rows: DataFrame, each, ddl: str) -> DataFrame:
    """Rows through a function that takes and gives tuples."""
    importable(rows.sparkSession)
    names = [c.split()[0] for c in ddl.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [each(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.record_batch([pa.array(list(x), k) for x, k in zip(columns, types, strict=True)], names)

    return rows.mapInArrow(run, ddl)


# --- outputs ------------------------------------------------------------------------------------------------------


def stage(outputs: DataFrame, folder: str) -> DataFrame:
    """Write the outputs (id, target, content, src_size, mtime of the source) aside, below folder; returns the manifest.

    Each attempt of a task names its files anew. Only what the manifest names counts, so files of lost attempts lie about
    and do no harm.
    """
    at = local_path(folder)

    def each(id: int, target: str, content: bytes | None, src_size: int, mtime: int | None) -> tuple:
        own = uuid.uuid4().hex
        name = f"{at}/{own[:2]}/{own}.tmp"  # many folders, since tasks wait for each other at one
        replace_file(name, content or b"", mtime)
        return id, target, name, src_size, len(content or b""), hashlib.sha256(content or b"").hexdigest(), mtime

    rows = outputs.select("id", "target", F.col("content").cast("binary"), F.col("src_size").cast("long"), F.col("mtime").cast("long"))
    return cut(_mapped(rows, each, STAGED))


def _digest(path: str) -> str | None:
    try:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()
    except OSError:
        return None


def publish(manifest: DataFrame, root: str, profile: Profile, gate: bool = True) -> DataFrame:
    """id, target, outcome (written, no_gain, error or failed), bytes and sha256 of every staged output, written down.

    The gate decides first, on the manifest alone: an output that is refused leaves its target as it is. The others are
    renamed onto their targets (relative to root), with their sources' times. Done again, an output that its target already
    holds is written, too; one that neither place holds has failed, and so has one whose bytes aren't the staged ones.
    """
    at = local_path(root)
    decided = manifest.withColumn("gate", commit_gate(F.col("src_size"), F.col("bytes"), gate, profile))

    def each(id: int, target: str, staged: str, size: int, sha256: str, gate: str) -> tuple:
        path, outcome = f"{at}/{target.lstrip('/')}", gate
        if gate == "written":
            if _digest(staged) == sha256:
                os.makedirs(path.rpartition("/")[0], exist_ok=True)
                os.replace(staged, path)
            elif _digest(path) != sha256:
                outcome = "failed"
        elif os.path.exists(staged):
            os.unlink(staged)
        return id, target, outcome, size, sha256

    rows = decided.select("id", "target", "staged", "bytes", "sha256", "gate")
    return cut(_mapped(rows, each, "id bigint, target string, outcome string, bytes bigint, sha256 string"))


# --- removals -----------------------------------------------------------------------------------------------------

JOURNAL = "id bigint, group_id bigint, path string, size bigint, mtime bigint, place string"


def intend(members: DataFrame, trash: str) -> DataFrame:
    """The journal of what is to go: every marked member that the rules on groups let go, and its place in the trash.

    A place is named by the member, so a second journal of the same members has the same places.
    """
    # as if all files were as they were: what is left are the rules that need no look at the files
    as_known = members.select("path", "size", "mtime", F.lit(False).alias("is_symlink")).dropDuplicates(["path"])
    goes = decide_deletes(members, as_known).where("outcome = 'trashed'").select("id", "group_id", "path", "size")
    place = F.concat(F.lit(local_path(trash) + "/"), F.col("id").cast("string"), F.lit("/"), F.element_at(F.split("path", "/"), -1))
    rows = goes.join(members.select("id", F.col("mtime").cast("long").alias("mtime")), "id")
    return cut(rows.select("id", F.col("group_id").cast("long").alias("group_id"), "path", F.col("size").cast("long").alias("size"), "mtime", place.alias("place")))


def remove(journal: DataFrame, root: str) -> DataFrame:
    """id, group_id, path, size, outcome (trashed, skipped or failed) and note of every row of the journal, written down.

    A file is looked at once more, then moved to its place: one that is missing, a link or changed is left alone. Done again,
    what stands in its place already is trashed. Nothing is deleted.
    """
    at = local_path(root)

    def each(id: int, group: int, path: str, size: int, mtime: int, place: str) -> tuple:
        here, outcome, note = f"{at}/{path.lstrip('/')}", "skipped", None
        if os.path.lexists(place):
            return id, group, path, size, "trashed", None
        try:
            s = os.lstat(here)
        except FileNotFoundError:
            return id, group, path, size, "skipped", "missing"
        except OSError as e:
            return id, group, path, size, "failed", str(e)
        if stat.S_ISLNK(s.st_mode):
            note = "symlink"
        elif s.st_size != size:
            note = "size_changed"
        elif int(s.st_mtime) != mtime:
            note = "mtime_changed"
        else:
            try:
                os.makedirs(place.rpartition("/")[0], exist_ok=True)
                os.rename(here, place)
                outcome = "trashed"
            except OSError as e:
                outcome, note = "failed", str(e)
        return id, group, path, size, outcome, note

    rows = journal.select("id", "group_id", "path", "size", "mtime", "place")
    return cut(_mapped(rows, each, "id bigint, group_id bigint, path string, size bigint, outcome string, note string"))


def apply_removals(members: DataFrame, root: str, trash: str) -> DataFrame:
    """Journal, removal, and the outcome of every marked member, those that the rules on groups hold back included."""
    journal = intend(members, trash)
    done = remove(journal, root)
    held = decide_deletes(members, journal.select("path", "size", "mtime", F.lit(False).alias("is_symlink")).dropDuplicates(["path"]))
    held = held.join(journal.select("id"), "id", "left_anti").select("id", F.col("group_id").cast("long").alias("group_id"), "path", F.col("size").cast("long").alias("size"), "outcome", "note")
    return done.unionByName(held)
