"""Helpers shared by the training-data operators: scratch space, Arrow batches, file access."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that Spark hands to Python at once, about: batches are cut by size, as texts have no length bound.
BATCH_BYTES = 16 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Text bytes that the numpy kernels work on at once; a longer text is worked on alone.
SLICE_BYTES = 512 << 10


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch to BATCH_BYTES; a lower one stays.

    It must hold when a result is computed, which may be later, so it isn't put back; the bound on rows isn't touched.
    Python workers also get the place of this package, so that they can import it wherever they were started.
    """
    env = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    now = spark.conf.get(_BATCH_KEY).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset and Spark is local."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="cairnspark-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    at = scratch(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def local_path(uri: str) -> str | None:
    """The path of a file: URI or a bare path, None for any other store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def open_shared(uri: str, mode: str):
    """Open a file of the shared folder from a task: file: directly, any other store through pyarrow's filesystems."""
    if (path := local_path(uri)) is not None:
        if "w" in mode:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if "w" in mode:
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path)
    return store.open_input_file(path)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) of runs of rows of a string column; null counts as empty.

    Each run holds up to limit bytes, or one longer text. offsets start at 0 and have end - first + 1 entries.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    n = len(col)
    if not n:
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32, count=n + 1 + col.offset)[col.offset :].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, whole[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit of a 64-bit hash."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(codes, distinct): the distinct contents of the spans data[starts[i]:ends[i]], and which of them each span is.

    Arrow compares the contents themselves, so no two contents ever share a code. Spans are in ascending order, not
    empty, and don't overlap. The items of data may be wider than a byte; distinct then holds their bytes.
    """
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    inside = np.ascontiguousarray(data[np.cumsum(mark[:-1], dtype=np.int8).view(bool)])
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum((ends - starts) * data.dtype.itemsize, out=bounds[1:])
    wide = bounds[-1] >= 1 << 31
    offsets = bounds if wide else bounds.astype(np.int32)
    spans = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(inside)])
    found = spans.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


#: Masks that keep the first k of 8 bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans of up to so many bytes are named by their contents, longer ones by a digest.
_SHORT = 15


def span_names(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit names of the spans codes[starts[i]:ends[i]], as two rows of 64-bit lanes.

    Up to 15 characters under 256 are their own name (with their number, mixed by a Feistel network, which is one to
    one), so no two short spans share a name. A longer span, or one with other characters, has its BLAKE2b digest.
    Spans are in ascending order, not empty, and don't overlap.
    """
    length = ends - starts
    padded = np.zeros(len(codes) + 16, np.uint8)
    padded[: len(codes)] = codes
    at = np.lib.stride_tricks.sliding_window_view(padded, 8)
    a, b = (at[x].view("<u8").ravel() for x in (starts, np.minimum(starts + 8, len(codes))))
    left = a & _FIRST[np.minimum(length, 8)]
    right = (b & _FIRST[np.clip(length - 8, 0, 7)]) | (np.minimum(length, 255).astype(np.uint64) << np.uint64(56))
    for key in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93):
        left, right = right ^ mix64(left ^ np.uint64(key)), left
    out = np.stack([left, right])
    digested = length > _SHORT
    if codes.dtype != np.uint8:
        others = np.concatenate([[0], np.cumsum(codes > 255)])
        digested |= others[ends] > others[starts]
    if digested.any():
        which, distinct = distinct_spans(codes, starts[digested], ends[digested])
        raw = b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in distinct.to_pylist()])
        out[:, digested] = np.frombuffer(raw, np.uint64).reshape(-1, 2).T[:, which]
    return out
