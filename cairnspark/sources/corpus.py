"""Generated inputs: an inventory of files, and random fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.plans.checkpoint import importable

#: Of each folder of 100 files: images, videos, audio files; the rest is other.
MIX = (92, 5, 2)


def inventory(spark: SparkSession, n: int) -> DataFrame:
    """id, dir, kind, path, size of n files."""
    at, (img, vid, aud) = F.col("id") % 100, MIX
    kind = F.when(at < img, "image").when(at < img + vid, "video").when(at < img + vid + aud, "audio").otherwise("other")
    ext = F.when(kind == "image", "jpg").when(kind == "video", "mp4").when(kind == "audio", "mp3").otherwise("txt")
    folder = F.call_function("div", F.col("id"), F.lit(100))
    path = F.concat(F.lit("/corpus/"), F.lpad(folder.cast("string"), 6, "0"), F.lit("/"), F.lpad(F.col("id").cast("string"), 9, "0"), F.lit("."), ext)
    return spark.range(n).select("id", folder.alias("dir"), kind.alias("kind"), path.alias("path"), (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) + 1).alias("size"))


#: The first state of the generator, and the shifts of a step (left, right, left).
FIRST_STATE, SHIFTS = 0x2545F4914F6CDD1D, (13, 7, 17)
_WORD = (1 << 64) - 1


def next_state(x: int) -> int:
    """A step of a 64-bit xorshift generator."""
    for k, shift in enumerate(SHIFTS):
        x ^= x >> shift if k == 1 else x << shift & _WORD
    return x


def state_after(state: int, steps: int) -> int:
    """The state so many steps on. A step is linear in the bits, so that steps can be doubled instead of taken one by one."""
    images = [next_state(1 << i) for i in range(64)]

    def move(x: int) -> int:
        out = 0
        for i in range(64):
            if x >> i & 1:
                out ^= images[i]
        return out

    while steps:
        if steps & 1:
            state = move(state)
        images = [move(x) for x in images]
        steps >>= 1
    return state


def random_prints(spark: SparkSession, n: int, state: int = FIRST_STATE) -> DataFrame:
    """path, size and four 64-bit lanes of n random prints: the states of one generator in order, four a print.

    Each task jumps to where its prints begin.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lanes, x, at = batch.column(0).to_pylist(), [], state, 0
            for i in ids:
                if 4 * i != at:
                    x, at = state_after(state, 4 * i), 4 * i
                for _ in range(4):
                    x, at = next_state(x), at + 1
                    lanes.append(x - (1 << 64) if x >> 63 else x)
            out = {"path": [f"/rnd/{i:09d}" for i in ids], "size": pa.array([1000] * len(ids), pa.int64())}
            yield pa.record_batch(out | {f"fp{k}": pa.array(lanes[k::4], pa.int64()) for k in range(4)})

    importable(spark)
    return spark.range(n).mapInArrow(make, "path string, size bigint, fp0 bigint, fp1 bigint, fp2 bigint, fp3 bigint")
