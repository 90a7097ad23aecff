"""Bookkeeping of the queue as a stream: changes come in micro-batches, each item's state is folded as they come.

The fold is an aggregate of maxima (operators.queue.change_marks), so Structured Streaming keeps its state natively.
Changes may come late, out of order or twice, and batches may end anywhere: the result is that of fold_results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnspark.operators.queue import apply_marks, change_marks
from cairnspark.plans.checkpoint import shared_dir

CHANGES = "seq bigint, type string, id bigint, dst_path string, dst_size bigint, elapsed_ms bigint, code string, msg string, reason string"


def read_changes(spark: SparkSession, folder: str, files_per_batch: int = 4) -> DataFrame:
    """Change files as they arrive, so many a micro-batch: the stream's back-pressure."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


#: A batch of changes is committed once it holds so many, or is so many milliseconds old.
BATCH_CHANGES, BATCH_MILLIS = 200, 500
#: Milliseconds between two frames of progress that are shown.
TICK_MILLIS = 100


def result_batches(changes: DataFrame, time: str, order: str = "seq", count: int = BATCH_CHANGES, millis: int = BATCH_MILLIS) -> DataFrame:
    """changes with interval and chunk, which together name the batch that a change is committed with: batches end with an
    interval of millis (of the column time, in milliseconds), and with count changes inside it."""
    interval = F.floor(F.col(time) / millis).cast("long")
    at = F.row_number().over(Window.partitionBy("interval").orderBy(order))
    return changes.withColumn("interval", interval).withColumn("chunk", F.call_function("div", at - 1, F.lit(count)).cast("long"))


def throttled(frames: DataFrame, time: str, key: str = "id", millis: int = TICK_MILLIS) -> DataFrame:
    """The frames of progress that are shown: of each key the first, the last, and the latest of every tick of millis."""
    fields = F.struct(time, *[c for c in frames.columns if c not in (key, time)])
    ticks = frames.groupBy(key, F.floor(F.col(time) / millis).alias("_tick")).agg(F.min(fields).alias("_first"), F.max(fields).alias("_last"))
    ends = ticks.groupBy(key).agg(F.min("_first").alias("_first"))
    shown = ticks.select(key, F.col("_last").alias("_f")).union(ends.select(key, F.col("_first"))).distinct()
    return shown.select(key, "_f.*").select(*frames.columns)


def start(changes: DataFrame, out: str, checkpoint: str, **trigger):
    """Fold a stream into a folder: each batch writes the marks of the ids it touched, once under its number.

    A batch that is run again after a failure overwrites its own folder. By default twice a second; how many changes a
    batch holds is up to the source.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return change_marks(changes).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()


def states(items: DataFrame, out: str) -> DataFrame:
    """items as the stream has left them: the marks of each id's last batch, applied."""
    rows = items.sparkSession.read.parquet(out)
    fields = [c for c in rows.columns if c.startswith("_")]
    last = rows.groupBy("id").agg(F.max_by(F.struct(*fields), "batch").alias("m")).select("id", "m.*")
    return apply_marks(items, last)


def counters(items: DataFrame) -> DataFrame:
    """One row: how many items are settled as done, skipped and failed, how many run, and how many aren't settled.

    Counted from the states, so repeated changes don't count twice. A running item is still pending, as it isn't settled.
    """
    n = {s: F.count_if(F.col("status") == s).alias(s) for s in ("done", "skipped", "failed", "running")}
    return items.agg(*n.values(), F.count_if(F.col("status").isin("pending", "running")).alias("pending"))


def compact(spark: SparkSession, out: str, to: str) -> None:
    """Fold the folders of all batches so far into one in the new folder to, the last marks of each id: what states() reads
    is then as large as the ids are many. It keeps the number of the last batch, so later batches go on from there."""
    rows = spark.read.parquet(out)
    last = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("id", "batch")]), "batch").alias("m")).select("id", "m.*")
    last.write.mode("overwrite").parquet(f"{to}/batch={rows.agg(F.max('batch')).first()[0]}")


def run_to_end(spark: SparkSession, changes: DataFrame, items: DataFrame, files: int = 4) -> DataFrame:
    """A table of changes as a stream in several batches, read to its end and folded into items."""
    at = f"{shared_dir(spark)}/bookkeeping-{uuid.uuid4().hex}"
    changes.select(*(c.split()[0] for c in CHANGES.split(", "))).repartitionByRange(files, "seq").write.parquet(f"{at}/in")
    start(read_changes(spark, f"{at}/in", 1), f"{at}/out", f"{at}/checkpoint", availableNow=True).awaitTermination()
    return states(items, f"{at}/out")


def run_with_pause(spark: SparkSession, changes: DataFrame, items: DataFrame) -> DataFrame:
    """As run_to_end, but stopped half-way and started again from its checkpoint; what came meanwhile isn't lost."""
    at = f"{shared_dir(spark)}/paused-{uuid.uuid4().hex}"
    rows = changes.select(*(c.split()[0] for c in CHANGES.split(", ")))
    for half in (0, 1):
        rows.where(F.pmod(F.col("seq"), F.lit(2)) == half).repartition(2).write.mode("append").parquet(f"{at}/in")
        start(read_changes(spark, f"{at}/in", 1), f"{at}/out", f"{at}/checkpoint", availableNow=True).awaitTermination()
    return states(items, f"{at}/out")
