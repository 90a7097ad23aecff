"""The queue as a clustered table: files in ranges of (job_id, id) and an index of them, so that a page opens a file or two.

The index has a row for each file and job: its ids' range, and how many rows of each status, and pending ones of each
kind, it holds. A page finds its files by running sums over the index; the rows come from these files alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnspark.operators import queue

#: Rows of a file. A page of 500 lies in one or two, unless few of a file's rows match.
FILE_ROWS = 100_000


def _counts() -> dict:
    status = {s: F.col("status") == s for s in queue.STATUSES}
    return status | {f"pending_{k}": status["pending"] & (F.col("kind") == k) for k in queue.KINDS}


def write(items: DataFrame, folder: str, file_rows: int = FILE_ROWS) -> DataFrame:
    """Write items (with job_id, id, status and kind) into a new folder, and its index beside them; returns the index."""
    spark = items.sparkSession
    ranged = items.repartitionByRange("job_id", "id").sortWithinPartitions("job_id", "id")
    ranged.write.option("maxRecordsPerFile", file_rows).parquet(f"{folder}/rows")
    rows = spark.read.schema(items.schema).parquet(f"{folder}/rows")
    by_file = rows.groupBy(F.col("_metadata.file_path").alias("file"), "job_id")
    counts = [F.count_if(c).alias(n) for n, c in _counts().items()]
    found = by_file.agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n"), *counts)
    found.sort("job_id", "first_id").write.parquet(f"{folder}/index")
    return index(spark, folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    counts = "".join(f", {n} bigint" for n in ("n", *_counts()))
    return spark.read.schema(f"file string, job_id bigint, first_id bigint, last_id bigint{counts}").parquet(f"{folder}/index")


def _rows(spark: SparkSession, folder: str, files: list[str]) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/rows").schema
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _until(found: DataFrame, n, most) -> list:
    """The index rows, in the order of ids, of which those before hold fewer than most matching rows."""
    before = F.sum("_n").over(Window.orderBy("first_id").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file of a job
    return found.withColumn("_n", n).where("_n > 0").withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < most)


def page(spark: SparkSession, folder: str, job_id: int, status: str | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
    """queue.page of a clustered table: only files that hold some of the page's rows are opened."""
    limit = min(limit, queue.PAGE_MAX)
    mine = _until(index(spark, folder).where(F.col("job_id") == job_id), F.col(status or "n"), offset + limit)
    found = mine.where(F.col("_before") + F.col("_n") > offset).select("file", "_before").orderBy("first_id").collect()  # at most limit files
    skipped = found[0]["_before"] if found else 0
    return queue.page(_rows(spark, folder, [r["file"] for r in found]), job_id, status, limit, offset - skipped)


def take_pending(spark: SparkSession, folder: str, job_id: int, kinds: list[str], after_id: int, limit: int = 32, more: list[str] | None = None) -> DataFrame:
    """queue.take_pending of a clustered table."""
    n = sum((F.col(f"pending_{k}") for k in kinds), F.lit(0))
    left = index(spark, folder).where((F.col("job_id") == job_id) & (F.col("last_id") > after_id)).where(n > 0)
    # the file that the cursor stands in may have no row behind it, so it counts for none
    inside = F.col("first_id") <= after_id
    here = [r["file"] for r in left.where(inside).select("file").collect()]
    files = here + [r["file"] for r in _until(left.where(~inside), n, limit).select("file").orderBy("first_id").collect()]
    return queue.take_pending(_rows(spark, folder, files), job_id, kinds, after_id, limit, more)


def pending_range(spark: SparkSession, folder: str, job_id: int, kinds: list[str], after_id: int, taken: int, limit: int) -> DataFrame:
    """The next limit pending items behind after_id, all but taken of the job's being behind it; in no order, by no sort.

    The index tells in which file the last of them lies, and only that file is looked through for its id.
    """
    n = sum((F.col(f"pending_{k}") for k in kinds), F.lit(0))
    mine = index(spark, folder).where((F.col("job_id") == job_id) & (n > 0))
    end = _until(mine, n, taken + limit).agg(F.max(F.struct("first_id", "file", "last_id", "_n", "_before")).alias("end")).select("end.*").first()
    pending = (F.col("job_id") == job_id) & (F.col("status") == "pending") & F.col("kind").isin(*kinds)
    last = end["last_id"]
    if last is not None and end["_before"] + end["_n"] > taken + limit:
        rest = _rows(spark, folder, [end["file"]]).where(pending).orderBy("id").limit(taken + limit - end["_before"])
        last = rest.agg(F.max("id")).first()[0]
    files = [r["file"] for r in mine.where((F.col("last_id") > after_id) & (F.col("first_id") <= last)).select("file").collect()] if last is not None else []
    return _rows(spark, folder, files).where(pending & (F.col("id") > after_id) & (F.col("id") <= F.lit(last)))
