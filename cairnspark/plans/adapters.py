"""Views that give the driver's tables the shapes that the operators take, and the same views as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions dealt out to documents, one of every class and some of none.
EXTENSIONS = ("jpg", "JPEG", "png", "heic", "avif", "cr2", "dng", "mp4", "MOV", "mkv", "mp3", "flac", "m4a", "aac", "txt", "xmp", "pdf", "", "webp", "gif")
STEPS = {
    "width": (4032, 1920, 3840, 800, 0), "height": (3024, 1080, 2160, 600, 0), "fps": (24.0, 29.97, 30.0, 60.0, None),
    "video_codec": ("h264", "hevc", "av1", "mpeg4"), "audio_codec": ("aac", "mp3", "flac", "opus"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _step(name: str):
    values = STEPS[name]
    return F.get(F.array(*(F.lit(v) for v in values)), F.pmod(F.col("doc_id"), F.lit(len(values))).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inventory of documents: path, name, ext, size, mtime, dev, inode, nlink, readable; some inodes stand on two devices."""
    ext = F.get(F.array(*(F.lit(e) for e in EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS)).cast("int"))
    name = F.concat(F.when(F.col("doc_id") % 50 == 7, "._").otherwise(""), F.lit("doc_"), F.col("doc_id").cast("string"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    sub = F.when(F.col("doc_id") % 41 == 3, "/Lib.photoslibrary").when(F.col("doc_id") % 43 == 5, "/.cache").otherwise("")
    folder = F.when(F.col("doc_id") % 37 == 0, "/vol").otherwise(F.concat(F.lit("/vol/"), F.col("source"), F.lit("/"), F.col("lang"), sub))
    linked = (F.col("doc_id") % 9).isin(1, 2)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(folder, F.lit("/"), name).alias("path"), name.alias("name"), ext.alias("ext"), (F.octet_length("text").cast("long") * 64).alias("size"),
        (F.lit(1_700_000_000) + F.col("doc_id") * 7919 % 10_000_000).alias("mtime"), F.when(F.col("doc_id") % 9 == 2, F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("inode"), F.when(linked, 2).otherwise(1).cast("long").alias("nlink"),
        F.when(F.col("doc_id") % 4 == 0, 2).otherwise(1).cast("long").alias("dev"), (F.col("doc_id") % 61 != 9).alias("readable"),
    )


FILES = f"""files AS (
  SELECT doc_id, folder || '/' || name AS path, name, ext, size, mtime, inode, nlink, dev, readable FROM (
    SELECT doc_id, list_extract({list(EXTENSIONS)!r}, CAST(doc_id % {len(EXTENSIONS)} + 1 AS INTEGER)) AS ext,
      (CASE WHEN doc_id % 50 = 7 THEN '._' ELSE '' END) || 'doc_' || doc_id || (CASE WHEN ext = '' THEN '' ELSE '.' || ext END) AS name,
      CASE WHEN doc_id % 37 = 0 THEN '/vol' ELSE '/vol/' || source || '/' || lang || (CASE WHEN doc_id % 41 = 3 THEN '/Lib.photoslibrary' WHEN doc_id % 43 = 5 THEN '/.cache' ELSE '' END) END AS folder,
      CAST(strlen(text) * 64 AS BIGINT) AS size, 1700000000 + doc_id * 7919 % 10000000 AS mtime,
      CASE WHEN doc_id % 9 = 2 THEN doc_id - 1 ELSE doc_id END AS inode, CAST(CASE WHEN doc_id % 9 IN (1, 2) THEN 2 ELSE 1 END AS BIGINT) AS nlink,
      CAST(CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS BIGINT) AS dev, doc_id % 61 <> 9 AS readable
    FROM documents))"""


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media files of the inventory with what a probe would find in them."""
    from cairnspark.functions.paths import classify, extension, is_junk

    f = files(spark, sf_dir).withColumn("class", classify(F.col("path"))).where(F.col("class").isNotNull() & ~is_junk(F.col("name")))
    is_video, is_audio, d = F.col("class") == "video", F.col("class") == "audio", F.col("doc_id")
    return f.select(
        "doc_id", "path", "name", "class", F.lower(extension(F.col("path"))).alias("ext"), "size", "mtime",
        F.when(is_audio, 0).otherwise(_step("width")).cast("long").alias("width"), F.when(is_audio, 0).otherwise(_step("height")).cast("long").alias("height"),
        F.when(is_video, _step("video_codec")).when(is_audio, _step("audio_codec")).alias("codec"), F.when(is_video & (d % 19 == 0), "dvh1").alias("codec_tag"),
        F.when(is_video, _step("fps")).alias("fps"), F.when((is_video | is_audio) & (d % 7 != 0), (d % 600 + 1) * 1_000_000).alias("duration_us"),
        F.when(is_video & (d % 13 == 0), "smpte2084").alias("color_transfer"), F.when(is_video & (d % 17 == 0), "bt2020nc").alias("color_primaries"), F.lit(None).cast("string").alias("color_space"),
    )


def sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else repr(v) for v in values) + "]"


def _sql_step(name: str) -> str:
    return f"list_extract({sql_list(STEPS[name])}, CAST(doc_id % {len(STEPS[name])} + 1 AS INTEGER))"


def _sql_in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''").replace("\r", "' || chr(13) || '") + "'" for v in values) + ")"


def _media_sql() -> str:
    from cairnspark.functions.paths import CLASSES, SIDECAR, SYSTEM_NAMES

    cases = " ".join(f"WHEN lower(ext) IN {_sql_in(m)} THEN '{c}'" for c, m in CLASSES.items())
    return f"""{FILES}, classed AS (
  SELECT *, CASE {cases} END AS class,
    starts_with(name, '._') OR lower(name) IN {_sql_in(SYSTEM_NAMES)} AS system_junk, (contains(name, '.') AND lower(regexp_extract(name, '[^.]*$')) IN {_sql_in(SIDECAR)}) AS sidecar
  FROM files),
media AS (
  SELECT doc_id, path, name, class, lower(ext) AS ext, size, mtime,
    CAST(CASE WHEN class = 'audio' THEN 0 ELSE {_sql_step("width")} END AS BIGINT) AS width, CAST(CASE WHEN class = 'audio' THEN 0 ELSE {_sql_step("height")} END AS BIGINT) AS height,
    CASE class WHEN 'video' THEN {_sql_step("video_codec")} WHEN 'audio' THEN {_sql_step("audio_codec")} END AS codec,
    CASE WHEN class = 'video' AND doc_id % 19 = 0 THEN 'dvh1' END AS codec_tag,
    CAST(CASE WHEN class = 'video' THEN {_sql_step("fps")} END AS DOUBLE) AS fps,
    CASE WHEN class IN ('video', 'audio') AND doc_id % 7 <> 0 THEN (doc_id % 600 + 1) * 1000000 END AS duration_us,
    CASE WHEN class = 'video' AND doc_id % 13 = 0 THEN 'smpte2084' END AS color_transfer, CASE WHEN class = 'video' AND doc_id % 17 = 0 THEN 'bt2020nc' END AS color_primaries, CAST(NULL AS VARCHAR) AS color_space
  FROM classed WHERE class IS NOT NULL AND NOT system_junk AND NOT sidecar)"""


MEDIA = _media_sql()


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their content: path, size, mtime, content."""
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.octet_length("text").cast("long").alias("size"), (F.lit(1_700_000_000) + F.col("doc_id") * 7919 % 10_000_000).alias("mtime"), F.col("text").alias("content"))


CANDIDATES = "candidates AS (SELECT '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS size, 1700000000 + doc_id * 7919 % 10000000 AS mtime, text AS content FROM documents WHERE text IS NOT NULL)"


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidates, some of which have grown, or can't be read any more, since they were listed."""
    c = F.col("content")
    return candidates(spark, sf_dir).withColumn("content", F.when(F.col("mtime") % 13 == 0, F.concat(c, F.lit("x"))).when(F.col("mtime") % 17 != 0, c))


CHANGED = CANDIDATES.replace("text AS content", "CASE WHEN mtime % 13 = 0 THEN text || 'x' WHEN mtime % 17 <> 0 THEN text END AS content")
#: What each lane of a 256-bit print adds to the mean that numbers are compared with.
LANE_OFFSETS = (0.203125, 0.1875, -0.1875, -0.203125)
LANES = [f"fp{k}" for k in range(len(LANE_OFFSETS))]


def fingerprints(spark: SparkSession, sf_dir: str, offsets: tuple[float, ...] = (0.0,)) -> DataFrame:
    """Prints of the embeddings, 64 bits a lane: path, size, label, fp0 and a lane for each further offset."""
    from cairnspark.functions.bits import mean_print

    vec = table(spark, sf_dir, "embeddings")
    values = F.transform("embedding", lambda x: x.cast("double"))
    return vec.select(F.concat(F.lit("/vec/"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("path"), (F.col("vec_id") * 37 % 1000 + 100).alias("size"), F.col("label").cast("long").alias("label"), *(mean_print(values, offset=o).alias(n) for n, o in zip(LANES, offsets, strict=False)))


def _lane_sql(offset: float) -> str:
    bits = f"list_transform(range(0, 64), lambda i: CASE WHEN CAST(embedding[i + 1] AS DOUBLE) > mean + {offset}::DOUBLE THEN CAST(1 AS UBIGINT) << CAST(i AS UBIGINT) ELSE CAST(0 AS UBIGINT) END)"
    return f"CAST(list_sum({bits}) AS UBIGINT)"


def fingerprints_sql(offsets: tuple[float, ...]) -> str:
    return f"""means AS (SELECT vec_id, label, embedding, list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda a, b: a + b) / len(embedding) AS mean FROM embeddings),
fingerprints AS (
  SELECT '/vec/' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS path, vec_id * 37 % 1000 + 100 AS size, CAST(label AS BIGINT) AS label,
    {", ".join(f"{_lane_sql(o)} AS {n}" for n, o in zip(LANES, offsets, strict=False))}
  FROM means)"""


FINGERPRINTS = fingerprints_sql((0.0,))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work queue: a row for each order line."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    flag, n = F.col("l_returnflag"), F.col("l_linenumber")
    status = F.when(flag == "A", "done").when((flag == "R") & (n % 2 == 0), "failed").when(flag == "R", "skipped").when((F.col("o_orderstatus") == "P") & (n % 2 == 0), "running").otherwise("pending")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("status", status)
    done, skipped, failed = (F.col("status") == s for s in ("done", "skipped", "failed"))
    return rows.select(
        (F.col("l_orderkey") * 8 + n).alias("id"), (F.col("o_custkey") % 8).alias("job_id"),
        F.concat(F.lit("/vol/o"), F.col("l_orderkey").cast("string"), F.lit("/"), n.cast("string"), F.lit(".jpg")).alias("src_path"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("src_size"), (F.lit(1_700_000_000) + F.col("l_partkey")).alias("src_mtime"),
        F.when(n % 3 == 0, "video").when(n % 3 == 1, "image").otherwise("audio").alias("kind"), "status",
        F.when(skipped, F.when(F.col("l_suppkey") % 3 == 0, "no_gain").when(F.col("l_suppkey") % 3 == 1, "low_quality")).alias("skip_reason"),
        F.when(done, F.concat(F.lit("/out/o"), F.col("l_orderkey").cast("string"), F.lit("/"), n.cast("string"), F.lit(".avif"))).alias("dst_path"),
        F.when(done, F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 20).cast("long")).alias("dst_size"),
        F.when(done, (F.col("l_quantity") * 100).cast("long")).alias("elapsed_ms"), F.lit(0).alias("attempt"),
        F.when(failed, "io").alias("error_code"), F.when(failed, "read failed").alias("error_msg"), F.col("l_quantity").cast("double").alias("est_secs"),
    )


ITEMS = """items AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, o_custkey % 8 AS job_id, '/vol/o' || l_orderkey || '/' || l_linenumber || '.jpg' AS src_path,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS src_size, 1700000000 + l_partkey AS src_mtime,
    CASE l_linenumber % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'image' ELSE 'audio' END AS kind, status,
    CASE WHEN status = 'skipped' THEN CASE l_suppkey % 3 WHEN 0 THEN 'no_gain' WHEN 1 THEN 'low_quality' END END AS skip_reason,
    CASE WHEN status = 'done' THEN '/out/o' || l_orderkey || '/' || l_linenumber || '.avif' END AS dst_path,
    CASE WHEN status = 'done' THEN CAST(round(l_extendedprice * (1 - l_discount) * 20) AS BIGINT) END AS dst_size,
    CASE WHEN status = 'done' THEN CAST(trunc(l_quantity * 100) AS BIGINT) END AS elapsed_ms, 0 AS attempt,
    CASE WHEN status = 'failed' THEN 'io' END AS error_code, CASE WHEN status = 'failed' THEN 'read failed' END AS error_msg, CAST(l_quantity AS DOUBLE) AS est_secs
  FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN 'done' WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 'failed' WHEN l_returnflag = 'R' THEN 'skipped'
      WHEN o_orderstatus = 'P' AND l_linenumber % 2 = 0 THEN 'running' ELSE 'pending' END AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs of the queue's items in the states that a restart may find."""
    k = F.col("id")
    status = F.when(k % 4 == 0, "running").when(k % 4 == 1, "paused").when(k % 4 == 2, "done").otherwise("scanning")
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 8).alias("id")).distinct().select(k, F.concat(F.lit("job "), k.cast("string")).alias("name"), status.alias("status"), (k * 1000 + 1_700_000_000).alias("created_at"), F.when(status == "done", k * 1000 + 1_700_000_500).alias("finished_at"))


JOBS = """jobs AS (
  SELECT id, 'job ' || id AS name, status, id * 1000 + 1700000000 AS created_at, CASE WHEN status = 'done' THEN id * 1000 + 1700000500 END AS finished_at
  FROM (SELECT DISTINCT o_custkey % 8 AS id, ['running', 'paused', 'done', 'scanning'][o_custkey % 8 % 4 + 1] AS status FROM orders))"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of changes: seq, type, id, dst_path, dst_size, elapsed_ms, code, msg, reason."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "requeued").when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "click", "done").when(F.col("event_type") == "purchase", "skipped").otherwise("failed")
    return e.select(
        F.col("event_id").alias("seq"), kind.alias("type"), F.col("user_id").alias("id"), F.when(kind == "done", F.concat(F.lit("/out/"), F.col("user_id").cast("string"))).alias("dst_path"),
        F.when(kind == "done", F.round(F.col("value") * 100).cast("long")).alias("dst_size"), F.when(kind == "done", F.col("event_id") % 1000).alias("elapsed_ms"),
        F.when(kind == "failed", "io").alias("code"), F.when(kind == "failed", F.col("props")).alias("msg"), F.when(kind == "skipped", "no_gain").alias("reason"),
    )


RESULTS = """results AS (
  SELECT event_id AS seq, type, user_id AS id, CASE WHEN type = 'done' THEN '/out/' || user_id END AS dst_path, CASE WHEN type = 'done' THEN CAST(round(value * 100) AS BIGINT) END AS dst_size,
    CASE WHEN type = 'done' THEN event_id % 1000 END AS elapsed_ms, CASE WHEN type = 'failed' THEN 'io' END AS code, CASE WHEN type = 'failed' THEN props END AS msg, CASE WHEN type = 'skipped' THEN 'no_gain' END AS reason
  FROM (SELECT *, CASE event_type WHEN 'view' THEN 'requeued' WHEN 'signup' THEN 'started' WHEN 'click' THEN 'done' WHEN 'purchase' THEN 'skipped' ELSE 'failed' END AS type FROM events))"""


def cache_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes to a cache: seq, path, algo, size, mtime, hash."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), F.when(F.col("user_id") % 2 == 0, "full").otherwise("ahash").alias("algo"), F.floor(F.col("value") / 10).cast("long").alias("size"), F.unix_timestamp("ts").alias("mtime"), F.md5(F.col("props")).alias("hash"))


CACHE_PUTS = "cache_puts AS (SELECT event_id AS seq, '/u/' || user_id AS path, CASE WHEN user_id % 2 = 0 THEN 'full' ELSE 'ahash' END AS algo, CAST(floor(value / 10) AS BIGINT) AS size, CAST(floor(epoch(ts)) AS BIGINT) AS mtime, md5(props) AS hash FROM events)"
