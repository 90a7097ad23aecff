"""More queries: job and run rows, caches, the feeder, descriptions, settings, streams. With catalog's, the whole list."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.functions import bits, display, media, naming, probe
from cairnspark.functions import estimate as est
from cairnspark.functions import policy as pol
from cairnspark.functions.paths import media_kind
from cairnspark.operators import exact, jobs, near, queue, review, scan
from cairnspark.plans import adapters as v
from cairnspark.plans.catalog import ORACLE, QUERIES, WINDOW, _FOLD, _PLANNED, blank_items, members, planned, probe_json, query, tiers
from cairnspark.plans.checkpoint import cut, shared_dir
from cairnspark.sources import corpus, files, tree
from cairnspark.streaming import bookkeeping

__all__ = ["ORACLE", "QUERIES"]

NOW = 1_800_000_000
#: Folders that the files of a scan lie in, below each root.
FOLDERS = 256


# --- caches -------------------------------------------------------------------------------------------------------


def _cached_hashes(c: DataFrame) -> DataFrame:
    """A cache that knows some files, some of them as they were before."""
    stale = F.when(F.col("mtime") % 3 == 0, 1).otherwise(0)
    known = c.where("mtime % 5 <> 0").select("path", (F.col("mtime") - stale).alias("mtime"), F.octet_length("content").cast("long").alias("size"), F.md5("content").alias("hash"))
    return known.select("path", F.lit(bits.FULL_HASH_ALGO).alias("algo"), "size", "mtime", "hash").where("hash IS NOT NULL")


_HIT = "(mtime % 5 <> 0 AND mtime % 3 <> 0)"
_CACHED = tiers(v.CHANGED, f"CASE WHEN {_HIT} THEN md5(content) ELSE sha256(content) END")


@query(f"""{_CACHED} SELECT group_rank, r.hash, r.size, files, CAST(reclaimable AS BIGINT) AS reclaimable, row_number() OVER (PARTITION BY r.hash, r.size ORDER BY string_split(path, '/')) AS member_rank, path, mtime
FROM r JOIN t3 ON r.hash = t3.hash AND r.size = t3.size""")
def cached_cascade(spark, sf_dir):
    c = v.changed(spark, sf_dir)
    return exact.cached_cascade(c, _cached_hashes(c), WINDOW)[0]


@query(f"""{_CACHED}, big AS (SELECT *, {_HIT} AS hit FROM t2 WHERE size > {2 * WINDOW})
SELECT (SELECT count(*) FROM g) AS groups, (SELECT CAST(coalesce(sum(reclaimable), 0) AS BIGINT) FROM g) AS reclaimable, (SELECT count(*) FROM big) AS hashed, (SELECT count(*) FILTER (hit) FROM big) AS cache_hits,
 (SELECT count(*) FROM s WHERE sample IS NULL) AS errors, (SELECT count(*) FROM big WHERE NOT hit) AS puts""")
def dedup_run_summary(spark, sf_dir):
    c = v.changed(spark, sf_dir)
    rows, hashed, puts, counts = exact.counted_cascade(c, _cached_hashes(c), WINDOW)
    groups = cut(rows).where("member_rank = 1").select("reclaimable")
    one = review.run_summary(groups, hashed)
    return one.crossJoin(counts.select("errors")).crossJoin(puts.agg(F.count("*").alias("puts")))


_PRINTED = f"WITH {v.fingerprints_sql(v.LANE_OFFSETS)}, p AS (SELECT path, size, size % 7 AS k, fp0, fp1, fp2, fp3 FROM fingerprints)"


@query(f"""{_PRINTED} SELECT path, CAST(k IN (1, 2) AS BOOLEAN) AS hit, CAST(CASE WHEN k IN (1, 2) THEN 8 ELSE bit_count(fp0) END AS BIGINT) AS bits0, CAST(CASE WHEN k IN (1, 2) THEN 8 ELSE bit_count(fp3) END AS BIGINT) AS bits3 FROM p WHERE k <> 6""")
def fingerprint_stage(spark, sf_dir):
    p, k = v.fingerprints(spark, sf_dir, v.LANE_OFFSETS).withColumn("mtime", F.col("size") + 5), F.col("size") % 7
    computed = F.when(k < 5, bits.to_hex([F.col(x) for x in v.LANES])).when(k == 5, bits.to_hex([F.col(x) for x in v.LANES]))
    entry = F.when(k.isin(1, 2), F.repeat(F.lit("00000000000000ff"), 4)).when(k == 3, "broken").otherwise(F.repeat(F.lit("0"), 64))
    # 0: known as it was before; 1, 2: known; 3: corrupt; 4: under another algorithm; 5: unknown; 6: can't be read
    cache = p.where(k < 5).select("path", F.when(k == 4, "older").otherwise(bits.PRINT_ALGO).alias("algo"), "size", (F.col("mtime") - F.when(k == 0, 1).otherwise(0)).alias("mtime"), entry.alias("hash"))
    out = near.cached_prints(p.select("path", "size", "mtime", computed.alias("_digits")), cache, F.col("_digits"))
    return out.select("path", "hit", F.bit_count("fp0").cast("long").alias("bits0"), F.bit_count("fp3").cast("long").alias("bits3"))


@query("SELECT vec_id AS id, round(list_aggregate(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), 'stddev_pop'), 6) AS spread, round(list_aggregate(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), 'stddev_pop'), 6) >= 0.124 AS has_content FROM embeddings")
def content_spread(spark, sf_dir):
    s = F.round(bits.spread(F.transform("embedding", lambda x: x.cast("double"))), 6)
    return v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), s.alias("spread"), (s >= 0.124).alias("has_content"))


_M = "CAST(18446744073709551615 AS HUGEINT)"


@query(f"""WITH RECURSIVE s AS (SELECT 0 AS k, CAST({corpus.FIRST_STATE} AS HUGEINT) AS x UNION ALL SELECT k + 1, xor(c, (c << 17) & {_M}) FROM (SELECT k, xor(b, b >> 7) AS c FROM (SELECT k, xor(x, (x << 13) & {_M}) AS b FROM s WHERE k < (SELECT count(*) * 4 FROM embeddings))))
SELECT '/rnd/' || lpad(CAST((k - 1) // 4 AS VARCHAR), 9, '0') AS path, CAST((k - 1) % 4 AS INTEGER) AS lane, lower(printf('%016X', CAST(x AS UBIGINT))) AS hex FROM s WHERE k > 0""")
def random_prints(spark, sf_dir):
    """As many random prints as there are vectors."""
    p = corpus.random_prints(spark, v.table(spark, sf_dir, "embeddings").count())
    return p.select("path", F.posexplode(F.array(*(F.lower(F.lpad(F.hex(x), 16, "0")) for x in v.LANES))).alias("lane", "hex"))


# --- rows of jobs and runs ----------------------------------------------------------------------------------------

_FULL_JOBS = f"{v.JOBS}, full_jobs AS (SELECT id, name, CAST(NULL AS VARCHAR) AS roots_json, CAST(NULL AS VARCHAR) AS output_root, CAST(NULL AS VARCHAR) AS profile_json, status, created_at, finished_at, CAST(NULL AS BIGINT) AS est_out_bytes FROM jobs)"


def full_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = {c: F.lit(None).cast("string") for c in ("roots_json", "output_root", "profile_json")}
    rows = v.jobs(spark, sf_dir).withColumns({**none, "est_out_bytes": F.lit(None).cast("long")})
    return rows.select(*(c.split()[0] for c in jobs.JOBS.split(", ")))


ROOT_LIST = ["/vol/照片", "/vol/b/", "/x/照片"]
_ROOTS_JSON = json.dumps(ROOT_LIST, ensure_ascii=False).replace("'", "''")


@query(f"""WITH {_FULL_JOBS} SELECT * REPLACE (CASE WHEN id = 4 THEN 5000 ELSE est_out_bytes END AS est_out_bytes, CASE WHEN id = 5 THEN '/out' ELSE output_root END AS output_root) FROM full_jobs WHERE status = 'running'
UNION ALL SELECT 8, '照片、b', '{_ROOTS_JSON}', NULL, '{pol.Profile().to_json()}', 'scanning', {NOW}, NULL, NULL""")
def open_job(spark, sf_dir):
    after, _, _ = jobs.open_job(full_jobs(spark, sf_dir), v.items(spark, sf_dir), ROOT_LIST, pol.Profile(), NOW)
    return jobs.set_output_root(jobs.set_estimate(after, 4, 5000), 5, "/out")


@query(f"WITH {v.JOBS}, {v.ITEMS} SELECT job_id, count(*) AS n FROM items WHERE job_id IN (SELECT id FROM jobs WHERE status = 'running') GROUP BY job_id")
def open_job_items(spark, sf_dir):
    return jobs.open_job(full_jobs(spark, sf_dir), v.items(spark, sf_dir), ROOT_LIST, pol.Profile(), NOW)[1].groupBy("job_id").agg(F.count("*").alias("n"))


@query(f"""SELECT DISTINCT o_custkey % 8 AS id, '["/vol/' || (o_custkey % 8) || '", "/vol"]' AS roots_json, CASE WHEN o_custkey % 2 = 0 THEN 'exact' ELSE 'perceptual' END AS mode, 'scanning' AS status,
  CASE WHEN o_custkey % 2 = 1 THEN 16 END AS threshold, {NOW}::BIGINT AS created_at, NULL::BIGINT AS finished_at FROM orders""")
def create_runs(spark, sf_dir):
    """A run for each job of the queue; their ids are few."""
    out = None
    for (k,) in v.jobs(spark, sf_dir).select("id").orderBy("id").collect():
        run = jobs.create_run(spark, k, [f"/vol/{k}", "/vol", f"/vol/{k}"], "perceptual" if k % 2 else "exact", NOW, pol.clamp_threshold(None))
        out = run if out is None else out.unionByName(run)
    return out


_ALL = f"{tiers(v.CANDIDATES)}, mem AS (SELECT row_number() OVER (ORDER BY group_rank, string_split(path, '/')) + 500 AS id, group_rank + 70 AS group_id, path, r.size, mtime, 0::BIGINT AS distance, 1 AS keep, NULL::VARCHAR AS disposal, r.hash, reclaimable FROM r JOIN t3 ON r.hash = t3.hash AND r.size = t3.size)"


def _saved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = exact.groups(v.candidates(spark, sf_dir), WINDOW).withColumn("distance", F.lit(0).cast("long"))
    return jobs.save_groups(cut(rows), 9, 71, 501)


@query(f"{_ALL} SELECT DISTINCT group_id AS id, 9::BIGINT AS run_id, hash, CAST(reclaimable AS BIGINT) AS reclaimable FROM mem")
def saved_groups(spark, sf_dir):
    return _saved(spark, sf_dir)[0]


@query(f"{_ALL} SELECT id, group_id, path, size, mtime, distance, keep, disposal FROM mem")
def saved_members(spark, sf_dir):
    return _saved(spark, sf_dir)[1]


@query(f"""{_ALL}, page AS (SELECT DISTINCT group_id, hash, CAST(reclaimable AS BIGINT) AS reclaimable FROM mem ORDER BY reclaimable DESC, group_id LIMIT 10 OFFSET 5)
SELECT group_id AS id, any_value(p.hash) AS hash, any_value(p.reclaimable) AS reclaimable, count(*) AS members, string_agg(path, ',' ORDER BY mem.id) AS paths FROM page p JOIN mem USING (group_id) GROUP BY group_id""")
def dedup_group_page(spark, sf_dir):
    g, m = _saved(spark, sf_dir)
    page = review.group_page(g, m, 10, 5)
    return page.select("id", "hash", "reclaimable", F.size("members").cast("long").alias("members"), F.array_join(F.transform("members", lambda x: x["path"]), ",").alias("paths"))


@query(f"""{_ALL} SELECT (SELECT count(DISTINCT group_id % 3) FROM mem WHERE group_id % 3 <> 0) AS runs, (SELECT count(DISTINCT group_id) FROM mem WHERE group_id % 3 <> 0) AS groups,
  (SELECT count(*) FROM mem WHERE group_id % 3 <> 0) AS members""")
def delete_run(spark, sf_dir):
    runs = _saved(spark, sf_dir)[0].select((F.col("id") % 3).alias("id")).distinct()
    g, m = _saved(spark, sf_dir)
    parts = jobs.delete_run(runs, g.withColumn("run_id", F.col("id") % 3), m, 0)
    return parts[0].agg(F.count("*").alias("runs")).crossJoin(parts[1].agg(F.count("*").alias("groups"))).crossJoin(parts[2].agg(F.count("*").alias("members")))


@query(f"""{tiers(v.CANDIDATES)}, kept AS (SELECT row_number() OVER (ORDER BY group_rank, string_split(path, '/')) AS id, group_rank AS group_id, path, mtime, r.size, CASE WHEN group_rank % 7 = 0 THEN 0 ELSE 1 END AS keep, CASE WHEN mtime % 11 = 0 THEN 'trashed' END AS disposal FROM r JOIN t3 ON r.hash = t3.hash AND r.size = t3.size)
SELECT group_id, CASE WHEN keep = 1 THEN 'keep' ELSE 'remove' END AS action, id, path, size, mtime FROM kept WHERE disposal IS NULL AND group_id IN (SELECT group_id FROM kept WHERE disposal IS NULL AND keep = 0)""")
def delete_rows(spark, sf_dir):
    return review.delete_rows(members(spark, sf_dir))


# --- work -----------------------------------------------------------------------------------------------------------

def _single(items: DataFrame) -> DataFrame:
    """Items without those whose id stands in several rows."""
    return items.join(items.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").select("id"), "id", "left_semi")


_SINGLE = f"{v.ITEMS}, single AS (SELECT * FROM items QUALIFY count(*) OVER (PARTITION BY id) = 1)"
_SEEN = "CASE WHEN id % 9 = 0 THEN 'src_missing' WHEN id % 9 = 1 THEN 'src_changed' END"


@query(f"""WITH {_SINGLE}, b AS (SELECT id, src_path, kind, est_secs, coalesce({_SEEN}, skip_reason) AS reason, '/out/' || (id % 5) || '.' || CASE kind WHEN 'image' THEN 'avif' WHEN 'video' THEN 'mp4' ELSE 'm4a' END AS dst
  FROM (SELECT * REPLACE (CASE WHEN id % 7 = 3 THEN 'too_small' END AS skip_reason) FROM single) WHERE job_id = 3 AND status = 'pending' AND kind IN ('image', 'audio') AND id > 1000 ORDER BY id LIMIT 200),
n AS (SELECT *, row_number() OVER (PARTITION BY dst, reason IS NULL ORDER BY id) - CASE WHEN dst = '/out/2.avif' THEN 0 ELSE 1 END AS k FROM b)
SELECT id, src_path, kind, est_secs, CASE WHEN reason IS NULL THEN 'dispatch' ELSE 'skip' END AS action, reason, CASE WHEN reason IS NULL THEN CASE WHEN k = 0 THEN dst ELSE regexp_replace(dst, '(\\.[^.]*)$', '-' || k || '\\1') END END AS dst FROM n""")
def feed_batch(spark, sf_dir):
    items = _single(v.items(spark, sf_dir)).withColumn("skip_reason", F.when(F.col("id") % 7 == 3, "too_small"))
    n = F.col("id") % 9
    now = items.where(n != 0).select(F.col("src_path").alias("path"), (F.col("src_size") + F.when(n == 1, 1).otherwise(0)).alias("size"), F.col("src_mtime").alias("mtime"))
    taken = spark.createDataFrame([("/out/2.avif",)], "dst string")
    at = F.element_at(F.split("src_path", "[/.]"), -2).cast("long") + F.substring(F.element_at(F.split("src_path", "/"), -2), 2, 20).cast("long") * 8
    dst = F.concat(F.lit("/out/"), (at % 5).cast("string"), F.lit("."), F.when(F.col("kind") == "image", "avif").when(F.col("kind") == "video", "mp4").otherwise("m4a"))
    return queue.feed(items, now, 3, ["image", "audio"], 1000, dst, taken, 200)


@query(f"""WITH {_SINGLE}, j AS (SELECT id, CASE WHEN status <> 'pending' THEN status WHEN {_SEEN} IS NOT NULL OR skip_reason IS NOT NULL THEN 'skipped' WHEN id % 4 = 0 THEN 'failed' ELSE 'done' END AS status,
  CASE WHEN status <> 'pending' THEN skip_reason WHEN {_SEEN} IS NOT NULL THEN {_SEEN} WHEN skip_reason IS NULL AND id % 4 > 0 THEN NULL ELSE skip_reason END AS skip_reason, CASE WHEN status = 'pending' AND {_SEEN} IS NULL AND skip_reason IS NULL AND id % 4 > 0 THEN '/out/' || id ELSE dst_path END AS dst_path
  FROM (SELECT * REPLACE (CASE WHEN id % 7 = 3 THEN 'too_small' ELSE skip_reason END AS skip_reason) FROM single) WHERE job_id = 3)
SELECT 'done' AS job_status, status, skip_reason, count(*) AS n, count(dst_path) AS written, CAST(sum(strlen(dst_path)) AS BIGINT) AS path_bytes FROM j GROUP BY status, skip_reason""")
def job_run(spark, sf_dir):
    items = cut(_single(v.items(spark, sf_dir)).withColumn("skip_reason", F.when(F.col("id") % 7 == 3, "too_small").otherwise(F.col("skip_reason"))))
    n = F.col("id") % 9
    now = items.where(n != 0).select(F.col("src_path").alias("path"), (F.col("src_size") + F.when(n == 1, 1).otherwise(0)).alias("size"), F.col("src_mtime").alias("mtime"))

    def work(fed: DataFrame) -> DataFrame:
        bad = F.col("id") % 4 == 0
        return fed.select(
            F.lit(0).cast("long").alias("seq"), F.when(bad, "failed").otherwise("done").alias("type"), "id", F.when(~bad, F.col("dst")).alias("dst_path"), F.when(~bad, F.length("dst")).cast("long").alias("dst_size"),
            F.lit(1).cast("long").alias("elapsed_ms"), F.when(bad, "io").alias("code"), F.when(bad, "broken").alias("msg"), F.lit(None).cast("string").alias("reason"),
        )

    done, status = queue.run_job(items, now, 3, F.concat(F.lit("/out/"), F.col("id").cast("string")), work, 2000)
    g = done.where("job_id = 3").groupBy("status", "skip_reason").agg(F.count("*").alias("n"), F.count("dst_path").alias("written"), F.sum(F.octet_length("dst_path")).cast("long").alias("path_bytes"))
    return g.select(F.lit(status).alias("job_status"), "status", "skip_reason", "n", "written", "path_bytes")


@query(f"WITH {v.ITEMS} SELECT src_path, CASE WHEN status = 'done' THEN dst_path ELSE '/out' || src_path END AS dst, status = 'done' AS transformed FROM items WHERE status IN ('done', 'skipped')")
def mirror_tree(spark, sf_dir):
    return queue.preserve_originals(v.items(spark, sf_dir), F.concat(F.lit("/out"), F.col("src_path")))


@query(f"""WITH {v.ITEMS}, sc AS (SELECT id, unnest([id % 90, id % 70, id % 50]) + 10.0::DOUBLE AS score FROM items WHERE id % 4 <> 0),
m AS (SELECT id, avg(score) AS score, count(*) AS windows FROM sc GROUP BY id)
SELECT i.id, regexp_extract(src_path, '[^/]*$') AS name, round(dst_size * 100.0::DOUBLE / src_size, 1) AS percent, round(score, 6) AS score, coalesce(windows, 0) AS windows FROM items i LEFT JOIN m ON i.id = m.id WHERE status = 'done'""")
def quality_report(spark, sf_dir):
    items = v.items(spark, sf_dir)
    windows = F.array(*((F.col("id") % k + 10.0).cast("double") for k in (90, 70, 50)))
    scores = items.where("id % 4 <> 0").select("id", F.posexplode(windows).alias("window", "score"))
    return queue.quality_report(items, scores).withColumn("score", F.round("score", 6))


def _work_dirs(items: DataFrame) -> DataFrame:
    return items.select("job_id", "src_path", F.concat(F.lit("/out/"), F.col("job_id").cast("string"), F.lit("/"), (F.col("id") % 37).cast("string")).alias("dst_dir"))


@query(f"""WITH {v.ITEMS}, d AS (SELECT DISTINCT '/out/' || job_id || '/' || (id % 37) AS dir FROM items WHERE status = 'running' AND id % 5 = 0),
f AS (SELECT '/out/' || (event_id % 8) || '/' || (event_id % 37) AS dir, CASE WHEN event_id % 3 = 0 THEN '.x' || event_id || '.zz-1.tmp' ELSE 'x' || event_id || '.avif' END AS name FROM events)
SELECT f.dir || '/' || name AS path FROM f JOIN d ON f.dir = d.dir WHERE ends_with(name, '.tmp')""")
def orphan_temps(spark, sf_dir):
    items = v.items(spark, sf_dir).withColumn("status", F.when((F.col("status") == "running") & (F.col("id") % 5 != 0), "pending").otherwise(F.col("status")))
    n = F.col("event_id")
    name = F.when(n % 3 == 0, F.concat(F.lit(".x"), n.cast("string"), F.lit(".zz-1.tmp"))).otherwise(F.concat(F.lit("x"), n.cast("string"), F.lit(".avif")))
    found = v.table(spark, sf_dir, "events").select(F.concat(F.lit("/out/"), (n % 8).cast("string"), F.lit("/"), (n % 37).cast("string"), F.lit("/"), name).alias("path"))
    return queue.recover_all(v.jobs(spark, sf_dir), items, _work_dirs(items), found)[2]


@query(f"""WITH {_SINGLE}, x AS (SELECT *, status = 'running' AND id % 3 = 0 AS flies, CASE WHEN status = 'running' AND id % 3 = 0 THEN (id % 4) / 4.0::DOUBLE END AS part FROM single),
s AS (SELECT job_id, kind = 'video' AS video, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (flies) AS flying,
  coalesce(sum(est_secs) FILTER (status IN ('pending', 'running')), 0) - coalesce(sum(est_secs * part), 0) AS rem, coalesce(sum(est_secs) FILTER (status = 'done'), 0) + coalesce(sum(est_secs * part), 0) AS did,
  (coalesce(sum(elapsed_ms) FILTER (status = 'done'), 0) + coalesce(sum(id % 977) FILTER (part > 0), 0)) / 1000.0::DOUBLE AS act FROM x GROUP BY 1, 2),
c AS (SELECT job_id, video, pending, rem * CASE WHEN did >= 5 AND act > 0 THEN act / did ELSE 1 END AS left_s FROM s)
SELECT job_id, CAST(sum(pending) AS BIGINT) AS pending, round(sum(left_s / CASE WHEN video THEN 1.21::DOUBLE ELSE {8**0.9!r}::DOUBLE END), 4) AS eta FROM c GROUP BY job_id""")
def time_left_in_flight(spark, sf_dir):
    items = _single(v.items(spark, sf_dir))
    flying = items.where("status = 'running' AND id % 3 = 0").select("id", ((F.col("id") % 4) / 4.0).alias("fraction"), (F.col("id") % 977).alias("elapsed_ms"))
    return queue.time_left(items, progress=flying).withColumn("eta", F.round("eta", 4))


# --- descriptions and probes ----------------------------------------------------------------------------------------


@query(f"""WITH {v.MEDIA}, m AS (SELECT *, CASE WHEN class IN ('image', 'modern_image', 'raw_image') THEN 'image' ELSE class END AS kind, CASE doc_id % 3 WHEN 0 THEN 'public.' || lower(ext) WHEN 1 THEN 'org.webmproject.webp' END AS uti FROM media)
SELECT path, kind, size AS size_bytes, width, height, CASE WHEN kind = 'image' THEN CASE doc_id % 3 WHEN 0 THEN upper(ext) WHEN 1 THEN 'WEBP' ELSE upper(ext) END
  ELSE CASE codec WHEN 'h264' THEN 'H.264' WHEN 'hevc' THEN 'HEVC' WHEN 'mpeg4' THEN 'MPEG-4' ELSE upper(codec) END END AS format,
  CASE WHEN kind <> 'image' AND duration_us > 0 THEN size * 8000000 // duration_us END AS bitrate_bps, CASE WHEN kind <> 'image' THEN duration_us END AS duration_us FROM m""")
def media_spec(spark, sf_dir):
    m = v.media(spark, sf_dir)
    uti = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("public."), F.lower("ext"))).when(F.col("doc_id") % 3 == 1, "org.webmproject.webp")
    d = media.describe(F.col("path"), F.col("size"), F.col("width"), F.col("height"), uti, F.col("codec"), F.col("duration_us"))
    return m.select("path", *(c.alias(n) for n, c in d.items()))


def _png(w, h):
    """The first bytes of a picture of this size."""
    side = lambda x: F.unhex(F.lpad(F.hex(x.cast("long")), 8, "0"))
    return F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), side(w), side(h), F.unhex(F.lit("0802000000")))


@query(f"""WITH {v.MEDIA} SELECT path, class, CASE WHEN class IN ('video', 'audio') THEN CASE WHEN doc_id % 29 = 0 OR doc_id % 4 = 3 THEN 0 ELSE width END WHEN doc_id % 6 = 5 THEN 0 ELSE doc_id % 5000 + 1 END AS width,
  CASE WHEN class IN ('video', 'audio') THEN CASE WHEN doc_id % 29 = 0 OR doc_id % 4 = 3 THEN 0 ELSE height END WHEN doc_id % 6 = 5 THEN 0 ELSE doc_id % 3000 + 1 END AS height FROM media""")
def batch_analyze(spark, sf_dir):
    m, d = probe_json(v.media(spark, sf_dir)), F.col("doc_id")
    found = m.select("path", "size", "mtime", F.when(d % 6 != 5, _png(d % 5000 + 1, d % 3000 + 1)).otherwise(F.lit(b"no picture")).alias("content"))
    cache = m.where("doc_id % 4 IN (0, 1)").select("path", "size", (F.col("mtime") - F.when(d % 4 == 1, 1).otherwise(0)).alias("mtime"), "probe_json")
    probed = m.where("doc_id % 4 IN (1, 2)").select("path", "probe_json")
    return scan.analyze(found, cache, probed).select("path", "class", "width", "height")


_LINES = "lines AS (SELECT user_id AS process, event_id AS seq, CASE event_id % 6 WHEN 0 THEN 'frame=' || event_id WHEN 1 THEN 'fps=N/A' WHEN 2 THEN 'out_time_' || CASE WHEN event_id % 4 = 0 THEN 'us' ELSE 'ms' END || '=' || event_id * 10 WHEN 3 THEN 'speed=' || (event_id % 50) || '.5x' WHEN 4 THEN 'noise' ELSE 'progress=' || CASE WHEN event_id % 7 = 0 THEN 'end' ELSE 'continue' END END AS line FROM events)"


@query(f"""WITH {_LINES}, k AS (SELECT process, seq, string_split(line, '=')[1] AS key, string_split(line, '=')[2] AS value FROM lines),
f AS (SELECT process, seq, key, last_value(CASE WHEN key = 'frame' THEN TRY_CAST(value AS BIGINT) END IGNORE NULLS) OVER w AS frame, last_value(CASE WHEN key = 'fps' THEN TRY_CAST(value AS DOUBLE) END IGNORE NULLS) OVER w AS fps,
  last_value(CASE WHEN key IN ('out_time_us', 'out_time_ms') THEN TRY_CAST(value AS BIGINT) END IGNORE NULLS) OVER w AS out_time_us, CAST(NULL AS BIGINT) AS total_size, last_value(CASE WHEN key = 'speed' THEN TRY_CAST(rtrim(value, 'x') AS DOUBLE) END IGNORE NULLS) OVER w AS speed, value = 'end' AS done
  FROM k WINDOW w AS (PARTITION BY process ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT process, seq, frame, fps, out_time_us, total_size, speed, done FROM f WHERE key = 'progress'""")
def progress_frames(spark, sf_dir):
    n = F.col("event_id")
    text = n.cast("string")
    time = F.concat(F.lit("out_time_"), F.when(n % 4 == 0, "us").otherwise("ms"), F.lit("="), (n * 10).cast("string"))
    line = (
        F.when(n % 6 == 0, F.concat(F.lit("frame="), text)).when(n % 6 == 1, "fps=N/A").when(n % 6 == 2, time).when(n % 6 == 3, F.concat(F.lit("speed="), (n % 50).cast("string"), F.lit(".5x")))
        .when(n % 6 == 4, "noise").otherwise(F.concat(F.lit("progress="), F.when(n % 7 == 0, "end").otherwise("continue")))
    )
    return probe.progress_frames(v.table(spark, sf_dir, "events").select(F.col("user_id").alias("process"), n.alias("seq"), line.alias("line")))


@query(f"""WITH {v.MEDIA} SELECT path, CASE WHEN coalesce(color_transfer = 'smpte2084', false) OR coalesce(starts_with(color_primaries, 'bt2020'), false) OR coalesce(codec_tag = 'dvh1', false) THEN 'hdr_unsupported' ELSE 'cpu' END AS route FROM media WHERE class = 'video'""")
def video_routes(spark, sf_dir):
    r = pol.route(F.col("color_transfer"), F.col("color_primaries"), F.col("color_space"), F.col("codec_tag"), pol.Profile())
    return v.media(spark, sf_dir).where("class = 'video'").select("path", r.alias("route"))


def _eta_sql(words: tuple[str, str, str, str]) -> str:
    under, minutes, hours, both = (w.replace("%d", "{}") for w in words)
    return f"CASE WHEN s < 60 THEN '{under}' WHEN m < 60 THEN format('{minutes}', m) WHEN m % 60 = 0 THEN format('{hours}', m // 60) ELSE format('{both}', m // 60, m % 60) END"


@query(f"""SELECT id, {_eta_sql(display.ETA_LONG)} AS long, {_eta_sql(display.ETA_SHORT)} AS short, CASE WHEN b < 1000 THEN b || ' B' WHEN b < 100000 THEN format('{{}}.{{}} KB', t // 10, t % 10) WHEN b < 1000000 THEN format('{{}} KB', r) ELSE format('{{}} MB', r // 1000) END AS bytes,
  CASE WHEN pct > 0 AND pct < 0.1 THEN '<0.1%' WHEN tenth % 10 = 0 THEN format('{{}}%', tenth // 10) ELSE format('{{}}.{{}}%', tenth // 10, tenth % 10) END AS share
FROM (SELECT event_id AS id, event_id % 9000 * 7 AS s, CAST(floor(event_id % 9000 * 7 / 60.0::DOUBLE + 0.5) AS BIGINT) AS m, b, (b + 50) // 100 AS t, (b + 500) // 1000 AS r, pct, CAST(floor(pct * 10 + 0.5) AS BIGINT) AS tenth
  FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN event_id % 1000 WHEN event_id % 3 = 1 THEN event_id * 7 % 99000 + 1000 ELSE event_id % 800 * 1000000 + 100000000 END AS b, CAST(event_id % 1000 AS DOUBLE) / 1500 * 100 AS pct FROM events))""")
def short_texts(spark, sf_dir):
    n = F.col("event_id")
    b = F.when(n % 3 == 0, n % 1000).when(n % 3 == 1, n * 7 % 99_000 + 1000).otherwise(n % 800 * 1_000_000 + 100_000_000)
    s = (n % 9000 * 7).cast("double")
    return v.table(spark, sf_dir, "events").select(
        n.alias("id"), display.eta_text(s).alias("long"), display.eta_text(s, display.ETA_SHORT).alias("short"), display.rounded_bytes_text(b).alias("bytes"), display.share_text((n % 1000).cast("double"), F.lit(1500)).alias("share")
    )


@query("SELECT event_id AS id, round(CASE WHEN q <= 70 THEN 0.62 WHEN q <= 85 THEN 0.62 + (q - 70) * 0.38 / 15 WHEN q <= 95 THEN 1 + (q - 85) * 0.8 / 10 ELSE 1.8 END, 9) AS factor FROM (SELECT event_id, CAST(event_id % 1010 AS DOUBLE) / 10 AS q FROM events)")
def quality_factors(spark, sf_dir):
    n = F.col("event_id")
    return v.table(spark, sf_dir, "events").select(n.alias("id"), F.round(est.quality_factor(n % 1010 / 10), 9).alias("factor"))


@query(f"""WITH {v.FILES}, w AS (SELECT path, substr(repeat('é', CAST(doc_id % 160 AS INTEGER)) || doc_id, 1, CASE WHEN doc_id % 160 >= 125 THEN 125 ELSE 250 - doc_id % 160 END) || '.avif' AS name FROM files)
SELECT path, name, strlen(name) AS bytes FROM w""")
def fitted_names(spark, sf_dir):
    name = F.concat(F.repeat(F.lit("é"), (F.col("doc_id") % 160).cast("int")), F.col("doc_id").cast("string"))
    fitted = naming.fit(name, F.lit(".avif"))
    return v.files(spark, sf_dir).select("path", fitted.alias("name"), F.octet_length(fitted).cast("long").alias("bytes"))


# --- settings and sources -------------------------------------------------------------------------------------------

#: Parts that templates are put together from.
_HEADS, _BODIES, _TAILS = ("", "{srcext}_", "{x}", "a/", "{{", " ", "z-"), ("{name}", "", "{name}}", "{ext}"), (".{ext}", ".{ext}", "", ".jpg")


@query(f"""WITH t AS (
  SELECT DISTINCT {v.sql_list(_HEADS)}[CAST(p_partkey % {len(_HEADS)} + 1 AS INT)] || {v.sql_list(_BODIES)}[CAST(p_partkey // 7 % {len(_BODIES)} + 1 AS INT)] || {v.sql_list(_TAILS)}[CAST(p_partkey // 28 % {len(_TAILS)} + 1 AS INT)] AS template FROM part),
f AS (SELECT template, regexp_extract_all(template, '\\{{([^{{}}]*)\\}}', 1) AS fields, regexp_replace(template, '\\{{([^{{}}]*)\\}}', '', 'g') AS rest FROM t)
SELECT template, trim(template) <> '' AND NOT contains(template, '/') AND NOT contains(rest, '{{') AND NOT contains(rest, '}}') AND len(list_filter(fields, lambda x: x NOT IN ('name', 'ext', 'srcext'))) = 0
  AND list_contains(fields, 'name') AND ends_with(template, '.{{ext}}') AS usable FROM f""")
def template_checks(spark, sf_dir):
    """Templates put together from parts by the keys of the parts table."""
    def pick(values, by):
        return F.get(F.array(*(F.lit(x) for x in values)), F.pmod(F.call_function("div", F.col("p_partkey"), F.lit(by)), F.lit(len(values))).cast("int"))

    template = F.concat(pick(_HEADS, 1), pick(_BODIES, 7), pick(_TAILS, 28))
    return v.table(spark, sf_dir, "part").select(template.alias("template")).distinct().select("template", naming.usable(F.col("template")).alias("usable"))


_VOLUMES = ("ssd", "hdd", "network", "floppy")
_PROFILES = [*(p.to_json() for p in pol.presets().values()), pol.Profile(image=pol.ImageSettings(quality=61)).to_json()]
_PRESETS = [*pol.presets(), "none"]


@query(f"""WITH volumes AS (SELECT DISTINCT l_orderkey, {v.sql_list(_VOLUMES)}[CAST(l_partkey % 4 + 1 AS INT)] AS volume FROM lineitem),
limits AS (SELECT l_orderkey, string_agg(volume, ',' ORDER BY volume) AS given, coalesce(min(CASE volume WHEN 'hdd' THEN 1 WHEN 'network' THEN 4 WHEN 'floppy' THEN 2 END), 0) AS got FROM volumes GROUP BY l_orderkey),
thresholds AS (SELECT CASE WHEN l_linenumber <> 7 THEN CAST(l_quantity AS INTEGER) * 2 - 10 END AS given FROM lineitem)
SELECT 'threshold' AS rule, coalesce(CAST(given AS VARCHAR), 'none') AS given, CAST(greatest(4, least(56, coalesce(given, 16))) AS VARCHAR) AS got, count(*) AS n FROM thresholds GROUP BY given
UNION ALL SELECT 'scan', given, CAST(got AS VARCHAR), count(*) FROM limits GROUP BY given, got
UNION ALL SELECT 'preset', CAST(p_partkey % {len(_PRESETS)} AS VARCHAR), {v.sql_list(_PRESETS)}[CAST(p_partkey % {len(_PRESETS)} + 1 AS INT)], count(*) FROM part GROUP BY p_partkey % {len(_PRESETS)}""")
def setting_rules(spark, sf_dir):
    """Thresholds of quantities, limits of the volumes of each order, and presets of settings that parts have."""
    li, part = v.table(spark, sf_dir, "lineitem"), v.table(spark, sf_dir, "part")
    given = F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("int") * 2 - 10)
    thresholds = li.select(F.lit("threshold").alias("rule"), F.coalesce(given.cast("string"), F.lit("none")).alias("given"), pol.clamped_threshold(given).cast("string").alias("got"))
    volume = F.get(F.array(*(F.lit(x) for x in _VOLUMES)), (F.col("l_partkey") % 4).cast("int"))
    by_order = li.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set(volume)), ",").alias("given"), pol.scan_limit(volume).cast("string").alias("got"))
    limits = by_order.select(F.lit("scan").alias("rule"), "given", "got")
    at = (F.col("p_partkey") % len(_PROFILES)).cast("int")
    name = pol.preset_name(F.get(F.array(*(F.lit(x) for x in _PROFILES)), at))
    named = part.select(F.lit("preset").alias("rule"), at.cast("string").alias("given"), F.coalesce(name, F.lit("none")).alias("got"))
    return thresholds.unionByName(limits).unionByName(named).groupBy("rule", "given", "got").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE c AS (SELECT 0 AS k, 1.0::DOUBLE AS ways UNION ALL SELECT k + 1, ways * (256 - k) / (k + 1) FROM c WHERE k < 100), t AS (SELECT DISTINCT CAST(l_quantity AS INTEGER) * 2 AS t FROM lineitem)
SELECT t AS threshold, round(log10(sum(ways)) - 256 * log10(2), 6) AS log_chance FROM t JOIN c ON k <= t GROUP BY t""")
def collision_chances(spark, sf_dir):
    """Chances at thresholds that quantities give."""
    t = v.table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("int") * 2).alias("threshold")).distinct()
    return t.select("threshold", F.round(F.log10(est.collision_chance(F.col("threshold"))), 6).alias("log_chance"))


@query("""WITH f AS (SELECT DISTINCT l_linenumber AS n FROM lineitem)
SELECT 'own ' || n AS file, CAST(least(n * 20, 100) AS INTEGER) AS quality, 1080 AS cap, CAST(n > 5 AS INTEGER) AS fixes FROM f
UNION ALL SELECT file, 85, 1080, 0 FROM (SELECT unnest(['missing', 'broken']) AS file)""")
def settings_files(spark, sf_dir):
    """Settings saved for each line number, and read back, beside a file that is missing and one that is broken."""
    at = f"{shared_dir(spark)}/settings-{uuid.uuid4().hex}"
    numbers = [r[0] for r in v.table(spark, sf_dir, "lineitem").select("l_linenumber").distinct().collect()]  # a few
    for n in numbers:
        files.save_settings(spark, f"{at}/own {n}.json", pol.Profile())
        files.save_settings(spark, f"{at}/own {n}.json", pol.Profile(image=pol.ImageSettings(quality=20 * n)))
    spark.range(1).coalesce(1).select(F.lit("{").alias("value")).write.text(f"{at}/broken.json")
    rows = []
    for name in (*(f"own {n}" for n in numbers), "missing", "broken"):
        p, fixes = files.load_settings(spark, f"{at}/{name}.json")
        rows.append((name, p.image.quality, p.image.short_edge_cap, len(fixes)))
    return spark.createDataFrame(rows, "file string, quality int, cap int, fixes int")


@query(f"WITH {v.CANDIDATES} SELECT path, size, md5(content) AS hash FROM candidates")
def manifest_round_trip(spark, sf_dir):
    at = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    c = v.candidates(spark, sf_dir).where("content IS NOT NULL").select("path", "size", F.md5("content").alias("hash"))
    c.write.csv(at, sep="\t", header=True)
    return files.read_manifest(spark, at)


@query(f"WITH {v.CANDIDATES} SELECT replace(path, '/', '_') AS name, size + 1 AS size, md5(content || chr(10)) AS hash FROM candidates WHERE size % 4 = 0")
def scanned_files(spark, sf_dir):
    """Documents written as a file each, below two roots, and found again by a scan."""
    at = f"{shared_dir(spark)}/scan-{uuid.uuid4().hex}"
    name = F.coalesce(F.replace("path", F.lit("/"), F.lit("_")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    folder = F.concat(F.lit("half="), (F.col("size") % 8 == 0).cast("string"), F.lit("/"), F.pmod(F.xxhash64("path"), F.lit(FOLDERS)).cast("string"))
    c = v.candidates(spark, sf_dir).where("size % 4 = 0")
    tree.write_files(c.select(F.concat(folder, F.lit("/name="), name).alias("path"), F.concat("content", F.lit("\n")).alias("content"), F.lit(None).alias("mtime")), at)
    roots = [f"{at}/half={x}" for x in ("true", "false", "none")]
    found = files.scan_files(spark, [r for r, state in files.root_access(spark, roots) if state == "ok"], True)
    return found.select(F.regexp_extract("path", "name=([^/]*)", 1).alias("name"), "size", F.md5("content").alias("hash"))


@query("""WITH r AS (SELECT DISTINCT o_custkey AS job_id, '/vol' || (o_orderkey % 3) || '/p' || (o_orderkey % 5) || CASE WHEN o_orderkey % 2 = 0 THEN '/' ELSE '' END AS root FROM orders),
l AS (SELECT job_id, root, regexp_extract(root, '([^/]+)/*$', 1) AS label FROM r), f AS (SELECT job_id, label, min(root) AS first FROM l GROUP BY job_id, label)
SELECT job_id, string_agg(label, '、' ORDER BY first) AS name FROM f GROUP BY job_id""")
def job_names(spark, sf_dir):
    """Names of jobs whose roots are those of a customer's orders."""
    o = F.col("o_orderkey")
    root = F.concat(F.lit("/vol"), (o % 3).cast("string"), F.lit("/p"), (o % 5).cast("string"), F.when(o % 2 == 0, "/").otherwise(""))
    roots = v.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("job_id")).agg(F.sort_array(F.collect_set(root)).alias("roots"))
    return roots.select("job_id", scan.job_names(F.col("roots")).alias("name"))


@query(f"WITH {v.ITEMS} SELECT 'none' AS kinds, 0::BIGINT AS taken UNION ALL SELECT 'image', least(count(*), 32) FROM items WHERE job_id = {3} AND status = 'pending' AND kind = 'image'")
def no_kinds(spark, sf_dir):
    i = v.items(spark, sf_dir)
    taken = {name: queue.take_pending(i, 3, kinds, 0).agg(F.count("*").alias("taken")) for name, kinds in (("none", []), ("image", ["image"]))}
    none, image = (t.select(F.lit(name).alias("kinds"), "taken") for name, t in taken.items())
    return none.unionByName(image)


@query(f"WITH {_PLANNED}, x AS (SELECT skip_reason, size, regexp_replace(path, '/[^/]*$', '') AS d FROM planned) SELECT (SELECT max(b) FROM (SELECT CAST(sum(size) AS BIGINT) AS b FROM x GROUP BY d)) AS largest_dir, (SELECT CAST(sum(size) FILTER (skip_reason IS NOT NULL) AS BIGINT) FROM x) AS left_alone")
def report_scale(spark, sf_dir):
    p = planned(spark, sf_dir)
    dirs = p.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("d")).agg(F.sum("size").alias("bytes"))
    return scan.report_scale(dirs, scan.shown(scan.skip_groups(p)))


# --- streams --------------------------------------------------------------------------------------------------------

_AT = "(CAST(floor(epoch(ts)) AS BIGINT) * 1000)"


@query(f"""SELECT interval, chunk, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (
  SELECT event_id AS id, {_AT} // 500000000 AS interval, (row_number() OVER (PARTITION BY {_AT} // 500000000 ORDER BY event_id) - 1) // 200 AS chunk FROM events) GROUP BY interval, chunk""")
def result_batches(spark, sf_dir):
    e = v.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.unix_timestamp("ts") * 1000).alias("at"))
    b = bookkeeping.result_batches(e, "at", millis=500_000_000)
    return b.groupBy("interval", "chunk").agg(F.count("*").alias("n"), F.min("seq").alias("first_id"), F.max("seq").alias("last_id"))


@query(f"""WITH e AS (SELECT user_id AS id, {_AT} AS millis, event_id AS frame FROM events)
SELECT id, millis, frame FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY millis, frame) AS f, row_number() OVER (PARTITION BY id, millis // 100000000 ORDER BY millis DESC, frame DESC) AS l FROM e) WHERE f = 1 OR l = 1""")
def throttled_frames(spark, sf_dir):
    e = v.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (F.unix_timestamp("ts") * 1000).alias("millis"), F.col("event_id").alias("frame"))
    return bookkeeping.throttled(e, "millis", millis=100_000_000)


@query(f"SELECT count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status IN ('pending', 'running')) AS pending FROM ({_FOLD})")
def stream_counters(spark, sf_dir):
    r = v.results(spark, sf_dir)
    return bookkeeping.counters(bookkeeping.run_to_end(spark, r, blank_items(r)))


@query(_FOLD)
def stream_resumed(spark, sf_dir):
    r = v.results(spark, sf_dir)
    return bookkeeping.run_with_pause(spark, r, blank_items(r))
