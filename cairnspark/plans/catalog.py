"""All queries of the library by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.functions import bits, display, naming, probe
from cairnspark.functions import estimate as est
from cairnspark.functions import policy as pol
from cairnspark.functions.paths import depth, extension, file_name, is_bundle, is_hashable, is_junk, is_skipped_dir, is_temp_file, media_kind, needs_probe, parent, path_key, root_label, stem, target_ext
from cairnspark.operators import exact, near, queue, review, scan
from cairnspark.operators.ranking import row_numbers
from cairnspark.plans import adapters as v
from cairnspark.plans.checkpoint import cut
from cairnspark.sources import corpus
from cairnspark.streaming import bookkeeping

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
PROFILE = pol.Profile()
#: A window that sends documents through every tier; the library's default is for media files.
WINDOW = 1024
THRESHOLD = 18
ROOTS = ["/vol/src1", "/vol/src2/en", "/vol"]
JOB = 3


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.strip()
        return f

    return add


# --- exact duplicates ---------------------------------------------------------------------------------------------


def tiers(candidates: str, known: str = "") -> str:
    """The tiers of the cascade over a view named candidates; known gives the hash of a large file, else its content does."""
    return f"""WITH {candidates},
t1 AS (SELECT * FROM candidates WHERE size IN (SELECT size FROM candidates GROUP BY size HAVING count(*) > 1)),
s AS (SELECT *, CASE WHEN strlen(content) = size THEN sha256(encode(printf('%016X', size)) || encode(content)[1:{WINDOW}] || CASE WHEN size > {WINDOW} THEN encode(content)[-{WINDOW}:] ELSE ''::BLOB END) END AS sample FROM t1),
t2 AS (SELECT * FROM s WHERE sample IS NOT NULL AND (size, sample) IN (SELECT (size, sample) FROM s GROUP BY size, sample HAVING count(*) > 1)),
h AS (SELECT *, CASE WHEN size <= {2 * WINDOW} THEN sample ELSE {known or "sha256(content)"} END AS hash FROM t2),
t3 AS (SELECT * FROM h WHERE (size, hash) IN (SELECT (size, hash) FROM h GROUP BY size, hash HAVING count(*) > 1)),
g AS (SELECT hash, size, count(*) AS files, size * (count(*) - 1) AS reclaimable FROM t3 GROUP BY hash, size),
r AS (SELECT *, row_number() OVER (ORDER BY reclaimable DESC, hash) AS group_rank FROM g)
"""


_TIERS = tiers(v.CANDIDATES)


@query(f"""{_TIERS} SELECT group_rank, r.hash, r.size, files, CAST(reclaimable AS BIGINT) AS reclaimable, row_number() OVER (PARTITION BY r.hash, r.size ORDER BY string_split(path, '/')) AS member_rank, path, mtime
FROM r JOIN t3 ON r.hash = t3.hash AND r.size = t3.size""")
def exact_dup_groups(spark, sf_dir):
    return exact.groups(v.candidates(spark, sf_dir), WINDOW)


@query(f"""{tiers(v.CHANGED)} SELECT (SELECT count(*) FROM candidates) AS candidates, (SELECT count(*) FROM s WHERE sample IS NULL) AS errors, (SELECT count(*) FROM t1) AS after_size, (SELECT count(*) FROM t2) AS after_sample,
 (SELECT count(*) FROM t2 WHERE size > {2 * WINDOW}) AS fully_read, (SELECT count(*) FROM t2 WHERE size <= {2 * WINDOW}) AS sample_was_final,
 (SELECT count(*) FROM g) AS groups, (SELECT CAST(coalesce(sum(files), 0) AS BIGINT) FROM g) AS members""")
def exact_dup_stats(spark, sf_dir):
    return exact.stage_counts(v.changed(spark, sf_dir), WINDOW)


@query(f"""WITH {v.CANDIDATES}, {v.CACHE_PUTS},
c AS (SELECT path, size, mtime, CASE WHEN mtime % 2 = 0 THEN md5(path) END AS cached FROM candidates)
SELECT c.path, coalesce(cached, sha256(content)) AS hash, cached IS NOT NULL AS hit FROM c JOIN candidates USING (path)""")
def hash_cache_lookup(spark, sf_dir):
    files = v.candidates(spark, sf_dir)
    cache = files.where("mtime % 2 = 0").select("path", F.lit("full").alias("algo"), "size", "mtime", F.md5("path").alias("hash"))
    return exact.with_cached_hash(files, cache, "full", bits.full_hash(F.col("content"))).select("path", "hash", "hit")


# --- near duplicates ----------------------------------------------------------------------------------------------


def pairs_sql(offsets: tuple[float, ...], threshold: int) -> str:
    """Views of the prints in order (o) and of the pairs within threshold (e)."""
    d = " + ".join(f"CAST(bit_count(xor(a.fp{k}, b.fp{k})) AS BIGINT)" for k in range(len(offsets)))
    return f"""WITH RECURSIVE {v.fingerprints_sql(offsets)}, o AS (SELECT *, row_number() OVER (ORDER BY string_split(path, '/')) AS ord FROM fingerprints),
e AS (SELECT a.ord AS a, b.ord AS b, CAST({d} AS BIGINT) AS distance FROM o a JOIN o b ON a.ord < b.ord WHERE {d} <= {threshold})"""


_ORD = pairs_sql((0.0,), THRESHOLD)


@query(f"{_ORD} SELECT a, b, distance FROM e")
def hamming_pairs(spark, sf_dir):
    return near.pairs(cut(near.with_order(v.fingerprints(spark, sf_dir))), THRESHOLD, ["fp0"]).select("a", "b", "distance")


_WALK = """,
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS seeds UNION ALL
  SELECT k + 1, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.b = k + 1 AND list_contains(seeds, e.a)) THEN seeds ELSE list_append(seeds, k + 1) END FROM walk WHERE k < (SELECT count(*) FROM o)),
seed AS (SELECT unnest(seeds) AS s FROM (SELECT seeds FROM walk ORDER BY k DESC LIMIT 1)),
m AS (SELECT e.b AS member, min(e.a) AS seed FROM e JOIN seed ON e.a = s WHERE e.b NOT IN (SELECT s FROM seed) GROUP BY e.b),
md AS (SELECT member, seed, distance FROM m JOIN e ON e.a = seed AND e.b = member),
f AS (SELECT member, seed, distance FROM md UNION ALL SELECT DISTINCT seed, seed, -1 FROM md),
freed AS (SELECT seed, CAST(sum(size) AS BIGINT) AS reclaimable FROM md JOIN o ON o.ord = member GROUP BY seed),
gr AS (SELECT seed, reclaimable, row_number() OVER (ORDER BY reclaimable DESC, seed) AS group_rank FROM freed),
near AS (SELECT group_rank, so.path AS seed_path, reclaimable, row_number() OVER (PARTITION BY f.seed ORDER BY distance, member) - 1 AS member_rank, o.path, o.size, CAST(greatest(distance, 0) AS BIGINT) AS distance
  FROM f JOIN gr USING (seed) JOIN o ON o.ord = member JOIN o so ON so.ord = f.seed)"""


@query(f"{_ORD}{_WALK} SELECT * FROM near")
def near_groups(spark, sf_dir):
    return near.groups(v.fingerprints(spark, sf_dir), THRESHOLD, ["fp0"], cut)


@query(f"{pairs_sql(v.LANE_OFFSETS, pol.clamp_threshold(None))}{_WALK} SELECT * FROM near")
def near_groups_256(spark, sf_dir):
    return near.groups(v.fingerprints(spark, sf_dir, v.LANE_OFFSETS), pol.clamp_threshold(None), v.LANES, cut)


@query(f"""WITH {v.FINGERPRINTS}, p AS (SELECT a.label = b.label AS same, CAST(bit_count(xor(a.fp0, b.fp0)) AS BIGINT) AS d FROM fingerprints a JOIN fingerprints b ON a.path < b.path)
SELECT same, count(*) AS pairs, min(d) AS min_d, max(d) AS max_d, round(avg(d), 6) AS mean_d, round(stddev_pop(d), 6) AS sd_d FROM p GROUP BY same""")
def separation_stats(spark, sf_dir):
    return near.separation(v.fingerprints(spark, sf_dir), ["fp0"])


@query(f"WITH {v.FINGERPRINTS} SELECT path, CAST(bit_count(fp0) AS BIGINT) AS bits, CAST(bit_count(xor(fp0, CAST(255 AS UBIGINT))) AS BIGINT) AS to_low, lower(printf('%016X', fp0)) || repeat('0', 48) AS hex FROM fingerprints")
def fingerprint_codec(spark, sf_dir):
    zero = F.lit(0).cast("long")
    p = v.fingerprints(spark, sf_dir).withColumn("hex", bits.to_hex([F.col("fp0"), zero, zero, zero]))
    back = bits.from_hex(F.col("hex"))
    return p.select("path", bits.bit_population(back).alias("bits"), bits.hamming([back[0]], [F.lit(255).cast("long")]).alias("to_low"), "hex")


@query(f"""{_ORD}{_WALK}, {_TIERS.removeprefix("WITH ")}, x AS (
  SELECT 'exact' AS mode, r.hash AS group_hash, path, r.size, 0::BIGINT AS distance FROM r JOIN t3 ON r.hash = t3.hash AND r.size = t3.size
  UNION ALL SELECT 'perceptual', seed_path, path, size, distance FROM near)
SELECT mode, count(*) AS members, count(DISTINCT group_hash) AS groups, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(distance) AS BIGINT) AS distances FROM x GROUP BY mode""")
def neutral_groups(spark, sf_dir):
    e = exact.groups(v.candidates(spark, sf_dir), WINDOW)
    n = near.groups(v.fingerprints(spark, sf_dir), THRESHOLD, ["fp0"], cut, seed_print=True)
    both = review.neutral(e, n)
    return both.groupBy("mode").agg(F.count("*").alias("members"), F.count_distinct("group_hash").alias("groups"), F.sum("size").alias("bytes"), F.sum("distance").alias("distances"))


# --- review -------------------------------------------------------------------------------------------------------

_MEMBERS = f"""{_TIERS}, members AS (SELECT row_number() OVER (ORDER BY group_rank, string_split(path, '/')) AS id, group_rank AS group_id, path, r.size, mtime, CASE WHEN group_rank % 7 = 0 THEN 0 ELSE 1 END AS keep,
  CASE WHEN mtime % 11 = 0 THEN 'trashed' END AS disposal FROM r JOIN t3 ON r.hash = t3.hash AND r.size = t3.size)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of exact groups, some gone already, some groups with no keeper."""
    g = row_numbers(exact.groups(v.candidates(spark, sf_dir), WINDOW), ["group_rank", path_key(F.col("path"))], "id")
    return cut(g.select("id", F.col("group_rank").alias("group_id"), "path", "size", "mtime", F.when(F.col("group_rank") % 7 == 0, 0).otherwise(1).alias("keep"), F.when(F.col("mtime") % 11 == 0, "trashed").alias("disposal")))


def _policy_sql(order: str) -> str:
    return f"""{_MEMBERS}, k AS (SELECT *, row_number() OVER (PARTITION BY group_id, disposal IS NULL ORDER BY {order}, string_split(path, '/')) AS rn FROM members)
SELECT id, group_id, path, CASE WHEN disposal IS NOT NULL THEN keep WHEN rn = 1 THEN 1 ELSE 0 END AS keep FROM k"""


@query(_policy_sql("len(list_filter(string_split(path, '/'), lambda s: s <> '')) + 1"))
def keep_shallowest(spark, sf_dir):
    return review.apply_policy(members(spark, sf_dir), "shallowest_path").select("id", "group_id", "path", "keep")


@query(_policy_sql("mtime"))
def keep_oldest(spark, sf_dir):
    return review.apply_policy(members(spark, sf_dir), "oldest").select("id", "group_id", "path", "keep")


@query(f"{_MEMBERS} SELECT id, CASE WHEN id % 5 = 0 THEN 0 ELSE keep END AS keep FROM members")
def set_keep_marks(spark, sf_dir):
    m = members(spark, sf_dir)
    return review.set_keep(m, m.where("id % 5 = 0").select("id", F.lit(0).alias("keep"))).select("id", "keep")


_KEPT = _policy_sql("mtime").replace("SELECT id, group_id, path, CASE", ", kept AS (SELECT id, group_id, path, size, mtime, disposal, CASE", 1) + ")"
_KEPT = _KEPT.replace("FROM members)\n, kept", "FROM members), kept")


@query(f"{_KEPT} SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM kept WHERE keep = 0 AND disposal IS NULL")
def pending_removals(spark, sf_dir):
    return review.pending_removals(review.apply_policy(members(spark, sf_dir), "oldest"))


@query(f"{_KEPT} SELECT group_id, count(*) FILTER (keep = 1) AS kept, count(*) FILTER (keep = 0) AS removed, min(id) FILTER (keep = 0) AS first_removed FROM kept WHERE disposal IS NULL GROUP BY group_id HAVING count(*) FILTER (keep = 0) > 0")
def delete_plans(spark, sf_dir):
    p = review.delete_plans(review.apply_policy(members(spark, sf_dir), "oldest"))
    return p.select("group_id", F.size("keep").cast("long").alias("kept"), F.size("remove").cast("long").alias("removed"), F.get("remove", F.lit(0))["id"].alias("first_removed"))


_DELETES = f"""{_KEPT}, keeper AS (SELECT DISTINCT group_id FROM kept WHERE keep = 1 AND disposal IS NULL),
d AS (SELECT id, group_id, path, size, CASE WHEN group_id NOT IN (SELECT group_id FROM keeper) THEN 'no_keeper' WHEN id % 6 = 0 THEN 'missing' WHEN id % 6 = 1 THEN 'symlink' WHEN id % 6 = 2 THEN 'size_changed' WHEN id % 6 = 3 THEN 'mtime_changed' END AS note
  FROM kept WHERE keep = 0 AND disposal IS NULL)"""


def _outcomes(spark, sf_dir):
    m = cut(review.apply_policy(members(spark, sf_dir), "oldest"))
    n = F.col("id") % 6
    now = m.where(n != 0).select("path", (F.col("size") + F.when(n == 2, 1).otherwise(0)).alias("size"), (F.col("mtime") + F.when(n == 3, 1).otherwise(0)).alias("mtime"), (n == 1).alias("is_symlink"))
    return m, review.decide_deletes(m, now)


@query(f"{_DELETES} SELECT id, group_id, path, size, CASE WHEN note IS NULL THEN 'trashed' ELSE 'skipped' END AS outcome, note FROM d")
def delete_decisions(spark, sf_dir):
    return _outcomes(spark, sf_dir)[1]


@query(f"""{_DELETES} SELECT count(*) FILTER (note IS NULL) AS trashed, count(*) FILTER (note IS NOT NULL) AS skipped, 0::BIGINT AS failed, CAST(coalesce(sum(size) FILTER (note IS NULL), 0) AS BIGINT) AS reclaimed,
 coalesce((SELECT string_agg(note, ',' ORDER BY first_id) FROM (SELECT note, min(id) AS first_id FROM d WHERE note IS NOT NULL GROUP BY note)), '') AS notes FROM d""")
def apply_summary(spark, sf_dir):
    return review.apply_summary(_outcomes(spark, sf_dir)[1])


@query(f"{_DELETES} SELECT k.id, CASE WHEN d.id IS NOT NULL AND d.note IS NULL THEN 'trashed' ELSE k.disposal END AS disposal FROM kept k LEFT JOIN d ON k.id = d.id")
def record_disposals(spark, sf_dir):
    m, outcomes = _outcomes(spark, sf_dir)
    return review.record_disposals(m, outcomes).select("id", "disposal")


# --- scan and report ----------------------------------------------------------------------------------------------

_CATEGORY = f"""{v.MEDIA}, cat AS (SELECT *, CASE WHEN contains(path, '.photoslibrary/') THEN 'bundle' WHEN contains(path, '/.cache/') THEN 'pruned' WHEN system_junk THEN 'junk' WHEN sidecar THEN 'sidecar' WHEN class IS NULL THEN 'other' ELSE 'media' END AS category FROM classed)"""
_LINKS = ", uniq AS (SELECT * FROM cat WHERE category = 'media' QUALIFY nlink <= 1 OR row_number() OVER (PARTITION BY dev, inode, nlink > 1 ORDER BY string_split(path, '/')) = 1)"


@query(f"WITH {_CATEGORY} SELECT path, class, category FROM cat")
def scan_classify(spark, sf_dir):
    return scan.with_category(v.files(spark, sf_dir)).select("path", "class", "category")


@query(f"WITH {_CATEGORY}{_LINKS} SELECT path, dev, inode FROM uniq")
def hardlink_distinct(spark, sf_dir):
    return scan.drop_hard_links(scan.with_category(v.files(spark, sf_dir)).where("category = 'media'")).select("path", "dev", "inode")


@query(f"""WITH {_CATEGORY.replace(" FROM classed)", " FROM classed WHERE readable)")}{_LINKS} SELECT (SELECT count(*) FROM files WHERE NOT readable) AS errors, false AS cancelled, count(*) FILTER (category IN ('other', 'media')) AS files_seen, (SELECT count(*) FROM uniq) AS media_found, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM uniq) AS bytes,
 count(*) FILTER (category = 'media') - (SELECT count(*) FROM uniq) AS hardlinks_skipped, count(*) FILTER (category = 'other') AS non_media, count(*) FILTER (category = 'sidecar') AS sidecars,
 count(DISTINCT CASE WHEN category = 'bundle' THEN regexp_replace(path, '/[^/]*$', '') END) AS bundles_skipped FROM cat""")
def scan_counters(spark, sf_dir):
    return scan.counters(v.files(spark, sf_dir))


@query(f"""WITH {v.FILES} SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent, CASE WHEN contains(name, '.') AND NOT (starts_with(name, '.') AND len(string_split(name, '.')) = 2) THEN regexp_extract(name, '[^.]*$') ELSE '' END AS ext,
 CASE WHEN contains(name, '.') AND NOT (starts_with(name, '.') AND len(string_split(name, '.')) = 2) THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END AS stem, len(string_split(path, '/')) AS depth, name AS label, starts_with(name, '._') OR ends_with(lower(name), '.xmp') AS junk, doc_id % 4 = 0 AS temp FROM files""")
def path_parts(spark, sf_dir):
    p = F.col("path")
    return v.files(spark, sf_dir).select("path", parent(p).alias("parent"), extension(p).alias("ext"), stem(p).alias("stem"), depth(p).alias("depth"), root_label(p).alias("label"), is_junk(file_name(p)).alias("junk"), is_temp_file(F.concat(F.when(F.col("doc_id") % 2 == 0, ".").otherwise("x"), F.col("name"), F.when(F.col("doc_id") % 4 == 1, ".zz").otherwise(".zz-8"), F.when(F.col("doc_id") % 4 == 2, ".tm").otherwise(".tmp"))).alias("temp"))


_W = "CASE WHEN class IN ('image', 'modern_image', 'raw_image') THEN 'image' ELSE class END"


def _fit_sql(side: str, cap: int) -> str:
    return f"CASE WHEN width = 0 OR height = 0 OR least(width, height) <= {cap} THEN {side} ELSE greatest(1, ({side} * {cap} + least(width, height) // 2) // least(width, height)) END"


_PLANNED = f"""{v.MEDIA}, fitted AS (SELECT *, {_W} AS kind, {_fit_sql("width", 1080)} AS ow, {_fit_sql("height", 1080)} AS oh, coalesce(duration_us, 0) / 1e6 AS secs, codec IN ('aac', 'aac_latm') AS remux FROM media),
decided AS (SELECT *, CASE
  WHEN class = 'raw_image' THEN 'raw_excluded' WHEN size < 102400 THEN 'too_small' WHEN kind = 'image' AND greatest(width, height) > 65536 THEN 'too_large'
  WHEN class = 'modern_image' AND ow = width AND oh = height THEN 'already_optimal'
  WHEN kind = 'video' AND (coalesce(color_transfer = 'smpte2084', false) OR coalesce(starts_with(color_primaries, 'bt2020'), false) OR coalesce(codec_tag = 'dvh1', false)) THEN 'hdr_unsupported'
  WHEN kind = 'video' AND codec IN ('hevc', 'h265', 'av1') AND ow = width AND oh = height AND NOT coalesce(fps > 30.01, false) THEN 'already_optimal'
  WHEN kind = 'audio' AND remux AND ext IN ('m4a', 'm4b') THEN 'already_optimal'
  WHEN kind = 'audio' AND NOT remux AND secs > 0 AND NOT (16000.0::DOUBLE * secs < size * 0.8::DOUBLE) THEN 'no_gain' END AS skip_reason FROM fitted),
px AS (SELECT *, CAST(ow AS DOUBLE) * oh AS out_px, CAST(width AS DOUBLE) * height AS src_px, CAST(ow AS DOUBLE) * oh * least(coalesce(fps, 30.0), 30.0) * secs AS vpx,
  CASE WHEN ext IN ('jpg', 'jpeg', 'jpe', 'jfif', 'webp', 'heic', 'heif', 'hif', 'avif', 'jxl') THEN 0.75::DOUBLE ELSE 0.15::DOUBLE END AS ratio FROM decided),
mids AS (SELECT *, CASE WHEN src_px > 0 THEN size * ratio * (out_px / src_px) ELSE size * 0.5::DOUBLE END AS img, CASE WHEN out_px > 0 THEN out_px / 1e6 ELSE 1.5::DOUBLE END / 3.5::DOUBLE AS img_s FROM px),
planned AS (SELECT *, CASE WHEN kind = 'video' THEN 'video' ELSE 'light' END AS queue,
  CASE kind WHEN 'image' THEN img / 2 WHEN 'video' THEN CASE WHEN vpx > 0 THEN vpx * 0.03::DOUBLE / 8 ELSE size * 0.25::DOUBLE END ELSE CASE WHEN remux THEN size * 0.99::DOUBLE WHEN secs <= 0 THEN size * 0.5::DOUBLE / 1.5 ELSE secs * 16000 * 0.98::DOUBLE END END AS out_low,
  CASE kind WHEN 'image' THEN img WHEN 'video' THEN CASE WHEN vpx > 0 THEN vpx * 0.045::DOUBLE / 8 ELSE size * 0.5::DOUBLE END ELSE CASE WHEN remux THEN size WHEN secs <= 0 THEN size * 0.5::DOUBLE ELSE secs * 16000 * 1.02::DOUBLE END END AS out_mid,
  CASE kind WHEN 'image' THEN img * 2 WHEN 'video' THEN CASE WHEN vpx > 0 THEN vpx * 0.09::DOUBLE / 8 ELSE size * 1.0::DOUBLE END ELSE CASE WHEN remux THEN size WHEN secs <= 0 THEN size * 0.75::DOUBLE ELSE secs * 16000 * 1.08::DOUBLE END END AS out_high,
  CASE kind WHEN 'image' THEN img_s / 1.6::DOUBLE WHEN 'video' THEN CASE WHEN vpx > 0 THEN vpx / 1e6 / 129 ELSE 2.5::DOUBLE END ELSE CASE WHEN remux THEN 0.2::DOUBLE / 3 WHEN secs <= 0 THEN 1.0::DOUBLE / 3 ELSE secs / 216 / 2 END END AS secs_low,
  CASE kind WHEN 'image' THEN img_s WHEN 'video' THEN CASE WHEN vpx > 0 THEN vpx / 1e6 / 55 ELSE 10.0::DOUBLE END ELSE CASE WHEN remux THEN 0.2::DOUBLE WHEN secs <= 0 THEN 1.0::DOUBLE ELSE secs / 216 END END AS secs_mid,
  CASE kind WHEN 'image' THEN img_s * 1.6::DOUBLE WHEN 'video' THEN CASE WHEN vpx > 0 THEN vpx / 1e6 / 35 ELSE 40.0::DOUBLE END ELSE CASE WHEN remux THEN 0.2::DOUBLE * 3 WHEN secs <= 0 THEN 3.0::DOUBLE ELSE secs / 216 * 2 END END AS secs_high
  FROM mids)"""


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.plan_items(v.media(spark, sf_dir), PROFILE)


@query(f"WITH {_PLANNED} SELECT path, kind, skip_reason FROM planned")
def skip_decisions(spark, sf_dir):
    return planned(spark, sf_dir).select("path", "kind", "skip_reason")


@query(f"WITH {_PLANNED} SELECT path, queue, {', '.join(f'round(CAST({c}_{b} AS DOUBLE), 3) AS {c}_{b}' for c in ('out', 'secs') for b in est.BOUNDS)} FROM planned")
def item_estimates(spark, sf_dir):
    return planned(spark, sf_dir).select("path", "queue", *(F.round(f"{c}.{b}", 3).alias(f"{a}_{b}") for a, c in (("out", "out_bytes"), ("secs", "seconds")) for b in est.BOUNDS))


def _summary_sql() -> str:
    light = 8**0.9
    sums = ", ".join(f"coalesce(sum(least(CAST(out_{b} AS DOUBLE), size)), 0) AS out_{b}, coalesce(sum(secs_{b}) FILTER (queue = 'video'), 0) AS video_{b}, coalesce(sum(secs_{b}) FILTER (queue = 'light'), 0) AS light_{b}" for b in est.BOUNDS)
    cols = ", ".join([f"round(CAST({c}_{b} AS DOUBLE), 2) AS {c}_{b}" for b in est.BOUNDS for c in ("out", "video", "light")] + [f"round(video_{b} / 1.21::DOUBLE + light_{b} / {light!r}::DOUBLE, 2) AS wall_{b}" for b in est.BOUNDS] + [f"round(greatest(src_bytes - out_{o}, 0.0::DOUBLE), 2) AS saved_{b}" for b, o in zip(est.BOUNDS, reversed(est.BOUNDS), strict=True)])
    return f"WITH {_PLANNED}, s AS (SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS src_bytes, {sums} FROM planned WHERE skip_reason IS NULL) SELECT files, src_bytes, {cols} FROM s"


@query(_summary_sql())
def estimate_summary(spark, sf_dir):
    s = scan.estimate_summary(planned(spark, sf_dir))
    return s.select(*(F.round(c, 2).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes))


@query(f"WITH {_PLANNED} SELECT kind, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(CASE kind WHEN 'image' THEN 0 WHEN 'video' THEN 1 ELSE 2 END AS BIGINT) AS ord FROM planned WHERE skip_reason IS NULL GROUP BY kind")
def report_kind_groups(spark, sf_dir):
    return scan.kind_groups(planned(spark, sf_dir))


@query(f"WITH {_PLANNED}, g AS (SELECT skip_reason, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM planned WHERE skip_reason IS NOT NULL GROUP BY skip_reason) SELECT *, row_number() OVER (ORDER BY files DESC, skip_reason) AS rank FROM g")
def report_skip_groups(spark, sf_dir):
    return scan.skip_groups(planned(spark, sf_dir))


_ROOT = "CASE " + " ".join(f"WHEN starts_with(path, '{r}/') THEN '{r}'" for r in ROOTS) + " END"


@query(f"""WITH {_PLANNED}, rooted AS (SELECT *, {_ROOT} AS root FROM planned), b AS (SELECT *, CASE WHEN contains(path[len(root) + 2:], '/') THEN root || '/' || string_split(path[len(root) + 2:], '/')[1] ELSE root END AS bucket FROM rooted),
g AS (SELECT bucket, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM b GROUP BY bucket), r AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, bucket) AS rn FROM g)
SELECT least(rn, 9) AS rank, CASE WHEN rn <= 8 THEN bucket ELSE '' END AS path, count(*) AS dirs, CAST(sum(files) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM r GROUP BY 1, 2""")
def report_top_dirs(spark, sf_dir):
    return scan.top_dirs(planned(spark, sf_dir), ROOTS)


@query(f"WITH {_PLANNED} SELECT count(*) AS analyzed, count(*) FILTER (skip_reason IS NULL) AS planned, CAST(coalesce(sum(size) FILTER (skip_reason IS NULL), 0) AS BIGINT) AS bytes FROM planned")
def report_progress(spark, sf_dir):
    return scan.progress(planned(spark, sf_dir))


@query(f"WITH {_PLANNED}, s AS (SELECT CAST(trunc(coalesce(sum(CAST(least(CAST(out_mid AS DOUBLE), size) AS DECIMAL(28, 3))) FILTER (skip_reason IS NULL), 0)) AS BIGINT) AS processed, CAST(coalesce(sum(size) FILTER (skip_reason IS NOT NULL), 0) AS BIGINT) AS left_alone FROM planned) SELECT processed, left_alone, processed + left_alone AS est_out_bytes FROM s")
def estimated_output(spark, sf_dir):
    return scan.estimated_output(planned(spark, sf_dir))


@query(f"WITH {_PLANNED} SELECT {JOB}::BIGINT AS job_id, path AS src_path, size AS src_size, mtime AS src_mtime, kind, skip_reason, round(secs_mid, 3) AS est_secs FROM planned")
def queue_rows(spark, sf_dir):
    return scan.queue_rows(planned(spark, sf_dir), JOB).withColumn("est_secs", F.round("est_secs", 3))


@query(f"""WITH {_PLANNED}, r AS (SELECT *, {_ROOT.replace("'/vol/src1/') THEN '/vol/src1'", "'/vol/src1/') THEN '/vol/src1'")} AS root FROM planned)
SELECT path, '/out/' || string_split(root, '/')[-1] || regexp_replace(path[len(root) + 1:], '/[^/]*$', '') AS dst_dir, regexp_replace(path, '/[^/]*$', '') AS in_place FROM r""")
def output_dirs(spark, sf_dir):
    p = F.col("path")
    return planned(spark, sf_dir).select("path", scan.output_dir(p, ROOTS, "/out").alias("dst_dir"), scan.output_dir(p, ROOTS, None).alias("in_place"))


@query(f"""WITH {_PLANNED} SELECT path, regexp_replace(name, '\\.[^.]*$', '') || '_' || regexp_extract(name, '[^.]*$') || '.' || CASE kind WHEN 'image' THEN 'avif' WHEN 'video' THEN 'mp4' ELSE 'm4a' END AS out_name FROM planned""")
def output_names(spark, sf_dir):
    return planned(spark, sf_dir).select("path", naming.render("{name}_{srcext}.{ext}", F.col("path"), target_ext(F.col("kind"))).alias("out_name"))


@query(f"""WITH {_PLANNED}, t AS (SELECT doc_id AS id, path AS src, '/out/' || source || '/' || (doc_id % 23) || '.avif' AS dst FROM planned JOIN (SELECT doc_id, source FROM documents) USING (doc_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY id) - 1 AS k FROM t)
SELECT id, src, dst, CASE WHEN k = 0 THEN dst WHEN k > 999 THEN NULL ELSE regexp_replace(dst, '\\.avif$', '-' || k || '.avif') END AS final FROM n""")
def collision_names(spark, sf_dir):
    src = v.table(spark, sf_dir, "documents").select("doc_id", "source")
    t = planned(spark, sf_dir).join(src, "doc_id").select(F.col("doc_id").alias("id"), F.col("path").alias("src"), F.concat(F.lit("/out/"), F.col("source"), F.lit("/"), (F.col("doc_id") % 23).cast("string"), F.lit(".avif")).alias("dst"))
    return queue.resolve_names(t)


@query(f"WITH {v.MEDIA} SELECT path, {_fit_sql('width', 1080)} AS w, {_fit_sql('height', 1080)} AS h, {_fit_sql('width', 720)} // 2 * 2 AS even_w, {_fit_sql('height', 720)} // 2 * 2 AS even_h, ({_fit_sql('width', 1080)}) <> width OR ({_fit_sql('height', 1080)}) <> height AS resize FROM media")
def short_edge(spark, sf_dir):
    w, h = pol.fit_short_edge(F.col("width"), F.col("height"), 1080)
    ew, eh = pol.video_target(F.col("width"), F.col("height"), 720)
    return v.media(spark, sf_dir).select("path", w.alias("w"), h.alias("h"), ew.alias("even_w"), eh.alias("even_h"), pol.needs_resize(F.col("width"), F.col("height"), 1080).alias("resize"))


@query(f"""WITH {v.ITEMS} SELECT id, dst >= src * 80 // 100 OR src = 0 AS no_gain, CASE WHEN dst = 0 THEN 'error' WHEN dst >= src * 80 // 100 OR src = 0 THEN 'no_gain' ELSE 'written' END AS gated, CASE WHEN dst = 0 THEN 'error' WHEN dst > src THEN 'no_gain' ELSE 'written' END AS ungated
FROM (SELECT id, src_size AS src, src_size * (id % 13) // 10 AS dst FROM items)""")
def gain_gates(spark, sf_dir):
    rows = v.items(spark, sf_dir).select("id", F.col("src_size").alias("src"), F.call_function("div", F.col("src_size") * (F.col("id") % 13), F.lit(10)).alias("dst"))
    s, d = F.col("src"), F.col("dst")
    return rows.select("id", pol.no_gain(s, d, PROFILE).alias("no_gain"), pol.commit_gate(s, d, True, PROFILE).alias("gated"), pol.commit_gate(s, d, False, PROFILE).alias("ungated"))


@query(f"""WITH {v.MEDIA} SELECT path, CASE WHEN codec IN ('aac', 'aac_latm') THEN 'remux' ELSE 'encode' END AS route, class IN ('video', 'audio') AS probe, class IN ('image', 'modern_image', 'raw_image') AS hashable, class IN ('image', 'modern_image') AS near_ok,
 class = 'video' AND coalesce(fps > 30.01, false) AS limit_fps, CASE WHEN duration_us > 0 THEN size * 8000000 // duration_us END AS bitrate FROM media""")
def media_predicates(spark, sf_dir):
    from cairnspark.functions.paths import accepts

    c = F.col("class")
    return v.media(spark, sf_dir).select("path", pol.audio_route(F.col("codec"), PROFILE).alias("route"), needs_probe(c).alias("probe"), is_hashable(c).alias("hashable"), accepts(c, "perceptual").alias("near_ok"), ((c == "video") & pol.video_filters(F.col("width"), F.col("height"), F.col("fps"), PROFILE)[1]).alias("limit_fps"), est.bitrate(F.col("size"), F.col("duration_us")).alias("bitrate"))


@query("WITH r AS (SELECT unnest(range((SELECT count(*) * 100 FROM documents))) AS id) SELECT id, CAST(id // 100 AS BIGINT) AS dir, CASE WHEN id % 100 < 92 THEN 'image' WHEN id % 100 < 97 THEN 'video' WHEN id % 100 < 99 THEN 'audio' ELSE 'other' END AS kind FROM r")
def synthetic_corpus(spark, sf_dir):
    """A generated folder of 100 files for each document."""
    return corpus.inventory(spark, v.table(spark, sf_dir, "documents").count() * 100).select("id", "dir", "kind")


# --- probing ------------------------------------------------------------------------------------------------------


def _quoted(name: str, value, last: bool = False):
    return F.when(value.isNotNull(), F.concat(F.lit(f'"{name}": "'), value, F.lit('"' if last else '", '))).otherwise("")


def probe_json(m: DataFrame) -> DataFrame:
    """What a probe tool would print for media files; some of it broken."""
    stream = F.concat(
        F.lit('{"codec_type": "'), F.when(F.col("class") == "audio", "audio").otherwise("video"), F.lit('", '), _quoted("codec_name", F.col("codec")), _quoted("codec_tag_string", F.col("codec_tag")), _quoted("color_transfer", F.col("color_transfer")), _quoted("color_primaries", F.col("color_primaries")),
        F.when(F.col("fps").isNotNull(), F.concat(F.lit('"avg_frame_rate": "'), (F.col("fps") * 1000).cast("long").cast("string"), F.lit('/1000", '))).otherwise('"avg_frame_rate": "0/0", '),
        F.lit('"width": '), F.col("width").cast("string"), F.lit(', "height": '), F.col("height").cast("string"), F.lit("}"),
    )
    cover = F.lit('{"index": 1, "codec_type": "video", "codec_name": "mjpeg", "width": 500, "height": 500, "disposition": {"attached_pic": 1}}, ')
    subtitle = F.concat(F.lit(', {"codec_type": "subtitle", "codec_name": "'), F.when(F.col("doc_id") % 5 == 1, "mov_text").when(F.col("doc_id") % 5 == 2, "ass"), F.lit('"}'))
    text = F.concat(F.lit('{"streams": ['), F.when(F.col("doc_id") % 3 == 0, cover).otherwise(""), stream, F.coalesce(subtitle, F.lit("")), F.lit("]"), F.when(F.col("duration_us").isNotNull(), F.concat(F.lit(', "format": {"duration": "'), (F.col("duration_us") / 1_000_000).cast("long").cast("string"), F.lit('.0"}'))).otherwise(""), F.lit("}"))
    return m.withColumn("probe_json", F.when(F.col("doc_id") % 29 == 0, F.substring(text, 1, 20)).otherwise(text))


@query(f"""WITH {v.MEDIA} SELECT path, CASE WHEN bad THEN 0 ELSE width END AS width, CASE WHEN bad THEN 0 ELSE height END AS height, CASE WHEN NOT bad THEN codec END AS codec, CASE WHEN NOT bad THEN round(fps, 3) END AS fps, CASE WHEN NOT bad THEN duration_us END AS duration_us,
 CASE WHEN NOT bad THEN color_transfer END AS color_transfer FROM (SELECT *, doc_id % 29 = 0 AS bad FROM media)""")
def probe_parse(spark, sf_dir):
    m = probe_json(v.media(spark, sf_dir))
    p = probe.probed(F.col("probe_json"), F.col("class"))
    return m.select("path", p["width"].cast("long").alias("width"), p["height"].cast("long").alias("height"), p["codec"].alias("codec"), F.round(p["fps"], 3).alias("fps"), p["duration_us"].alias("duration_us"), p["color_transfer"].alias("color_transfer"))


@query(f"""WITH {v.MEDIA} SELECT path, CASE WHEN class = 'audio' AND doc_id % 29 <> 0 THEN codec END AS audio_codec, CAST(CASE WHEN doc_id % 3 = 0 AND doc_id % 29 <> 0 THEN 1 END AS INTEGER) AS cover_index, CASE WHEN doc_id % 29 <> 0 AND doc_id % 5 = 2 THEN 'mkv' ELSE 'mp4' END AS container FROM media""")
def probe_sources(spark, sf_dir):
    m = probe_json(v.media(spark, sf_dir))
    a, b = probe.audio_source(F.col("probe_json")), probe.video_source(F.col("probe_json"))
    return m.select("path", a["audio_codec"].alias("audio_codec"), a["cover_index"].alias("cover_index"), b["container"].alias("container"))


@query(f"""WITH {v.MEDIA}, f AS (SELECT doc_id, path, size, mtime + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS mtime FROM media) SELECT path, doc_id % 4 <> 0 AND doc_id % 29 <> 0 AND doc_id % 5 <> 0 AS hit FROM f""")
def probe_cache_lookup(spark, sf_dir):
    m = probe_json(v.media(spark, sf_dir))
    cache = m.where("doc_id % 5 <> 0").select("path", "size", "mtime", "probe_json")
    now = m.select("path", "size", (F.col("mtime") + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)).alias("mtime"))
    return queue.cached_probe(now, cache).select("path", "hit")


@query("SELECT CAST(event_id AS BIGINT) AS id, CAST(event_id % 100 AS VARCHAR) AS frame, CASE WHEN event_id % 3 = 0 THEN 'end' ELSE 'continue' END AS state, round(least(1.0, (event_id % 100) / 80.0), 6) AS done FROM events")
def progress_lines(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    n = (F.col("event_id") % 100).cast("string")
    lines = F.array(F.lit("frame=1"), F.lit("noise"), F.concat(F.lit("frame="), n), F.concat(F.lit(" progress="), F.when(F.col("event_id") % 3 == 0, "end").otherwise("continue")))
    p = e.select(F.col("event_id").alias("id"), probe.progress(lines).alias("p"))
    return p.select("id", F.col("p")["frame"].alias("frame"), F.col("p")["progress"].alias("state"), F.round(probe.fraction(F.col("p")["frame"].cast("double"), F.lit(80.0)), 6).alias("done"))


@query("SELECT event_id AS id, round(value / 2, 4) AS vmaf, CASE WHEN value >= 12 THEN round(greatest(least(value * 0.15, value - 2), 0), 4) END AS w1, CASE WHEN value >= 12 THEN round(greatest(least(value * 0.85, value - 2), 0), 4) END AS w3 FROM events")
def quality_windows(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    text = F.concat(F.lit('{"pooled_metrics": {"vmaf": {"mean": '), (F.col("value") / 2).cast("string"), F.lit("}}}"))
    w = pol.quality_windows(F.col("value"))
    return e.select(F.col("event_id").alias("id"), F.round(probe.vmaf_mean(text), 4).alias("vmaf"), F.round(w[0], 4).alias("w1"), F.round(w[2], 4).alias("w3"))


# --- caches and comparisons ---------------------------------------------------------------------------------------


@query(f"WITH {v.CACHE_PUTS} SELECT path, algo, size, mtime, hash FROM cache_puts QUALIFY row_number() OVER (PARTITION BY path, algo ORDER BY seq DESC) = 1")
def cache_upsert(spark, sf_dir):
    puts = v.cache_puts(spark, sf_dir)
    old = puts.where("seq % 10 = 0").drop("seq").dropDuplicates(["path", "algo"]).withColumn("hash", F.lit("stale"))
    return queue.upsert(old, puts, ["path", "algo"], "seq")


@query(f"""WITH {v.ITEMS}, e AS (SELECT job_id, src_path FROM items WHERE id % 3 = 0), n AS (SELECT id, job_id, src_path, src_size FROM items WHERE id % 2 = 0)
SELECT * FROM n WHERE (job_id, src_path) NOT IN (SELECT (job_id, src_path) FROM e) QUALIFY row_number() OVER (PARTITION BY job_id, src_path ORDER BY id, src_size) = 1""")
def insert_or_ignore(spark, sf_dir):
    items = v.items(spark, sf_dir).select("id", "job_id", "src_path", "src_size")
    new = items.where("id % 2 = 0")
    return queue.insert_or_ignore(items.where("id % 3 = 0"), new.unionByName(new.withColumn("id", F.col("id") + 1_000_000_000)), ["job_id", "src_path"], "id").select("id", "job_id", "src_path", "src_size")


@query(f"""WITH {v.CANDIDATES} SELECT path, CASE WHEN size % 5 = 0 THEN 'missing' WHEN size % 5 = 1 THEN 'size_differs' WHEN size % 5 = 2 THEN 'hash_differs' ELSE 'same' END AS verdict FROM candidates
UNION ALL SELECT path || '.new', 'extra' FROM candidates WHERE size % 5 = 3""")
def compare_manifest(spark, sf_dir):
    c = v.candidates(spark, sf_dir).select("path", "size", F.md5("content").alias("hash"))
    n = F.col("size") % 5
    found = c.where(n != 0).select("path", (F.col("size") + F.when(n == 1, 1).otherwise(0)).alias("size"), F.when(n == 2, "x").otherwise(F.col("hash")).alias("hash"))
    extra = c.where(n == 3).select(F.concat("path", F.lit(".new")).alias("path"), "size", "hash")
    return queue.compare_manifest(c, found.unionByName(extra))


@query(f"""WITH {v.CANDIDATES} SELECT path AS src_path, CASE WHEN size % 7 = 0 THEN 'src_missing' WHEN size % 7 IN (1, 2) THEN 'src_changed' END AS problem FROM candidates""")
def source_check(spark, sf_dir):
    c = v.candidates(spark, sf_dir)
    n = F.col("size") % 7
    now = c.where(n != 0).select("path", (F.col("size") + F.when(n == 1, 1).otherwise(0)).alias("size"), (F.col("mtime") + F.when(n == 2, 1).otherwise(0)).alias("mtime"))
    claimed = c.select(F.col("path").alias("src_path"), F.col("size").alias("src_size"), F.col("mtime").alias("src_mtime"))
    return queue.source_check(claimed, now).select("src_path", "problem")


# --- queue --------------------------------------------------------------------------------------------------------

_ST = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in queue.STATUSES)


@query(f"WITH {v.ITEMS} SELECT job_id, count(*) AS total, {_ST}, CAST(coalesce(sum(src_size) FILTER (status = 'done'), 0) AS BIGINT) AS src_bytes, CAST(coalesce(sum(dst_size) FILTER (status = 'done'), 0) AS BIGINT) AS dst_bytes FROM items GROUP BY job_id")
def job_progress(spark, sf_dir):
    return queue.job_progress(v.items(spark, sf_dir))


@query(f"WITH {v.ITEMS} SELECT job_id, coalesce(sum(est_secs) FILTER (kind = 'video'), 0) AS video_secs, coalesce(sum(est_secs) FILTER (kind <> 'video'), 0) AS light_secs FROM (SELECT job_id, kind, CASE WHEN status IN ('pending', 'running') THEN est_secs END AS est_secs FROM items) GROUP BY job_id")
def pending_work(spark, sf_dir):
    return queue.pending_work(v.items(spark, sf_dir))


@query(f"""WITH {v.ITEMS}, k AS (SELECT *, status = 'skipped' AND coalesce(skip_reason IN ('no_gain', 'low_quality'), false) AS kept FROM items)
SELECT job_id, count(*) FILTER (status = 'done') AS written, count(*) FILTER (kept) AS kept, count(*) FILTER (status = 'failed') AS failed, CAST(coalesce(sum(src_size) FILTER (status = 'done' OR kept), 0) AS BIGINT) AS src_bytes,
 CAST(coalesce(sum(CASE WHEN status = 'done' THEN dst_size WHEN kept THEN src_size END), 0) AS BIGINT) AS dst_bytes FROM k GROUP BY job_id""")
def queue_summary(spark, sf_dir):
    return queue.queue_summary(v.items(spark, sf_dir))


@query(f"""WITH {v.ITEMS} SELECT coalesce(kind, 'total') AS kind, count(*) AS files, CAST(sum(src_size) AS BIGINT) AS src_bytes, CAST(sum(dst_size) AS BIGINT) AS dst_bytes, round(sum(dst_size) * 100.0::DOUBLE / sum(src_size), 1) AS percent FROM items WHERE status = 'done' GROUP BY ROLLUP (kind)""")
def size_report(spark, sf_dir):
    return queue.size_report(v.items(spark, sf_dir))


@query(f"WITH {v.ITEMS} SELECT coalesce(skip_reason, '?') AS reason, count(*) AS files, CAST(sum(src_size) AS BIGINT) AS bytes FROM items WHERE status = 'skipped' GROUP BY 1")
def skip_breakdown(spark, sf_dir):
    return queue.skip_breakdown(v.items(spark, sf_dir))


_REASON = "CASE skip_reason " + " ".join(f"WHEN '{k}' THEN '{m}'" for k, m in pol.SKIP_REASONS.items()) + " END"


@query(f"WITH {v.ITEMS} SELECT id, src_path, src_size, kind, status, skip_reason, dst_size, elapsed_ms, error_code, error_msg, {_REASON} AS skip_message FROM items WHERE job_id = {JOB} AND status = 'skipped' ORDER BY id LIMIT 200 OFFSET 100")
def items_page(spark, sf_dir):
    return queue.page(v.items(spark, sf_dir), JOB, "skipped", 200, 100)


@query(f"WITH {v.ITEMS} SELECT id, src_path, src_size, src_mtime, kind, est_secs FROM items WHERE job_id = {JOB} AND status = 'pending' AND kind IN ('image', 'audio') AND id > 1000 ORDER BY id LIMIT 32")
def keyset_page(spark, sf_dir):
    return queue.take_pending(v.items(spark, sf_dir), JOB, ["image", "audio"], 1000)


@query(f"WITH {v.ITEMS} SELECT count(*) AS n FROM items WHERE job_id = {JOB} AND status = 'failed'")
def count_items(spark, sf_dir):
    return queue.count_items(v.items(spark, sf_dir), JOB, "failed")


@query(f"WITH {v.ITEMS} SELECT id, CASE status WHEN 'running' THEN 'pending' ELSE status END AS status, CASE status WHEN 'running' THEN 1 ELSE 0 END AS attempt FROM items")
def recover_items(spark, sf_dir):
    return queue.recover(v.items(spark, sf_dir)).select("id", "status", "attempt")


@query(f"WITH {v.ITEMS} SELECT id, CASE WHEN status = 'running' AND job_id = {JOB} THEN 'pending' ELSE status END AS status, attempt FROM items")
def release_running(spark, sf_dir):
    return queue.release(v.items(spark, sf_dir), JOB).select("id", "status", "attempt")


@query(f"WITH {v.ITEMS} SELECT id, CASE WHEN status = 'failed' AND job_id = {JOB} THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' AND job_id = {JOB} THEN NULL ELSE error_code END AS error_code, CASE WHEN status = 'failed' AND job_id = {JOB} THEN NULL ELSE error_msg END AS error_msg FROM items")
def retry_failed(spark, sf_dir):
    return queue.retry_failed(v.items(spark, sf_dir), JOB).select("id", "status", "error_code", "error_msg")


@query(f"WITH {v.JOBS}, {v.ITEMS} SELECT i.id FROM items i JOIN jobs j ON i.job_id = j.id WHERE j.status = 'running' OR j.id = 5")
def prune_history(spark, sf_dir):
    left = queue.prune_jobs(v.jobs(spark, sf_dir), 5)
    return queue.cascade_delete(v.items(spark, sf_dir), "job_id", left).select("id")


@query(f"WITH {v.JOBS} SELECT id, CASE status WHEN 'running' THEN 'paused' ELSE status END AS status FROM jobs")
def recover_jobs(spark, sf_dir):
    return queue.recover_jobs(v.jobs(spark, sf_dir)).select("id", "status")


@query(f"WITH {v.JOBS} SELECT id, CASE WHEN id = 4 THEN 'done' ELSE status END AS status, CASE WHEN id = 4 THEN 1800000000 ELSE finished_at END AS finished_at FROM jobs")
def set_job_status(spark, sf_dir):
    return queue.set_job_status(v.jobs(spark, sf_dir), 4, "done", 1_800_000_000).select("id", "status", "finished_at")


@query(f"WITH {v.JOBS} SELECT id, CASE WHEN id = 2 THEN 'applying' ELSE status END AS status, CASE WHEN id = 2 THEN NULL ELSE finished_at END AS finished_at FROM jobs")
def set_run_status(spark, sf_dir):
    return queue.set_run_status(v.jobs(spark, sf_dir), 2, "applying", 1_800_000_000).select("id", "status", "finished_at")


@query(f"WITH {v.JOBS} SELECT * FROM jobs WHERE id = (SELECT max(id) FROM jobs)")
def prune_runs(spark, sf_dir):
    return queue.prune_runs(v.jobs(spark, sf_dir))


@query(f"WITH {v.JOBS}, {v.ITEMS} SELECT id, name, status FROM jobs WHERE status IN ('running', 'paused') AND EXISTS (SELECT 1 FROM items WHERE job_id = jobs.id AND items.status = 'pending') ORDER BY id DESC LIMIT 1")
def resumable_job(spark, sf_dir):
    return queue.resumable_job(v.jobs(spark, sf_dir), v.items(spark, sf_dir)).select("id", "name", "status")


@query(f"WITH {v.ITEMS} SELECT DISTINCT '/out/' || job_id || '/' || (id % 17) AS dst_dir FROM items WHERE status = 'running'")
def orphan_dirs(spark, sf_dir):
    items = v.items(spark, sf_dir)
    dirs = items.select("job_id", "src_path", F.concat(F.lit("/out/"), F.col("job_id").cast("string"), F.lit("/"), (F.col("id") % 17).cast("string")).alias("dst_dir"))
    return queue.orphan_dirs(items, dirs)


@query(f"WITH {v.ITEMS} SELECT id // 8 AS job_id, CASE WHEN count(*) FILTER (status = 'pending') > 0 THEN 'paused' ELSE 'done' END AS status FROM items GROUP BY id // 8")
def finish_status(spark, sf_dir):
    return queue.finish_status(v.items(spark, sf_dir).withColumn("job_id", F.call_function("div", F.col("id"), F.lit(8))))


@query(f"""WITH {v.JOBS}, {v.ITEMS}, j AS (SELECT id, name FROM jobs WHERE status IN ('running', 'paused') AND EXISTS (SELECT 1 FROM items WHERE job_id = jobs.id AND items.status = 'pending') ORDER BY id DESC LIMIT 1)
SELECT job_id, any_value(name) AS name, count(*) AS total, {_ST}, CAST(coalesce(sum(src_size) FILTER (status = 'done'), 0) AS BIGINT) AS src_bytes, CAST(coalesce(sum(dst_size) FILTER (status = 'done'), 0) AS BIGINT) AS dst_bytes FROM items JOIN j ON job_id = j.id GROUP BY job_id""")
def resume_frame(spark, sf_dir):
    return queue.resume_frame(v.jobs(spark, sf_dir), v.items(spark, sf_dir))


@query(f"WITH {v.MEDIA} SELECT path, doc_id % 5 <> 0 AND doc_id % 29 <> 0 AS hit, doc_id % 5 <> 0 AND doc_id % 29 <> 0 OR doc_id % 2 = 0 AS known FROM media")
def read_through_cache(spark, sf_dir):
    m = probe_json(v.media(spark, sf_dir))
    cache = m.where("doc_id % 5 <> 0").select("path", "size", "mtime", "probe_json")
    probed = m.where("doc_id % 2 = 0").select("path", F.lit('{"streams": []}').alias("probe_json"))
    rows, after = queue.read_through(m.select("path", "size", "mtime"), cache, probed)
    again = after.select("path", (F.col("probe_json") != "{}").alias("known"))
    return rows.select("path", "hit").join(again, "path")


@query(f"""WITH {_CATEGORY} SELECT CAST(count(*) * 2 AS BIGINT) AS files_seen, true AS cancelled FROM cat WHERE readable AND category IN ('other', 'media')""")
def merge_walks(spark, sf_dir):
    one = scan.counters(v.files(spark, sf_dir))
    walks = one.withColumn("cancelled", F.lit(False)).unionByName(one.withColumn("cancelled", F.lit(True)))
    return scan.merge_counters(walks).select("files_seen", "cancelled")


_FOLD = f"""WITH RECURSIVE {v.RESULTS}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM results),
s AS (SELECT DISTINCT id, 0::BIGINT AS k, 'pending' AS status, NULL::VARCHAR AS skip_reason, NULL::VARCHAR AS dst_path, NULL::BIGINT AS dst_size, NULL::BIGINT AS elapsed_ms, NULL::VARCHAR AS error_code, NULL::VARCHAR AS error_msg FROM results
  UNION ALL SELECT s.id, s.k + 1,
    CASE WHEN type = 'started' THEN CASE WHEN status = 'pending' THEN 'running' ELSE status END WHEN type = 'requeued' THEN 'pending' ELSE type END,
    CASE type WHEN 'done' THEN NULL WHEN 'skipped' THEN reason ELSE skip_reason END, CASE type WHEN 'done' THEN n.dst_path ELSE s.dst_path END, CASE type WHEN 'done' THEN n.dst_size ELSE s.dst_size END,
    CASE type WHEN 'done' THEN n.elapsed_ms ELSE s.elapsed_ms END, CASE type WHEN 'done' THEN NULL WHEN 'failed' THEN code ELSE error_code END, CASE type WHEN 'done' THEN NULL WHEN 'failed' THEN msg ELSE error_msg END
  FROM s JOIN n ON n.id = s.id AND n.k = s.k + 1)
SELECT id, status, skip_reason, dst_path, dst_size, elapsed_ms, error_code, error_msg FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1"""


def blank_items(results: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return results.select("id").distinct().select("id", F.lit("pending").alias("status"), none.alias("skip_reason"), none.alias("dst_path"), F.lit(None).cast("long").alias("dst_size"), F.lit(None).cast("long").alias("elapsed_ms"), none.alias("error_code"), none.alias("error_msg"))


@query(_FOLD)
def fold_results(spark, sf_dir):
    r = v.results(spark, sf_dir)
    return queue.fold_results(blank_items(r), r)


@query(_FOLD)
def stream_fold(spark, sf_dir):
    r = v.results(spark, sf_dir)
    return bookkeeping.run_to_end(spark, r, blank_items(r))


@query(f"""WITH {v.ITEMS}, s AS (SELECT job_id, kind = 'video' AS video, count(*) FILTER (status = 'pending') AS pending, coalesce(sum(est_secs) FILTER (status IN ('pending', 'running')), 0) AS rem, coalesce(sum(est_secs) FILTER (status = 'done'), 0) AS did, coalesce(sum(elapsed_ms) FILTER (status = 'done'), 0) / 1000.0::DOUBLE AS act FROM items GROUP BY 1, 2),
c AS (SELECT job_id, video, pending, rem * CASE WHEN did >= 5 AND act > 0 THEN act / did ELSE 1 END AS left_s FROM s)
SELECT job_id, CAST(sum(pending) AS BIGINT) AS pending, CASE WHEN sum(pending) > 0 THEN round(sum(left_s / CASE WHEN video THEN 1.21::DOUBLE ELSE {8**0.9!r}::DOUBLE END), 4) END AS eta FROM c GROUP BY job_id""")
def time_left(spark, sf_dir):
    return queue.time_left(v.items(spark, sf_dir)).withColumn("eta", F.round("eta", 4))


@query(f"WITH {v.ITEMS} SELECT job_id, CAST(quantile_disc(src_size, 0.5) AS DOUBLE) AS median_bytes, max(src_size) AS peak_bytes, round(avg(est_secs), 6) AS mean_secs FROM items GROUP BY job_id")
def sample_medians(spark, sf_dir):
    items = v.items(spark, sf_dir)
    return items.groupBy("job_id").agg(queue.lower_median(items, "src_size").cast("double").alias("median_bytes"), F.max("src_size").alias("peak_bytes"), F.round(F.avg("est_secs"), 6).alias("mean_secs"))


@query(f"WITH {v.ITEMS} SELECT job_id, CAST(trunc(sum(est_secs) * 1.5::DOUBLE) AS BIGINT) AS required, CASE WHEN job_id % 4 < 3 THEN sum(est_secs) * (1 + job_id % 4) < trunc(sum(est_secs) * 1.5::DOUBLE) ELSE false END AS short FROM items GROUP BY job_id")
def space_check(spark, sf_dir):
    g = v.items(spark, sf_dir).groupBy("job_id").agg(F.sum("est_secs").alias("e"))
    return g.select("job_id", est.space_required(F.col("e")).alias("required"), est.space_is_short(F.col("e"), F.when(F.col("job_id") % 4 < 3, F.col("e") * (1 + F.col("job_id") % 4))).alias("short"))


@query(f"""WITH {v.ITEMS} SELECT id, CASE WHEN b < 1000 THEN b || ' B' WHEN b < 1000000 THEN printf('%.1f KB', b / 1000.0::DOUBLE) WHEN b < 1000000000 THEN printf('%.1f MB', b / 1000.0::DOUBLE / 1000.0::DOUBLE) ELSE printf('%.1f GB', b / 1000.0::DOUBLE / 1000.0::DOUBLE / 1000.0::DOUBLE) END AS bytes,
 CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS duration, CASE WHEN b <= 0 THEN '—' WHEN b >= 10000000 THEN printf('%.0f Mbps', b / 1e6) WHEN b >= 1000000 THEN printf('%.1f Mbps', b / 1e6) ELSE (CAST(floor(b / 1000.0::DOUBLE + 0.5) AS BIGINT)) || ' kbps' END AS rate
FROM (SELECT id, src_size * (id % 1000) AS b, CAST(id % 9000 AS BIGINT) AS s FROM items)""")
def display_texts(spark, sf_dir):
    rows = v.items(spark, sf_dir).select("id", (F.col("src_size") * (F.col("id") % 1000)).alias("b"), (F.col("id") % 9000).alias("s"))
    return rows.select("id", display.bytes_text(F.col("b")).alias("bytes"), display.duration_text(F.col("s").cast("double")).alias("duration"), display.bitrate_text(F.col("b").cast("double")).alias("rate"))


@query("""SELECT id, CASE WHEN thermal = 'critical' THEN 0 ELSE greatest(1, CAST(floor(gate * CASE WHEN thermal = 'serious' THEN 0.5 ELSE 1 END * CASE WHEN low THEN 0.5 ELSE 1 END) AS BIGINT)) END AS permits
FROM (SELECT event_id AS id, event_id % 9 AS gate, ['nominal', 'serious', 'critical'][event_id % 3 + 1] AS thermal, event_id % 2 = 0 AS low FROM events)""")
def power_gates(spark, sf_dir):
    n = F.col("event_id")
    e = v.table(spark, sf_dir, "events").select(n.alias("id"), (n % 9).alias("gate"), F.when(n % 3 == 0, "nominal").when(n % 3 == 1, "serious").otherwise("critical").alias("thermal"), (n % 2 == 0).alias("low"))
    return e.select("id", pol.power_scale(F.col("gate"), F.col("thermal"), F.col("low")).alias("permits"))


@query(f"WITH {v.FILES}, d AS (SELECT path, unnest(string_split(path, '/')[2:-2]) AS part FROM files) SELECT part, count(*) AS n, ends_with(part, '.photoslibrary') AS bundle, ends_with(part, '.photoslibrary') AS skipped FROM d GROUP BY part")
def skipped_dirs(spark, sf_dir):
    parts = F.filter(F.split(parent(F.col("path")), "/"), lambda s: s != "")
    d = v.files(spark, sf_dir).select(F.explode(parts).alias("part"))
    return d.groupBy("part").agg(F.count("*").alias("n")).select("part", "n", is_bundle(F.col("part")).alias("bundle"), is_skipped_dir(F.col("part")).alias("skipped"))


@query(f"WITH {v.MEDIA} SELECT {_W} AS kind, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM media GROUP BY 1")
def kind_totals(spark, sf_dir):
    return v.media(spark, sf_dir).groupBy(media_kind(F.col("class")).alias("kind")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
