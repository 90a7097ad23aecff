"""Queries over tables and files that are laid out on disk first. With these the list is complete."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.functions import pictures
from cairnspark.functions.policy import Profile
from cairnspark.operators import clustered, exact, filework, near, review, scan
from cairnspark.plans import adapters as v
from cairnspark.plans import sessions
from cairnspark.plans.catalog import _CATEGORY, _DELETES, _TIERS, _WALK, JOB, PROFILE, ROOTS, THRESHOLD, WINDOW, members
from cairnspark.plans.catalog_live import ORACLE, QUERIES, query
from cairnspark.plans.checkpoint import cut, importable, shared_dir
from cairnspark.sources import tree

__all__ = ["ORACLE", "QUERIES"]


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- clustered pages ----------------------------------------------------------------------------------------------


def _clustered(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    folder = _new_folder(spark, "items")
    return folder, clustered.write(v.items(spark, sf_dir), folder)


_COUNTED = ", ".join([*(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("pending", "running", "done", "skipped", "failed")), *(f"count(*) FILTER (status = 'pending' AND kind = '{k}') AS pending_{k}" for k in ("image", "video", "audio"))])


@query(f"WITH {v.ITEMS} SELECT job_id, min(id) AS first_id, max(id) AS last_id, count(*) AS n, {_COUNTED} FROM items GROUP BY job_id")
def clustered_index(spark, sf_dir):
    """The index of a clustered queue, its files added up by job."""
    _, index = _clustered(spark, sf_dir)
    sums = [F.sum(c).alias(c) for c in index.columns if c not in ("file", "job_id", "first_id", "last_id")]
    return index.groupBy("job_id").agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), *sums)


@query(ORACLE["items_page"])
def clustered_page(spark, sf_dir):
    return clustered.page(spark, _clustered(spark, sf_dir)[0], JOB, "skipped", 200, 100)


@query(ORACLE["keyset_page"])
def clustered_keyset(spark, sf_dir):
    return clustered.take_pending(spark, _clustered(spark, sf_dir)[0], JOB, ["image", "audio"], 1000)


# --- the walk -----------------------------------------------------------------------------------------------------


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """Documents written as files, some below hidden, system and bundle folders; then links, hard and soft."""
    root = _new_folder(spark, "tree")
    f = v.files(spark, sf_dir).join(v.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")
    soft, hard = F.col("doc_id") % 29 == 4, F.col("doc_id") % 9 == 2
    tree.write_files(f.where(~soft & ~hard).select("path", "content", "mtime"), root)
    first = f.select((F.col("doc_id") + 1).alias("doc_id"), F.col("path").alias("target"), (~soft & ~hard).alias("written"))
    linked = f.where(~soft & hard).join(first.where("written"), "doc_id")
    tree.link_files(linked.select("path", "target", F.lit(True).alias("hard")).unionByName(f.where(soft).select("path", F.lit("/vol").alias("target"), F.lit(False).alias("hard"))), root)
    tree.write_files(spark.range(1).select(F.lit("/plain").alias("path"), F.lit("no folder").alias("content"), F.lit(0).alias("mtime")), root)
    return root


def _roots(root: str) -> list[str]:
    return [f"{root}/{x}" for x in ("vol", "plain", "none")]


#: A second row of an inode that was written: its first row's file, if that was one.
_TREE = f"""{_CATEGORY}, there AS (
  SELECT cat.*, strlen(text) AS bytes, cat.doc_id % 9 = 2 AS hard, cat.doc_id % 29 = 4 AS soft FROM cat JOIN documents USING (doc_id)),
stood AS (
  SELECT t.*, CASE WHEN t.hard THEN coalesce(o.bytes, 0) ELSE coalesce(t.bytes, 0) END AS file_bytes, CASE WHEN t.hard THEN t.doc_id - 1 ELSE t.doc_id END AS node
  FROM there t LEFT JOIN there o ON o.doc_id = t.doc_id - 1 AND NOT o.soft AND NOT o.hard
  WHERE NOT t.soft AND (NOT t.hard OR o.doc_id IS NOT NULL)),
uniq AS (SELECT node, max(file_bytes) AS file_bytes FROM stood WHERE category = 'media' GROUP BY node),
opened AS (SELECT doc_id, path, category FROM there WHERE category = 'bundle' AND doc_id IN (SELECT doc_id FROM stood) OR category = 'bundle' AND soft)"""


@query(f"""WITH {_TREE}
SELECT count(*) FILTER (category IN ('media', 'other')) AS files_seen, (SELECT count(*) FROM uniq) AS media_found, (SELECT CAST(coalesce(sum(file_bytes), 0) AS BIGINT) FROM uniq) AS bytes,
  count(*) FILTER (category = 'media') - (SELECT count(*) FROM uniq) AS hardlinks_skipped, count(*) FILTER (category = 'other') AS non_media, count(*) FILTER (category = 'sidecar') AS sidecars,
  (SELECT count(DISTINCT regexp_extract(path, '^(.*[.]photoslibrary)/', 1)) FROM opened) AS bundles_skipped, CAST(0 AS BIGINT) AS errors, false AS cancelled FROM stood""")
def walked_counters(spark, sf_dir):
    """The counters of a walk over a tree of files, links and bundles."""
    return scan.walk_counters(tree.walk(spark, _roots(_tree(spark, sf_dir))))


@query(f"""WITH {_TREE}, found AS (SELECT count(*) AS n FROM stood WHERE category NOT IN ('pruned', 'bundle'))
SELECT 'vol' AS root, 'ok' AS state, n AS files FROM found UNION ALL SELECT 'plain', 'denied', 0 UNION ALL SELECT 'none', 'missing', 0""")
def walked_roots(spark, sf_dir):
    """What each root was like, and how many files the walk met below it."""
    w = tree.walk(spark, _roots(_tree(spark, sf_dir)))
    state = F.max(F.when(F.col("kind").isin("ok", "denied", "missing"), F.col("kind")))
    return w.groupBy("root").agg(state.alias("state"), F.count_if(F.col("kind") == "file").alias("files")).withColumn("root", F.element_at(F.split("root", "/"), -1))


# --- pictures -----------------------------------------------------------------------------------------------------

_WIDTH = 64


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as grey pictures of 64 columns: path, size, mtime, content."""
    importable(spark)
    d = v.table(spark, sf_dir, "documents").where("octet_length(text) > 0").select("doc_id", F.col("text").cast("binary").alias("b"))
    rows = F.ceil(F.octet_length("b") / _WIDTH).cast("int")
    head = F.concat(F.lit(f"P5\n{_WIDTH} "), rows.cast("string"), F.lit("\n255\n")).cast("binary")
    return d.select("doc_id", F.concat(F.lit("/pic/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.octet_length("b").cast("long").alias("size"), (F.col("doc_id") % 1000).alias("mtime"), F.concat(head, F.rpad("b", rows * _WIDTH, F.lit(b"\x00"))).alias("content"))


_PIXELS = f"""raw AS (
  SELECT doc_id, strlen(text) AS n, (strlen(text) + {_WIDTH - 1}) // {_WIDTH} AS h,
    list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS INTEGER)) AS bytes
  FROM documents WHERE strlen(text) > 0),
pixels AS (SELECT doc_id, h, unnest(list_resize(bytes, h * {_WIDTH}, 0)) AS v, unnest(range(0, h * {_WIDTH})) AS i FROM raw),
strips AS (SELECT doc_id, h, i // {_WIDTH} AS y, i % {_WIDTH} // {_WIDTH // 16} AS kx, sum(v) AS v FROM pixels GROUP BY ALL),
cells AS (
  SELECT doc_id, k AS ky, kx, sum(v * (least((y + 1) * 16, (k + 1) * h) - greatest(y * 16, k * h))) AS v
  FROM (SELECT *, unnest(range(y * 16 // h, ((y + 1) * 16 - 1) // h + 1)) AS k FROM strips) GROUP BY doc_id, k, kx),
totals AS (SELECT doc_id, sum(v) AS total FROM cells GROUP BY doc_id),
lanes AS (
  SELECT doc_id, (ky * 16 + kx) // 64 AS lane, CAST(sum(CASE WHEN v * 256 >= total THEN CAST(1 AS UBIGINT) << CAST((ky * 16 + kx) % 64 AS UBIGINT) ELSE CAST(0 AS UBIGINT) END) AS UBIGINT) AS fp
  FROM cells JOIN totals USING (doc_id) GROUP BY ALL),
wide AS (SELECT doc_id, {", ".join(f"max(fp) FILTER (lane = {k}) AS fp{k}" for k in range(4))} FROM lanes GROUP BY doc_id),
spreads AS (SELECT doc_id, round(stddev_pop(v), 6) AS spread FROM pixels GROUP BY doc_id)"""


@query(f"""WITH {_PIXELS} SELECT doc_id, {" || ".join(f"lower(printf('%016X', fp{k}))" for k in range(4))} AS hex, spread FROM wide JOIN spreads USING (doc_id)""")
def picture_prints(spark, sf_dir):
    p = _pictures(spark, sf_dir).select("doc_id", pictures.picture_print(F.col("content")).alias("p"))
    return p.select("doc_id", pictures.to_hex([F.col(f"p.fp{k}") for k in range(4)]).alias("hex"), F.round("p.spread", 6).alias("spread"))


_PICTURE_PAIRS = " + ".join(f"CAST(bit_count(xor(a.fp{k}, b.fp{k})) AS BIGINT)" for k in range(4))


@query(f"""WITH RECURSIVE {_PIXELS}, o AS (
  SELECT '/pic/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, n AS size, fp0, fp1, fp2, fp3, row_number() OVER (ORDER BY doc_id) AS ord FROM wide JOIN raw USING (doc_id)),
e AS (SELECT a.ord AS a, b.ord AS b, CAST({_PICTURE_PAIRS} AS BIGINT) AS distance FROM o a JOIN o b ON a.ord < b.ord WHERE {_PICTURE_PAIRS} <= {THRESHOLD}){_WALK} SELECT * FROM near""")
def picture_groups(spark, sf_dir):
    """Near groups of pictures, some of whose prints a cache knows."""
    files = _pictures(spark, sf_dir)
    known = cut(files.where("doc_id % 3 = 0").select("path", F.lit(pictures.ALGO).alias("algo"), "size", "mtime", pictures.picture_hex(F.col("content")).alias("hash")))
    prints = near.cached_prints(files, known, pictures.picture_hex(F.col("content")), pictures.ALGO)
    return near.groups(cut(prints.select("path", "size", *v.LANES)), THRESHOLD, v.LANES, cut)


# --- files put in place and put away ------------------------------------------------------------------------------


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("/out/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".bin")).alias("target"), F.coalesce("text", F.lit("")).alias("text"), (F.lit(1_700_000_000) + F.col("doc_id")).alias("mtime"))


def _output(text):
    """What an encoder might give: half of most texts, all of some, nothing of others."""
    n = F.col("id") % 5
    return F.when(n == 0, F.lit("")).when(n == 1, text).otherwise(F.upper(F.md5(text)))


_OUTPUTS = """sources AS (SELECT doc_id AS id, '/out/' || source || '/' || doc_id || '.bin' AS target, coalesce(text, '') AS text FROM documents WHERE source IS NOT NULL),
outputs AS (SELECT *, CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN text ELSE upper(md5(text)) END AS output, CASE WHEN id % 3 = 0 THEN 'old ' || id END AS old FROM sources),
gated AS (
  SELECT *, CASE WHEN strlen(output) = 0 THEN 'error' WHEN strlen(text) = 0 OR strlen(output) >= strlen(text) * {keep} // 100 THEN 'no_gain' ELSE 'written' END AS outcome FROM outputs)"""


@query(f"""WITH {_OUTPUTS.format(keep=100 - Profile().output.min_gain_percent)}
SELECT id, target, outcome, CAST(strlen(output) AS BIGINT) AS bytes, CASE WHEN outcome = 'written' THEN sha256(output) WHEN old IS NOT NULL THEN sha256(old) END AS sha256_now,
  CASE WHEN outcome = 'written' THEN 1700000000 + id WHEN old IS NOT NULL THEN 5 END AS mtime_now FROM gated""")
def committed_outputs(spark, sf_dir):
    """Outputs staged twice, as if a task had been lost, and published twice; then what stands at the targets."""
    root, aside = _new_folder(spark, "outputs"), _new_folder(spark, "staged")
    s = _sources(spark, sf_dir).where("target IS NOT NULL")
    tree.write_files(s.where("id % 3 = 0").select(F.col("target").alias("path"), F.concat(F.lit("old "), F.col("id").cast("string")).alias("content"), F.lit(5).alias("mtime")), root)
    outputs = s.select("id", "target", _output(F.col("text")).alias("content"), F.octet_length("text").alias("src_size"), "mtime")
    filework.stage(outputs, aside)
    manifest = filework.stage(outputs, aside)
    filework.publish(manifest, root, Profile())
    done = filework.publish(manifest, root, Profile())
    now = tree.file_states(s.select(F.col("target").alias("path")), root).select(F.col("path").alias("target"), F.sha2("content", 256).alias("sha256_now"), F.col("mtime").alias("mtime_now"))
    return done.join(now, "target", "left").select("id", "target", "outcome", "bytes", "sha256_now", "mtime_now")


@query(f"""{_DELETES} SELECT id, CASE WHEN note IS NULL THEN 'trashed' ELSE 'skipped' END AS outcome, note, note IS NULL OR note = 'missing' AS gone FROM d""")
def removed_files(spark, sf_dir):
    """Members of exact groups as files, some changed since, moved to a trash folder; the removal is done twice."""
    root, trash = _new_folder(spark, "copies"), _new_folder(spark, "trash")
    m = cut(review.apply_policy(members(spark, sf_dir), "oldest"))
    c = v.candidates(spark, sf_dir).select("path", "content")
    n = F.col("id") % 6
    here = m.where("disposal IS NULL").select("id", "path", "keep", "mtime")
    size = here.agg(F.sum(F.octet_length("path") + 32)).first()[0] or 0
    held = c.join(F.broadcast(here) if size <= exact.BROADCAST_BYTES else here, "path")  # content needn't be shuffled
    changed = F.when((F.col("keep") == 0) & (n == 2), F.concat("content", F.lit("+"))).otherwise(F.col("content"))
    there = held.where((F.col("keep") == 1) | ~n.isin(0, 1)).select("path", changed.alias("content"), (F.col("mtime") + F.when((F.col("keep") == 0) & (n == 3), 1).otherwise(0)).alias("mtime"))
    tree.write_files(there, root)
    tree.link_files(held.where((F.col("keep") == 0) & (n == 1)).select("path", F.lit("/none").alias("target"), F.lit(False).alias("hard")), root)
    journal = filework.intend(m, trash)
    filework.remove(journal, root)
    done = filework.apply_removals(m, root, trash)
    now = tree.file_states(m.select("path"), root).select("path", F.lit(True).alias("here"))
    return done.join(now, "path", "left").select("id", "outcome", "note", F.col("here").isNull().alias("gone"))


# --- whole sessions -----------------------------------------------------------------------------------------------


def _told(name: str, columns: str) -> str:
    return f"SELECT {columns} FROM ({ORACLE[name]})"


@query(
    " UNION ALL ".join([
        _told("report_kind_groups", "'kind' AS part, kind AS name, files, bytes"),
        _told("report_skip_groups", "'skipped', skip_reason, files, bytes"),
        _told("report_top_dirs", "'dir', path, files, bytes"),
        _told("report_progress", "'planned', '', planned, bytes"),
        _told("estimate_summary", "'estimate', '', files, src_bytes"),
        _told("queue_rows", "'items', kind, count(*), CAST(sum(src_size) AS BIGINT)") + " GROUP BY kind",
    ])
)
def scan_session(spark, sf_dir):
    """A whole scan: the report's tables and the rows of the new job, from rows that are planned once."""
    t = sessions.scan_session(v.media(spark, sf_dir), ROOTS, JOB, PROFILE)
    items = t["items"].groupBy("kind").agg(F.count("*").alias("files"), F.sum("src_size").alias("bytes"))
    parts = {
        "kind": t["kinds"].select(F.col("kind").alias("name"), "files", "bytes"), "skipped": t["skipped"].select(F.col("skip_reason").alias("name"), "files", "bytes"), "dir": t["dirs"].select(F.col("path").alias("name"), "files", "bytes"),
        "planned": t["progress"].select(F.lit("").alias("name"), F.col("planned").alias("files"), "bytes"), "estimate": t["estimate"].select(F.lit("").alias("name"), "files", F.col("src_bytes").alias("bytes")),
        "items": items.select(F.col("kind").alias("name"), "files", "bytes"),
    }
    out = None
    for part, rows in parts.items():
        rows = rows.select(F.lit(part).alias("part"), "name", F.col("files").cast("long").alias("files"), F.col("bytes").cast("long").alias("bytes"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""{_TIERS}, mem AS (
  SELECT row_number() OVER (ORDER BY group_rank, string_split(path, '/')) AS id, group_rank AS group_id, path, r.size, mtime FROM r JOIN t3 ON r.hash = t3.hash AND r.size = t3.size),
k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY len(list_filter(string_split(path, '/'), lambda s: s <> '')) + 1, string_split(path, '/')) AS rn FROM mem)
SELECT id, group_id, path, size, mtime, CASE WHEN rn = 1 THEN 1 ELSE 0 END AS keep FROM k""")
def dedup_session(spark, sf_dir):
    """A whole search for exact duplicates, with the shallowest path of each group kept."""
    return sessions.dedup_session(v.candidates(spark, sf_dir), window=WINDOW).select("id", "group_id", "path", "size", "mtime", "keep")
