"""The scan of an inventory and its report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.functions import estimate as est
from cairnspark.functions import probe
from cairnspark.functions.media import image_size
from cairnspark.functions.paths import KIND_ORDER, classify, extension, is_bundle, is_sidecar, is_skipped_dir, is_system_junk, is_under, media_kind, needs_probe, parent, root_label, segments
from cairnspark.functions.policy import Profile, decide
from cairnspark.operators.queue import cached_probe
from cairnspark.operators.ranking import one_row

TOP_DIRS = 8


def with_category(files: DataFrame) -> DataFrame:
    """files with class and category: pruned, bundle, junk, sidecar, other or media, in the order a scan decides it."""
    path, name = F.col("path"), F.col("name")
    dirs = F.slice(segments(path), 1, F.greatest(F.size(segments(path)) - 1, F.lit(0)))
    hidden = F.exists(dirs, lambda s: s.startswith("."))
    cls = classify(path)
    category = (
        F.when(F.exists(dirs, is_bundle), "bundle").when(hidden | F.exists(dirs, is_skipped_dir), "pruned").when(is_system_junk(name), "junk").when(is_sidecar(name), "sidecar").when(cls.isNull(), "other").otherwise("media")
    )
    return files.withColumn("class", cls).withColumn("category", category)


def bundle_paths(files: DataFrame) -> DataFrame:
    """The distinct bundle folders, each up to its bundle component."""
    s = segments(F.col("path"))
    at = F.array_min(F.filter(F.transform(s, lambda x, i: F.when(is_bundle(x), i + 1)), lambda i: i.isNotNull()))
    return files.where("category = 'bundle'").select(F.concat(F.lit("/"), F.concat_ws("/", F.slice(s, F.lit(1), at))).alias("bundle")).distinct()


def drop_hard_links(files: DataFrame, order: str = "path") -> DataFrame:
    """One row of those that share a device and an inode, the first by order; files with a single link are left alone.

    Inode numbers mean nothing across devices. Only the rows with several links are looked at, and reduced before the shuffle.
    """
    key = F.split(order, "/") if order == "path" else F.col(order)
    many = files.where("nlink > 1").groupBy("dev", "inode").agg(F.min_by(F.struct(*files.columns), key).alias("_row")).select("_row.*")
    return files.where("nlink <= 1 OR nlink IS NULL").unionByName(many)


def counters(files: DataFrame, cancelled: bool = False) -> DataFrame:
    """One row of scan counters. Pruned folders and junk count nowhere; sidecars only as such; the rest as seen.

    Entries that aren't readable count as errors and nowhere else. cancelled tells whether the walk was broken off.
    """
    seen = F.col("category").isin("other", "media")
    errors = files.agg(F.count_if(~F.col("readable")).alias("errors"))
    keep = with_category(files.where("readable"))
    unique = drop_hard_links(keep.where("category = 'media'"))
    base = keep.agg(F.count_if(seen).alias("files_seen"), F.count_if(F.col("category") == "other").alias("non_media"), F.count_if(F.col("category") == "sidecar").alias("sidecars"), F.count_if(F.col("category") == "media").alias("linked"))
    media = unique.agg(F.count("*").alias("media_found"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    bundles = bundle_paths(keep).agg(F.count("*").alias("bundles_skipped"))
    one = one_row(base, media, bundles, errors)
    return one.select("files_seen", "media_found", "bytes", (F.col("linked") - F.col("media_found")).alias("hardlinks_skipped"), "non_media", "sidecars", "bundles_skipped", "errors", F.lit(cancelled).alias("cancelled"))


def walk_counters(walked: DataFrame, cancelled: bool = False) -> DataFrame:
    """counters() of what a walk has met (sources.tree): its bundles stayed closed, and its errors are rows."""
    files = with_category(walked.where("kind = 'file'"))
    media = files.where("category = 'media'")
    unique = drop_hard_links(media)
    base = files.agg(F.count_if(F.col("category").isin("other", "media")).alias("files_seen"), *(F.count_if(F.col("category") == c).alias(n) for c, n in (("other", "non_media"), ("sidecar", "sidecars"), ("media", "linked"))))
    found = unique.agg(F.count("*").alias("media_found"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    rest = walked.agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in (("bundle", "bundles_skipped"), ("error", "errors"))))
    one = one_row(base, found, rest)
    return one.select("files_seen", "media_found", "bytes", (F.col("linked") - F.col("media_found")).alias("hardlinks_skipped"), "non_media", "sidecars", "bundles_skipped", "errors", F.lit(cancelled).alias("cancelled"))


def merge_counters(rows: DataFrame) -> DataFrame:
    """Counters of several walks as one: sums, and cancelled if any was."""
    sums = [F.sum(c).alias(c) for c in rows.columns if c != "cancelled"]
    return rows.agg(*sums, *([F.coalesce(F.bool_or("cancelled"), F.lit(False)).alias("cancelled")] if "cancelled" in rows.columns else []))


def analyze(found: DataFrame, cache: DataFrame, probed: DataFrame) -> DataFrame:
    """found (path, size, mtime, content) with class, ext, probe_json, width and height of each file.

    Pictures are read from their headers. Video and audio are looked up in the cache of probes (path, size, mtime,
    probe_json), then in probed (path, probe_json), what a probe gave just now; a file that neither knows keeps its size
    and class alone, and is judged with care. A null content of a picture is a picture that can't be read.
    """
    files = found.withColumns({"class": classify(F.col("path")), "ext": F.lower(extension(F.col("path")))}).where("class IS NOT NULL")
    images = files.where(~needs_probe(F.col("class"))).withColumn("_px", image_size(F.col("content")))
    images = images.select("path", "size", "mtime", "class", "ext", F.lit(None).cast("string").alias("probe_json"), F.col("_px.width").alias("width"), F.col("_px.height").alias("height"))
    media = files.where(needs_probe(F.col("class"))).drop("content")
    looked = cached_probe(media, cache).join(probed.select("path", F.col("probe_json").alias("_new")), "path", "left").withColumn("probe_json", F.coalesce("probe_json", "_new"))
    px = probe.probed(F.col("probe_json"), F.col("class"))
    return images.unionByName(looked.select("path", "size", "mtime", "class", "ext", "probe_json", *(F.coalesce(px[c], F.lit(0)).cast("long").alias(c) for c in ("width", "height"))))


def shown(groups: DataFrame, count: str = "files") -> DataFrame:
    """The rows of a report that a reader sees: those that count something."""
    return groups.where(F.col(count) > 0)


def report_scale(dirs: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: the bytes of the largest folder, which bars are drawn against, and the bytes of all that is left alone."""
    return one_row(dirs.agg(F.coalesce(F.max("bytes"), F.lit(0)).alias("largest_dir")), skipped.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("left_alone")))


def probe_columns() -> dict[str, Column]:
    return {c: F.col(c) for c in ("class", "ext", "size", "width", "height", "codec", "codec_tag", "fps", "duration_us", "color_transfer", "color_primaries", "color_space")}


def plan_items(media: DataFrame, profile: Profile | None = None) -> DataFrame:
    """media with kind, skip_reason, and out_bytes, seconds and queue of an estimate."""
    profile, p = profile or Profile(), probe_columns()
    base = est.basis(p, profile)
    wide = media.withColumns({**{f"_{k}": c for k, c in base.items()}, "kind": media_kind(F.col("class")), "skip_reason": decide(p, profile)})
    out, secs, queue = est.item(p, {k: F.col(f"_{k}") for k in base}, profile)
    return wide.withColumns({"out_bytes": out, "seconds": secs, "queue": queue}).drop(*(f"_{k}" for k in base))


def kind_groups(planned: DataFrame) -> DataFrame:
    """Files and bytes to be processed, by kind in display order."""
    order = reduce(lambda acc, kv: F.when(F.col("kind") == kv[0], kv[1]).otherwise(acc), KIND_ORDER.items(), F.lit(len(KIND_ORDER)))
    # counted by condition: a filter on a decision would be pushed down, and with it all its rules be written out again
    todo = F.col("skip_reason").isNull()
    g = planned.groupBy("kind").agg(F.count_if(todo).alias("files"), F.sum(F.when(todo, F.col("size"))).alias("bytes")).where("files > 0")
    return g.withColumn("ord", order.cast("long"))


def skip_groups(planned: DataFrame) -> DataFrame:
    """Files and bytes left alone, by reason; most files first, then by reason."""
    g = planned.groupBy("skip_reason").agg(F.count("skip_reason").alias("files"), F.sum("size").alias("bytes")).where("files > 0")
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("files"), "skip_reason")).cast("long"))


def first_root(path: Column, roots: list[str]) -> Column:
    """The first root of the list that holds the path."""
    return reduce(lambda acc, r: F.when(is_under(path, F.lit(r)), r).otherwise(acc), reversed(roots), F.lit(None).cast("string"))


def longest_root(path: Column, roots: list[str]) -> Column:
    """The root with the most components that holds the path; the first of those that tie."""
    ranked = sorted(enumerate(roots), key=lambda r: (-len([s for s in r[1].split("/") if s]), r[0]))
    return first_root(path, [r for _, r in ranked])


def bucket(path: Column, roots: list[str]) -> Column:
    """The folder that a report counts a file under: the first level below its root, the root itself, or its parent."""
    root = first_root(path, roots)
    inside = F.substring(path, F.length(F.regexp_replace(root, "/$", "")) + 2, F.length(path))
    level = F.when(inside.contains("/"), F.concat(F.regexp_replace(root, "/$", ""), F.lit("/"), F.substring_index(inside, "/", 1))).otherwise(root)
    return F.when(root.isNull(), parent(path)).otherwise(level)


def top_dirs(planned: DataFrame, roots: list[str], n: int = TOP_DIRS) -> DataFrame:
    """The n folders with most bytes, and one row for all others: rank, path ('' for others), dirs, files, bytes.

    Files that are left alone count, too. Folders are summed first, so only folder totals are ranked; the folders under
    the first n are summed again without being ranked.
    """
    g = planned.groupBy(bucket(F.col("path"), roots).alias("path")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    top = g.orderBy(F.desc("bytes"), "path").limit(n)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("bytes"), "path")).cast("long")).select("rank", "path", F.lit(1).cast("long").alias("dirs"), "files", "bytes")
    rest = g.join(F.broadcast(top.select("path")), "path", "left_anti").agg(F.count("*").alias("dirs"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes")).where("dirs > 0")
    return ranked.unionByName(rest.select(F.lit(n + 1).cast("long").alias("rank"), F.lit("").alias("path"), "dirs", "files", "bytes"))


def progress(planned: DataFrame) -> DataFrame:
    """analyzed counts all files, bytes only those that will be processed."""
    todo = F.col("skip_reason").isNull()
    return planned.agg(F.count("*").alias("analyzed"), F.count_if(todo).alias("planned"), F.coalesce(F.sum(F.when(todo, F.col("size"))), F.lit(0)).alias("bytes"))


def estimate_summary(planned: DataFrame, hardware: bool = False, gates: tuple[int, int] = (2, 8)) -> DataFrame:
    """Sums of the estimates of what will be processed; every output is capped at its source before it is summed."""
    # bounds as plain columns first: the sums then refer to them instead of repeating the estimate
    flat = {f"_o_{b}": F.least(F.col(f"out_bytes.{b}"), F.col("size").cast("double")) for b in est.BOUNDS} | {f"_s_{b}": F.col(f"seconds.{b}") for b in est.BOUNDS}
    todo = planned.select(F.when(F.col("skip_reason").isNull(), F.col("queue")).alias("queue"), F.when(F.col("skip_reason").isNull(), F.col("size")).alias("size"), *(F.when(F.col("skip_reason").isNull(), c).alias(k) for k, c in flat.items()))
    sums = [F.count("queue").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("src_bytes")]
    for b in est.BOUNDS:
        sums.append(F.coalesce(F.sum(f"_o_{b}"), F.lit(0.0)).alias(f"out_{b}"))
        for q in ("video", "light"):
            sums.append(F.coalesce(F.sum(F.when(F.col("queue") == q, F.col(f"_s_{b}"))), F.lit(0.0)).alias(f"{q}_{b}"))
    one = todo.agg(*sums)
    for b in est.BOUNDS:
        one = one.withColumn(f"wall_{b}", est.wall_seconds(F.col(f"video_{b}"), F.col(f"light_{b}"), hardware, gates))
    for b, other in zip(est.BOUNDS, reversed(est.BOUNDS), strict=True):
        one = one.withColumn(f"saved_{b}", F.greatest(F.col("src_bytes") - F.col(f"out_{other}"), F.lit(0.0)))
    return one


def estimated_output(planned: DataFrame) -> DataFrame:
    """What a job is expected to write: the estimate of what it processes and the size of what it leaves alone.

    Summed in decimals, so that the order of rows doesn't matter.
    """
    mid = F.least(F.col("out_bytes.mid"), F.col("size").cast("double"))
    todo = F.col("skip_reason").isNull()
    parts = planned.agg(F.greatest(F.coalesce(F.sum(F.when(todo, mid.cast("decimal(28,3)"))), F.lit(0)), F.lit(0)).cast("long").alias("processed"), F.coalesce(F.sum(F.when(~todo, F.col("size"))), F.lit(0)).alias("left_alone"))
    return parts.withColumn("est_out_bytes", F.col("processed") + F.col("left_alone"))


def queue_rows(planned: DataFrame, job_id: int) -> DataFrame:
    """Rows to insert into a work queue."""
    return planned.select(F.lit(job_id).cast("long").alias("job_id"), F.col("path").alias("src_path"), F.col("size").alias("src_size"), F.col("mtime").alias("src_mtime"), "kind", "skip_reason", F.col("seconds.mid").alias("est_secs"))


def job_name(roots: list[str]) -> str:
    """Labels of the roots, each once, in their order."""
    return "、".join(dict.fromkeys(r.rstrip("/").rpartition("/")[2] or r for r in roots))


def job_names(roots: Column) -> Column:
    """job_name of arrays of roots."""
    label = F.transform(roots, lambda r: F.coalesce(F.nullif(F.element_at(F.split(F.regexp_replace(r, "/+$", ""), "/"), -1), F.lit("")), r))
    return F.array_join(F.array_distinct(label), "、")


def output_dir(path: Column, roots: list[str], output_root: str | None) -> Column:
    """The folder of an output: beside its source, or the source's tree mirrored below output_root.

    With several roots each has a folder of its label; a source outside all roots goes to output_root itself.
    """
    if output_root is None:
        return parent(path)
    out, root = output_root.rstrip("/"), longest_root(path, roots)
    inside = parent(F.substring(path, F.length(F.regexp_replace(root, "/$", "")) + 1, F.length(path)))
    label = F.concat(F.lit("/"), root_label(root)) if len(roots) > 1 else F.lit("")
    return F.when(root.isNull(), output_root).otherwise(F.concat(F.lit(out), label, F.regexp_replace(inside, "/$", "")))
