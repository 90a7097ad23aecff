"""Metadata of media files from the JSON that a probe tool prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STREAM = (
    "index: int, codec_name: string, codec_tag_string: string, codec_type: string, width: int, height: int, avg_frame_rate: string, duration: string, "
    "color_transfer: string, color_primaries: string, color_space: string, disposition: struct<attached_pic: int>"
)
PROBE_DDL = f"format struct<duration: string>, streams array<struct<{_STREAM}>>"
TEXT_SUBTITLES = ("mov_text", "ttml")


def parse(text: Column) -> Column:
    """The probe's JSON as a struct; what can't be read is null, never an error."""
    return F.from_json(text, PROBE_DDL)


def rate(text: Column) -> Column:
    """30000/1001 as a number; null for a zero denominator, a numerator that is not positive, or no fraction at all."""
    parts = F.split(text, "/")
    num, den = (F.get(parts, F.lit(i)).try_cast("double") for i in (0, 1))
    return F.when((F.size(parts) == 2) & (num > 0) & (den != 0), num / den)


def known(text: Column) -> Column:
    """A trimmed string; null where it is empty, unknown or N/A."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")
    return F.when(~t.isin("", "unknown", "N/A"), t)


def pick_stream(streams: Column, kind: str) -> Column:
    """The first stream of a kind that is no attached picture."""
    fits = F.filter(streams, lambda s: (s["codec_type"] == kind) & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0))
    return F.get(fits, F.lit(0))


def duration_us(stream: Column, container: Column) -> Column:
    """Microseconds; the stream's own length goes before the container's, where it is a finite number over 0."""

    def usable(text: Column) -> Column:
        secs = text.try_cast("double")
        return F.when((secs > 0) & (secs < float("inf")), secs)

    return (F.coalesce(usable(stream["duration"]), usable(container)) * 1e6).cast("long")


def probed(text: Column, cls: Column) -> dict[str, Column]:
    """The columns that the decisions need."""
    doc = parse(text)
    s = F.when(cls == "audio", pick_stream(doc["streams"], "audio")).otherwise(pick_stream(doc["streams"], "video"))
    return {
        "width": F.coalesce(s["width"], F.lit(0)),
        "height": F.coalesce(s["height"], F.lit(0)),
        "codec": known(s["codec_name"]),
        "codec_tag": known(s["codec_tag_string"]),
        "fps": F.when(cls == "video", rate(s["avg_frame_rate"])),
        "duration_us": duration_us(s, doc["format"]["duration"]),
        "color_transfer": known(s["color_transfer"]),
        "color_primaries": known(s["color_primaries"]),
        "color_space": known(s["color_space"]),
    }


def audio_source(text: Column) -> dict[str, Column]:
    """Codec of the first audio stream, and the index of the cover picture."""
    streams = parse(text)["streams"]
    cover = F.get(F.filter(streams, lambda s: s["disposition"]["attached_pic"] == 1), F.lit(0))
    return {"audio_codec": known(F.get(F.filter(streams, lambda s: s["codec_type"] == "audio"), F.lit(0))["codec_name"]), "cover_index": cover["index"]}


def video_source(text: Column) -> dict[str, Column]:
    """Subtitle codecs, and the container that can hold them: mp4 only for text subtitles."""
    subs = F.transform(F.filter(parse(text)["streams"], lambda s: s["codec_type"] == "subtitle"), lambda s: s["codec_name"])
    fits = F.forall(subs, lambda c: F.coalesce(c.isin(*TEXT_SUBTITLES), F.lit(False)))
    return {"subtitles": subs, "container": F.when(F.coalesce(fits, F.lit(True)), "mp4").otherwise("mkv")}


def vmaf_mean(text: Column) -> Column:
    return F.get_json_object(text, "$.pooled_metrics.vmaf.mean").try_cast("double")


#: Keys of progress lines, and the type that their values must have; others say nothing. Two names for the
#: time that is done, both in microseconds.
PROGRESS_KEYS = {"frame": "bigint", "fps": "double", "out_time_us": "bigint", "total_size": "bigint", "speed": "double"}
_TIME_KEYS = ("out_time_us", "out_time_ms")


def progress_frames(lines: DataFrame) -> DataFrame:
    """process, seq and the values of PROGRESS_KEYS and done, a row for each line progress=, from lines (process, seq, line).

    A value stays until a later line has one that can be read, so what a tool doesn't know for a while isn't forgotten.
    """
    parts = F.split("line", "=", 2)
    key, value = F.trim(parts[0]), F.trim(F.get(parts, F.lit(1)))
    said = lines.select("process", "seq", key.alias("key"), F.when(key == "speed", F.regexp_replace(value, "x+$", "")).otherwise(value).alias("value"))
    before = Window.partitionBy("process").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def latest(name: str, kind: str) -> Column:
        mine = F.col("key").isin(*_TIME_KEYS) if name in _TIME_KEYS else F.col("key") == name
        return F.last(F.when(mine, F.col("value").try_cast(kind)), ignorenulls=True).over(before)

    full = said.select("process", "seq", "key", *(latest(k, t).alias(k) for k, t in PROGRESS_KEYS.items()), (F.col("value") == "end").alias("done"))
    return full.where(F.col("key") == "progress").drop("key")


def progress(lines: Column) -> Column:
    """The last value of each key of key=value lines, as a map; lines of other forms say nothing."""
    pairs = F.filter(F.transform(lines, lambda t: F.split(F.trim(t), "=", 2)), lambda p: F.size(p) == 2)
    # later lines overwrite earlier ones: keep the last pair of each key
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p[0].alias("k"), p[1].alias("v"), i.alias("i"))), lambda x: F.lit(True))
    kept = F.filter(last, lambda x: ~F.exists(last, lambda y: (y["k"] == x["k"]) & (y["i"] > x["i"])))
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["k"], x["v"])))


def fraction(done_us: Column, total_us: Column) -> Column:
    return F.when(total_us > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), done_us / total_us)))
