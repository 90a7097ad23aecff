"""Settings, and the decisions that follow from them, as Column functions."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnspark.functions import naming
from cairnspark.functions.paths import media_kind

#: The longest edge that the image format takes.
MAX_EDGE = 65536
FPS_SLACK = 0.01
#: Stable ids of the reasons to leave a file alone, with what they mean.
SKIP_REASONS = {
    "disabled": "files of this kind are switched off in the settings",
    "raw_excluded": "RAW files are left alone: transcoding would lose sensor data",
    "too_small": "the file is too small to gain anything",
    "already_optimal": "the file has the target format and needs no scaling",
    "hdr_unsupported": "HDR video would lose its colour data",
    "too_large": "the picture is larger than the encoder takes",
    "no_gain": "the output was hardly smaller, so the original stays",
    "low_quality": "the output was under the quality gate, so the original stays",
    "src_changed": "the source has changed since the scan",
    "src_missing": "the source is gone",
}
#: Stable error codes.
ERROR_CODES = ("io", "db", "json", "tool_not_found", "tool_failed", "bad_config", "no_space", "other")
# What marks a video as HDR, and codecs that are targets already.
HDR_TRANSFERS = ("smpte2084", "arib-std-b67", "smpte428", "bt2020-10", "bt2020-12")
HDR_TAGS = ("dvh1", "dvhe", "dvav", "dva1", "dav1")
TARGET_CODECS = ("hevc", "h265", "av1")
REMUX_CODECS = ("aac", "aac_latm")


@dataclass(frozen=True)
class ImageSettings:
    enabled: bool = True
    short_edge_cap: int = 1080
    quality: int = 85
    chroma: str = "yuv444"
    speed: int = 7
    animated_crf: int = 32
    keep_metadata: bool = True


@dataclass(frozen=True)
class VideoSettings:
    enabled: bool = True
    short_edge_cap: int = 1080
    fps_cap: int = 30
    crf: int = 24
    preset: str = "medium"
    bit_depth: int = 8
    lane: str = "cpu"
    hw_quality: int = 55
    skip_hdr: bool = True
    vmaf_min: int = 80


@dataclass(frozen=True)
class AudioSettings:
    enabled: bool = True
    bitrate_kbps: int = 128
    copy_if_aac: bool = True


@dataclass(frozen=True)
class OutputSettings:
    skip_no_gain: bool = True
    min_gain_percent: int = 20
    min_file_kb: int = 100
    include_raw: bool = False
    name_template: str = naming.DEFAULT


@dataclass(frozen=True)
class Profile:
    image: ImageSettings = field(default_factory=ImageSettings)
    video: VideoSettings = field(default_factory=VideoSettings)
    audio: AudioSettings = field(default_factory=AudioSettings)
    output: OutputSettings = field(default_factory=OutputSettings)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str | None) -> Profile:
        """Missing parts and fields take their defaults, and so does the whole if it can't be read."""
        try:
            given = json.loads(text or "")
            parts = {}
            for f in dataclasses.fields(cls):
                kind = f.default_factory
                known = {x.name for x in dataclasses.fields(kind)}
                parts[f.name] = kind(**{k: v for k, v in (given.get(f.name) or {}).items() if k in known})
            return cls(**parts)
        except (ValueError, AttributeError, TypeError):
            return cls()

    def sanitized(self) -> tuple[Profile, list[str]]:
        """Settings moved into their ranges, and what was moved."""
        fixes, parts = [], {f.name: getattr(self, f.name) for f in dataclasses.fields(self)}
        for (part, name), (low, high, zero_is_off) in LIMITS.items():
            old = getattr(parts[part], name)
            new = old if zero_is_off and old == 0 else max(low, min(high, old))
            if new != old:
                fixes.append(f"{part}.{name}: {old} -> {new}")
                parts[part] = dataclasses.replace(parts[part], **{name: new})
        if why := naming.problem(parts["output"].name_template):
            fixes.append(f"output.name_template: {parts['output'].name_template} -> {naming.DEFAULT} ({why})")
            parts["output"] = dataclasses.replace(parts["output"], name_template=naming.DEFAULT)
        return Profile(**parts), fixes


#: Least and most of each setting, and whether 0 switches it off.
LIMITS = {
    ("image", "short_edge_cap"): (16, 65535, True),
    ("video", "short_edge_cap"): (16, 16384, True),
    ("video", "fps_cap"): (1, 480, True),
    ("audio", "bitrate_kbps"): (32, 320, False),
    ("output", "min_file_kb"): (0, 1024 * 1024, False),
    ("image", "quality"): (1, 100, False),
    ("image", "speed"): (0, 10, False),
    ("image", "animated_crf"): (1, 63, False),
    ("video", "crf"): (1, 51, False),
    ("video", "hw_quality"): (1, 100, False),
    ("video", "vmaf_min"): (0, 100, False),
    ("output", "min_gain_percent"): (0, 99, False),
}


def presets() -> dict[str, Profile]:
    """Named settings; fixed values."""
    image, video, audio = ImageSettings, VideoSettings, AudioSettings
    return {
        "space": Profile(image(quality=70), video(crf=26, preset="slow"), audio(bitrate_kbps=96)),
        "balanced": Profile(),
        "quality": Profile(image(quality=95, speed=6), video(crf=22, preset="slow", bit_depth=10), audio(bitrate_kbps=192)),
        "fast": Profile(image(speed=9), video(lane="media_engine")),
    }


def detect_preset(profile: Profile) -> str | None:
    return next((name for name, p in presets().items() if p == profile), None)


def fit_short_edge(width: Column, height: Column, cap: int) -> tuple[Column, Column]:
    """Width and height scaled down so that the shorter is cap, rounded half up in integers; never scaled up."""
    w, h = width.cast("long"), height.cast("long")
    if cap == 0:
        return w, h
    short = F.least(w, h)
    same = (w == 0) | (h == 0) | (short <= cap)

    def side(x: Column) -> Column:
        return F.when(same, x).otherwise(F.greatest(F.lit(1).cast("long"), F.call_function("div", x * cap + F.call_function("div", short, F.lit(2)), short)))

    return side(w), side(h)


def needs_resize(width: Column, height: Column, cap: int) -> Column:
    w, h = fit_short_edge(width, height, cap)
    return (w != width) | (h != height)


def even(x: Column) -> Column:
    return x - F.pmod(x, F.lit(2))


def video_target(width: Column, height: Column, cap: int) -> tuple[Column, Column]:
    w, h = fit_short_edge(width, height, cap)
    return even(w), even(h)


def is_hdr(transfer: Column, primaries: Column, space: Column, tag: Column) -> Column:
    """Any of: an HDR transfer curve, a BT.2020 gamut, a Dolby Vision tag. Nulls say no."""
    signs = (transfer.isin(*HDR_TRANSFERS), primaries.startswith("bt2020"), space.startswith("bt2020"), tag.isin(*HDR_TAGS))
    out = F.lit(False)
    for s in signs:
        out = out | F.coalesce(s, F.lit(False))
    return out


def audio_route(codec: Column, profile: Profile) -> Column:
    remux = F.coalesce(codec.isin(*REMUX_CODECS), F.lit(False)) & F.lit(profile.audio.copy_if_aac)
    return F.when(remux, "remux").otherwise("encode")


def audio_can_shrink(size: Column, duration_us: Column, profile: Profile) -> Column:
    """Whether constant-rate output would be smaller by the wanted gain; an unknown length says yes."""
    secs = duration_us / F.lit(1e6)
    out = F.lit(profile.audio.bitrate_kbps * 1000.0 / 8.0) * secs
    return F.coalesce(F.when(secs > 0, out < size * F.lit(1.0 - profile.output.min_gain_percent / 100.0)), F.lit(True))


def no_gain(src: Column, dst: Column, profile: Profile) -> Column:
    """Whether an output saves less than the wanted share; in decimals, as the product outgrows 64 bits."""
    if not profile.output.skip_no_gain:
        return F.lit(False)
    keep = 100 - min(profile.output.min_gain_percent, 100)
    most = F.floor(src.cast("decimal(30,0)") * F.lit(keep).cast("decimal(4,0)") / F.lit(100).cast("decimal(4,0)"))
    return (src == 0) | (dst.cast("decimal(30,0)") >= most)


def commit_gate(src: Column, dst: Column, gate: bool, profile: Profile) -> Column:
    """What becomes of an output: error if empty, no_gain if not small enough, else written.

    With the gate off, an output only must not be larger, and even that only if gains are asked for at all.
    """
    worse = no_gain(src, dst, profile) if gate else ((dst > src) & F.lit(profile.output.skip_no_gain))
    return F.when(dst == 0, "error").when(worse, "no_gain").otherwise("written")


def decide(p: dict[str, Column], profile: Profile) -> Column:
    """The reason to skip a probed file, null if it is to be processed. The order of the rules is part of the result.

    p has the columns class, ext, size, width, height, codec, codec_tag, fps, duration_us, color_transfer,
    color_primaries and color_space.
    """
    kind, cls = media_kind(p["class"]), p["class"]
    image, video, audio = (kind == k for k in ("image", "video", "audio"))
    on = F.when(image, profile.image.enabled).when(video, profile.video.enabled).otherwise(profile.audio.enabled)
    fast = F.lit(False)
    if profile.video.fps_cap:
        fast = F.coalesce(p["fps"] > profile.video.fps_cap + FPS_SLACK, F.lit(False))
    hdr = is_hdr(p["color_transfer"], p["color_primaries"], p["color_space"], p["codec_tag"]) & F.lit(profile.video.skip_hdr)
    target = F.coalesce(p["codec"].isin(*TARGET_CODECS), F.lit(False))
    remux = audio_route(p["codec"], profile) == "remux"
    in_place = F.coalesce(p["ext"].isin("m4a", "m4b"), F.lit(False))
    shrinks = audio_can_shrink(p["size"], p["duration_us"], profile) if profile.output.skip_no_gain else F.lit(True)
    rules = [
        ((cls == "raw_image") & F.lit(not profile.output.include_raw), "raw_excluded"),
        (~on, "disabled"),
        (p["size"] < profile.output.min_file_kb * 1024, "too_small"),
        (image & (F.greatest(p["width"], p["height"]) > MAX_EDGE), "too_large"),
        ((cls == "modern_image") & ~needs_resize(p["width"], p["height"], profile.image.short_edge_cap), "already_optimal"),
        (video & hdr, "hdr_unsupported"),
        (video & target & ~needs_resize(p["width"], p["height"], profile.video.short_edge_cap) & ~fast, "already_optimal"),
        (audio & remux & in_place, "already_optimal"),
        (audio & ~remux & ~shrinks, "no_gain"),
    ]
    out = F.lit(None).cast("string")
    for condition, reason in reversed(rules):
        out = F.when(condition, reason).otherwise(out)
    return out


def route(transfer: Column, primaries: Column, space: Column, tag: Column, profile: Profile) -> Column:
    """The lane that encodes a video, or the reason to skip it."""
    hdr = is_hdr(transfer, primaries, space, tag) & F.lit(profile.video.skip_hdr)
    return F.when(hdr, "hdr_unsupported").otherwise(profile.video.lane)


def video_filters(width: Column, height: Column, fps: Column, profile: Profile) -> tuple[Column, Column]:
    """(scale, limit_fps): which filters a video needs."""
    w, h = video_target(width, height, profile.video.short_edge_cap)
    limit = F.coalesce(fps > profile.video.fps_cap + FPS_SLACK, F.lit(False)) if profile.video.fps_cap else F.lit(False)
    return (w != width) | (h != height), limit


def quality_windows(seconds: Column) -> Column:
    """Where the three 2 s quality samples of a video start; a video under 12 s is sampled as a whole (null)."""
    starts = F.transform(F.array(F.lit(0.15), F.lit(0.5), F.lit(0.85)), lambda s: F.greatest(F.least(seconds * s, seconds - 2.0), F.lit(0.0)))
    return F.when(seconds >= 12, starts)


def clamp_threshold(threshold: int | None, low: int = 4, high: int = 56, default: int = 16) -> int:
    return default if threshold is None else max(low, min(high, threshold))


def clamped_threshold(threshold: Column, low: int = 4, high: int = 56, default: int = 16) -> Column:
    """clamp_threshold of a column."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(threshold, F.lit(default))))


def power_scale(gate: Column, thermal: Column, low_power: Column) -> Column:
    """Permits of a gate under thermal pressure and low power: halved by each, closed at critical, at least 1 else."""
    factor = F.when(thermal == "critical", 0.0).when(thermal == "serious", 0.5).otherwise(1.0) * F.when(low_power, 0.5).otherwise(1.0)
    return F.when(thermal == "critical", F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(gate * factor)))


#: Scan parallelism of a volume; 0 is unlimited.
VOLUME_PARALLELISM = {"ssd": 0, "hdd": 1, "network": 4, "unknown": 2}


def scan_parallelism(volumes: list[str]) -> int:
    """The least of the volumes', unlimited ones aside; 0 if all are."""
    limits = [n for v in volumes if (n := VOLUME_PARALLELISM.get(v, VOLUME_PARALLELISM["unknown"]))]
    return min(limits, default=0)


def scan_limit(volume: Column) -> Column:
    """scan_parallelism of all volumes of a group: an aggregate."""
    known = F.lit(None).cast("int")
    for name, n in VOLUME_PARALLELISM.items():
        known = F.when(volume == name, n or None).otherwise(known) if name != "unknown" else known
    limit = F.when(volume.isin(*VOLUME_PARALLELISM), known).otherwise(VOLUME_PARALLELISM["unknown"])
    return F.coalesce(F.min(limit), F.lit(0))


def preset_name(profile_json: Column) -> Column:
    """The preset that settings, as JSON, are equal to; null for others."""
    out = F.lit(None).cast("string")
    for name, p in presets().items():
        out = F.when(profile_json == p.to_json(), name).otherwise(out)
    return out
