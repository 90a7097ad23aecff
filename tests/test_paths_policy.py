"""Column functions against literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from cairnspark.functions import bits, display, naming, paths, probe
from cairnspark.functions import estimate as est
from cairnspark.functions import policy as pol


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def many(spark, f, values, ddl="x string"):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, " + ddl)
    cols = [F.col(c) for c in rows.columns[1:]]
    return [r[0] for r in rows.select(f(*cols).alias("r"), "i").orderBy("i").select("r").collect()]


def test_names(spark):
    p = ["/a/b.JPG", "/a/.xmp", "/a/b", "/a/b.tar.gz", "/a/b.", "a.heic", "/a/x.cr2", "/v/m.MOV", "/v/s.flac", "/v/s.pdf", None]
    assert many(spark, paths.classify, p) == ["image", None, None, None, None, "modern_image", "raw_image", "video", "audio", None, None]
    assert many(spark, paths.extension, p[:5]) == ["JPG", "", "", "gz", ""]
    assert many(spark, paths.stem, p[:5]) == ["b", ".xmp", "b", "b.tar", "b"]
    assert many(spark, paths.classify, ["/v/a\nb.jpg", "/v/a\n.jpg\n"]) == ["image", None] and many(spark, paths.stem, ["/v/a\nb.jpg"]) == ["a\nb"]
    assert many(spark, paths.parent, ["/a/b", "/a", "a"]) == ["/a", "/", "a"]
    assert many(spark, paths.is_junk, ["._x.jpg", ".DS_Store", "Thumbs.db", "a.XMP", ".xmp", "a.jpg", "Icon\r"]) == [True, True, True, True, True, False, True]
    assert many(spark, paths.is_skipped_dir, ["$RECYCLE.BIN", "My.photoslibrary", "x.app", "photos"]) == [True, True, True, False]
    assert many(spark, paths.is_temp_file, [".a.zz-1.tmp", "a.zz-1.tmp", ".a.tmp"]) == [True, False, False]
    assert many(spark, paths.depth, ["/", "/a", "/a/b/c", "a/b"]) == [1, 2, 4, 2]
    assert many(spark, paths.root_label, ["/a/b/", "/a", "/"]) == ["b", "a", "/"]
    assert many(spark, paths.is_under, [("/a/b", "/a"), ("/ab", "/a"), ("/a", "/a"), ("/x", "/")], "x string, y string") == [True, False, True, True]


def test_paths_sort_by_components(spark):
    rows = spark.createDataFrame([("/a-b",), ("/a/b",)], "p string")
    assert [r.p for r in rows.orderBy(paths.path_key(F.col("p"))).collect()] == ["/a/b", "/a-b"]


@pytest.mark.parametrize("cap", [0, 1, 7, 720, 1080])
def test_short_edge(spark, cap):
    r = random.Random(cap)
    edges = [0, 1, 2, cap - 1, cap, cap + 1, 2 * cap, 65_535]
    sizes = [(abs(r.choice(edges)), abs(r.choice(edges + [r.randint(0, 9000)]))) for _ in range(150)]

    def model(w, h):
        short = min(w, h)
        if cap == 0 or short <= cap:
            return w, h
        return tuple(max(1, round_half_up(x * cap, short)) for x in (w, h))

    def round_half_up(a, b):
        return (2 * a + b) // (2 * b) if b % 2 == 0 else (a + b // 2) // b

    both = [many(spark, lambda w, h, k=k: pol.fit_short_edge(w, h, cap)[k], sizes, "w bigint, h bigint") for k in (0, 1)]
    assert list(zip(*both, strict=True)) == [model(w, h) for w, h in sizes]


def test_gain_gate(spark):
    p = pol.Profile()
    cases = [(1000, 799), (1000, 800), (1000, 949), (1000, 999), (1000, 2130), (0, 0), (2**62, 2**62)]
    assert many(spark, lambda s, d: pol.no_gain(s, d, p), cases, "s bigint, d bigint") == [False, True, True, True, True, True, True]
    off = pol.Profile(output=pol.OutputSettings(skip_no_gain=False))
    assert many(spark, lambda s, d: pol.no_gain(s, d, off), cases[:4], "s bigint, d bigint") == [False] * 4
    none = pol.Profile(output=pol.OutputSettings(min_gain_percent=0))
    assert many(spark, lambda s, d: pol.no_gain(s, d, none), [(1000, 999), (1000, 1000), (1000, 1001)], "s bigint, d bigint") == [False, True, True]
    assert many(spark, lambda s, d: pol.commit_gate(s, d, False, p), [(10, 0), (10, 11), (10, 10)], "s bigint, d bigint") == ["error", "no_gain", "written"]


PROBE = {"class": "string", "ext": "string", "size": "bigint", "width": "int", "height": "int", "codec": "string", "codec_tag": "string", "fps": "double", "duration_us": "bigint", "color_transfer": "string", "color_primaries": "string", "color_space": "string"}


def test_rules_go_in_order(spark):
    big = 4 << 20

    def row(cls, **k):
        base = {"class": cls, "ext": "jpg", "size": big, "width": 4032, "height": 3024}
        return tuple((base | k).get(c) for c in PROBE)

    rows = [
        (row("raw_image", size=1), "raw_excluded"), (row("image", size=10), "too_small"), (row("image", width=70000), "too_large"), (row("modern_image", width=800, height=600), "already_optimal"), (row("modern_image"), None),
        (row("video", codec="hevc", width=1280, height=720, fps=30.0), "already_optimal"), (row("video", codec="hevc", width=1280, height=720, fps=60.0), None), (row("video", codec="h264", color_space="bt2020nc"), "hdr_unsupported"), (row("video", codec_tag="dvhe"), "hdr_unsupported"),
        (row("audio", codec="aac", ext="m4a"), "already_optimal"), (row("audio", codec="aac", ext="aac"), None), (row("audio", codec="mp3", ext="mp3", size=200_000, duration_us=60_000_000), "no_gain"), (row("audio", codec="mp3", ext="mp3"), None),
    ]
    df = spark.createDataFrame([(i, *r) for i, (r, _) in enumerate(rows)], "i int, " + ", ".join(f"`{c}` {t}" for c, t in PROBE.items()))
    got = [r.r for r in df.select("i", pol.decide({c: F.col(c) for c in PROBE}, pol.Profile()).alias("r")).orderBy("i").collect()]
    assert got == [want for _, want in rows]
    off = pol.Profile(image=pol.ImageSettings(enabled=False))
    assert df.where("i < 2").select(pol.decide({c: F.col(c) for c in PROBE}, off).alias("r")).distinct().count() == 2  # RAW goes before disabled


def test_settings():
    p, fixes = pol.Profile(image=pol.ImageSettings(quality=0, short_edge_cap=3), output=pol.OutputSettings(name_template="x")).sanitized()
    assert p.image.quality == 1 and p.image.short_edge_cap == 16 and p.output.name_template == naming.DEFAULT and len(fixes) == 3
    assert pol.Profile.from_json(p.to_json()) == p
    assert pol.Profile.from_json('{"image": {"quality": 90, "new": 1}}') == pol.Profile(image=pol.ImageSettings(quality=90))
    assert pol.Profile.from_json("{") == pol.Profile.from_json(None) == pol.Profile()
    assert pol.Profile().sanitized() == (pol.Profile(), [])
    assert {n: pol.detect_preset(x) for n, x in pol.presets().items()} == {n: n for n in pol.presets()}
    assert pol.clamp_threshold(None) == 16 and pol.clamp_threshold(1) == 4 and pol.clamp_threshold(99) == 56
    assert pol.scan_parallelism(["ssd", "hdd"]) == 1 and pol.scan_parallelism(["ssd"]) == 0 and pol.scan_parallelism([]) == 0


def test_templates(spark):
    assert [naming.problem(t) is None for t in ("{name}.{ext}", "{name}_{srcext}.{ext}", "", "a/{name}.{ext}", "{nam}.{ext}", "x.{ext}", "{name}", "{name}{.{ext}", "{name}}.{ext}")] == [True, True] + [False] * 7
    r = lambda t: lambda p: naming.render(t, p, F.lit("avif"))
    stems, exts = ["tide", "so.many.dots", "{name}", "ü 1", "x" * 300, "ñ" * 140, "日" * 90], ["", "gif", "TIFF"]
    paths_ = [f"/k/{s}{'.' * bool(e)}{e}" for s in stems for e in exts]

    def model(stem, ext, tail):
        room = 255 - len(".avif")
        return (stem + tail.replace("{srcext}", ext)).encode()[:room].decode(errors="ignore") + ".avif"

    for template, tail in ((naming.DEFAULT, ""), ("{name}~{srcext}.{ext}", "~{srcext}")):
        # what follows the last dot of so.many.dots is its extension where it has no other
        split = [("so.many", "dots") if (s, e) == ("so.many.dots", "") else (s, e) for s in stems for e in exts]
        assert many(spark, r(template), paths_) == [model(s, e, tail) for s, e in split]


def test_probe_fields(spark):
    assert many(spark, probe.rate, ["30000/1001", "0/0", "25/1", "x", "-1/2", None]) == [pytest.approx(29.97003), None, 25.0, None, None, None]
    assert many(spark, probe.known, [" h264 ", "unknown", "\tN/A\n", "", None, "\u3000x y\u00a0"]) == ["h264", None, None, None, None, "x y"]
    ends = lambda s, c: one(spark, probe.duration_us(F.struct(F.lit(s).alias("duration")), F.lit(c)))
    assert [ends("0", "3"), ends("-1", "3"), ends("NaN", "3"), ends("Infinity", "3"), ends("2", "3"), ends("x", "0")] == [3_000_000] * 4 + [2_000_000, None]
    text = '{"streams": [{"codec_type": "video", "codec_name": "png", "width": 5, "height": 5, "disposition": {"attached_pic": 1}}, {"codec_type": "video", "codec_name": "hevc", "width": 1920, "height": 1080, "avg_frame_rate": "60/1", "duration": "2.5", "color_transfer": "arib-std-b67"}, {"codec_type": "subtitle", "codec_name": "ass"}], "format": {"duration": "9"}}'
    p = {k: one(spark, c) for k, c in probe.probed(F.lit(text), F.lit("video")).items()}
    assert (p["width"], p["codec"], p["fps"], p["duration_us"], p["color_transfer"]) == (1920, "hevc", 60.0, 2_500_000, "arib-std-b67")
    bad = {k: one(spark, c) for k, c in probe.probed(F.lit("{oops"), F.lit("video")).items()}
    assert (bad["width"], bad["codec"], bad["duration_us"]) == (0, None, None)
    assert one(spark, probe.video_source(F.lit(text))["container"]) == "mkv" and one(spark, probe.audio_source(F.lit(text))["cover_index"]) is None
    assert one(spark, probe.progress(F.array(F.lit("a=1"), F.lit("x"), F.lit("a=2"), F.lit("b=c=d")))) == {"a": "2", "b": "c=d"}


def test_bits(spark):
    lane = lambda *v: [F.lit(x).cast("long") for x in v]
    assert one(spark, bits.hamming(lane(0), lane(0b1011))) == 3
    assert one(spark, bits.hamming(lane(-1, -1, -1, -1), lane(0, 0, 0, 0))) == 256
    text = one(spark, bits.to_hex(lane(1, -1, 0, 255)))
    assert text == "0" * 15 + "1" + "f" * 16 + "0" * 16 + "0" * 14 + "ff"
    assert [one(spark, c) for c in bits.from_hex(F.lit(text))] == [1, -1, 0, 255]
    assert [one(spark, c) for c in bits.from_hex(F.lit("zz"))] == [None] * 4


def test_display(spark):
    assert many(spark, display.bytes_text, [0, 999, 1000, 1_500_000, 10**15, 10**18], "x bigint") == ["0 B", "999 B", "1.0 KB", "1.5 MB", "1.0 PB", "1000.0 PB"]
    assert many(spark, display.saving_text, [(1000, 130), (0, 1)], "a bigint, b bigint") == ["87%", "—"]
    assert many(spark, display.duration_text, [5025.0, 125.0, -1.0], "x double") == ["1:23:45", "2:05", "—"]
    assert many(spark, display.pretty_codec, ["hevc", "h264", "opus", None]) == ["HEVC", "H.264", "OPUS", None]
    assert many(spark, display.pretty_type, ["public.heic", "jpeg", "public.", None]) == ["HEIC", "JPEG", None, None]


def test_estimates(spark):
    assert [round(x, 3) for x in many(spark, est.quality_factor, [10.0, 70.0, 77.5, 85.0, 90.0, 95.0, 100.0], "x double")] == [0.62, 0.62, 0.81, 1.0, 1.4, 1.8, 1.8]
    assert one(spark, est.saved(F.lit(100), est.interval(F.lit(10.0), F.lit(50.0), F.lit(120.0)))) == (0.0, 50.0, 90.0)
    assert one(spark, est.wall_seconds(F.lit(121.0), F.lit(0.0))) == pytest.approx(100.0)
    assert one(spark, est.wall_seconds(F.lit(10.0), F.lit(10.0), True, (2, 1))) == 10.0
    assert one(spark, est.calibrated(F.lit(10.0), F.lit(5.0), F.lit(10.0))) == 20.0 and one(spark, est.calibrated(F.lit(10.0), F.lit(4.0), F.lit(10.0))) == 10.0
    assert one(spark, est.bitrate(F.lit(2**60), F.lit(1))) == 2**63 - 1 and one(spark, est.bitrate(F.lit(5), F.lit(0))) is None
    assert one(spark, est.space_is_short(F.lit(100), F.lit(149))) and not one(spark, est.space_is_short(F.lit(None).cast("long"), F.lit(1)))
    assert est.collision_probability(256) == 1 and est.collision_probability(12) < 1e-50
