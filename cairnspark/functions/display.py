"""Numbers as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
NOTHING = "—"


def one_place(x: Column) -> Column:
    """A number from 0 to 2^53 with one decimal place as C prints it: its exact value is rounded, and a tie goes to the even digit.

    format_string rounds the shortest digits of a double half up, so that 203.45, which is a little less, becomes 203.5.
    """
    whole = F.floor(x)
    rest = x - whole
    k = F.floor(rest * 10)
    over = (rest * 16.0 - (k * 2 + 1)) + rest * 4.0  # 20 * rest - (2 * k + 1): no step of it is rounded
    n = whole * 10 + k
    n = n + F.when((over > 0) | ((over == 0) & (n % 2 == 1)), 1).otherwise(0)
    return F.concat(F.call_function("div", n, F.lit(10)).cast("string"), F.lit("."), (n % 10).cast("string"))


def bytes_text(size: Column) -> Column:
    """Thousands as units, one decimal place from KB on."""
    out = F.format_string("%d B", size.cast("long"))
    for k in range(1, len(UNITS)):
        scaled = size.cast("double")
        for _ in range(k):
            scaled = scaled / 1000.0
        out = F.when(scaled >= 1.0, F.concat(one_place(scaled), F.lit(f" {UNITS[k]}"))).otherwise(out)
    return out


def rounded_bytes_text(size: Column, digits: int = 1) -> Column:
    """As bytes_text, but without decimals from 100 of a unit on, up to TB, and a dash for what is no size."""
    out = F.format_string("%d B", size.cast("long"))
    for k in range(1, len(UNITS) - 1):
        scaled = size.cast("double")
        for _ in range(k):
            scaled = scaled / 1000.0
        text = F.when(scaled >= 100.0, F.format_string(f"%.0f {UNITS[k]}", scaled)).otherwise(F.format_string(f"%.{digits}f {UNITS[k]}", scaled))
        out = F.when(scaled >= 1.0, text).otherwise(out)
    return F.when(size >= 0, out).otherwise(NOTHING)


#: What an estimated time is called, long and short: under a minute, minutes, hours, hours and minutes.
ETA_LONG = ("不到 1 分钟", "约 %d 分钟", "约 %d 小时", "约 %d 小时 %d 分")
ETA_SHORT = ("<1 分", "%d 分", "%d 时", "%d 时 %d 分")


def eta_text(seconds: Column, words: tuple[str, str, str, str] = ETA_LONG) -> Column:
    """An estimated time in whole minutes; estimates are too vague for seconds."""
    under, minutes, hours, both = words
    m = F.floor(seconds / 60 + 0.5).cast("long")
    h, rest = F.call_function("div", m, F.lit(60)), m % 60
    long = F.when(rest == 0, F.format_string(hours, h)).otherwise(F.format_string(both, h, rest))
    text = F.when(seconds < 60, under).when(m < 60, F.format_string(minutes, m)).otherwise(long)
    return F.when((seconds >= 0) & (seconds < 1e12), text).otherwise(NOTHING)


def saving_text(src: Column, dst: Column) -> Column:
    return F.when(src <= 0, NOTHING).otherwise(F.concat(F.floor((1 - dst / src) * 100 + 0.5).cast("long").cast("string"), F.lit("%")))


def duration_text(seconds: Column) -> Column:
    s, m, h = (F.floor(x).cast("int") for x in (F.pmod(seconds, F.lit(60.0)), F.pmod(seconds / 60, F.lit(60.0)), seconds / 3600))
    short, long = F.format_string("%d:%02d", m, s), F.format_string("%d:%02d:%02d", h, m, s)
    return F.when((seconds >= 0) & (seconds < 1e12), F.when(h > 0, long).otherwise(short)).otherwise(NOTHING)


def bitrate_text(bps: Column) -> Column:
    mega, kilo = bps / 1e6, F.floor(bps / 1e3 + 0.5).cast("long")
    return F.when(bps.isNull() | (bps <= 0), NOTHING).when(bps >= 10_000_000, F.concat(F.rint(mega).cast("long").cast("string"), F.lit(" Mbps"))).when(bps >= 1_000_000, F.concat(one_place(mega), F.lit(" Mbps"))).otherwise(F.format_string("%d kbps", kilo))


#: Codecs that aren't just written in capitals.
CODEC_NAMES = {"h264": "H.264", "hevc": "HEVC", "mpeg4": "MPEG-4", "prores": "ProRes"}


def pretty_codec(codec: Column) -> Column:
    """The name of a codec as people write it."""
    named = F.create_map(*(F.lit(x) for pair in CODEC_NAMES.items() for x in pair))
    return F.coalesce(named[codec], F.upper(codec))


def pretty_type(uti: Column) -> Column:
    """The format that a uniform type identifier ends in, in capitals; null where it ends in nothing."""
    last = F.trim(F.element_at(F.split(uti, r"\."), -1))
    return F.when(last != "", F.upper(last))


def share_text(part: Column, whole: Column) -> Column:
    """Percent with one decimal place, none if it is 0; what is over 0 but under 0.1 is said to be so."""
    pct = part / whole * 100
    tenth = F.floor(pct * 10 + 0.5)
    text = F.when(tenth % 10 == 0, F.format_string("%d%%", F.floor(tenth / 10).cast("long"))).otherwise(F.format_string("%.1f%%", tenth / 10))
    return F.when(whole <= 0, NOTHING).when((pct > 0) & (pct < 0.1), "<0.1%").otherwise(text)


def count_text(n: Column) -> Column:
    return F.format_number(F.floor(n + 0.5), 0)
