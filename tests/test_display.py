"""Numbers as people read them, at the values where roundings differ."""

import random

from pyspark.sql import functions as F

from cairnspark.functions import display


def test_one_place_is_that_of_c(spark):
    rng = random.Random(5)
    sizes = [1250, 1350, 203_450_000, 320_250, 1_150, 8_950_000, 999_949, 999_950, 999_951, 1_000, 2_768_500_000, *(rng.randrange(20, 20_000) * 50 * 1000 ** rng.randrange(3) for _ in range(3000))]

    def text(n: int) -> str:
        x, unit = float(n), 0
        while x / 1000 >= 1:
            x, unit = x / 1000, unit + 1
        return f"{x:.1f} {display.UNITS[unit]}" if unit else f"{n} B"

    def rate(n: int) -> str:
        return f"{n / 1e6:.0f} Mbps" if n >= 10_000_000 else f"{n / 1e6:.1f} Mbps" if n >= 1_000_000 else f"{int(n / 1e3 + 0.5)} kbps"

    rows = spark.createDataFrame([(n,) for n in sizes], "n bigint").select("n", display.bytes_text(F.col("n")).alias("size"), display.bitrate_text(F.col("n").cast("double")).alias("rate")).collect()
    assert [(r.size, r.rate) for r in rows] == [(text(n), rate(n)) for n in sizes]
