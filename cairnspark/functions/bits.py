"""Fingerprints of 256 bits as four 64-bit lanes, and hashes of content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANES = 4


def hamming(a: list[Column], b: list[Column]) -> Column:
    out = F.lit(0).cast("long")
    for x, y in zip(a, b, strict=True):
        out = out + F.bit_count(x.bitwiseXOR(y)).cast("long")
    return out


def bit_population(lanes: list[Column]) -> Column:
    return hamming(lanes, [F.lit(0).cast("long")] * len(lanes))


def to_hex(lanes: list[Column]) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in lanes)))


def from_hex(text: Column) -> list[Column]:
    """Lanes of 64 hex digits; nulls for anything else."""
    ok = text.rlike("^[0-9a-fA-F]{64}$")

    def lane(k: int) -> Column:
        half = [F.conv(F.substring(text, 16 * k + 8 * h + 1, 8), 16, 10).cast("long") for h in (0, 1)]
        return F.when(ok, F.shiftleft(half[0], 32).bitwiseOR(half[1]))

    return [lane(k) for k in range(LANES)]


#: Tags of the hashes in a cache. A new way to hash needs a new tag, else old hashes would be taken for new ones.
FULL_HASH_ALGO, PRINT_ALGO = "sha256", "mean-print-v1"


def mean_print(values: Column, bits: int = 64, offset: float = 0.0) -> Column:
    """A 64-bit print of numbers: bit i is set where number i is over the mean and offset."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    mean = F.try_divide(total, F.size(values)) + offset

    def over(m: Column) -> Column:
        marks = F.transform(values, lambda x, i: F.when(x > m, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(F.slice(marks, 1, bits), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))

    # an array of one, so that the mean is taken once and not again for each number
    return F.get(F.transform(F.array(mean), over), F.lit(0))


def sample_hash(content: Column, size: Column, window: int) -> Column:
    """SHA-256 of the size and the first and last window bytes (the last only if there are more than window).

    Null for content that isn't as long as size says: the file has changed since it was listed.
    """
    body = content.cast("binary")
    tail = F.when(size > window, F.substring(body, -window, window)).otherwise(F.lit(b""))
    return F.when(F.octet_length(body) == size, F.sha2(F.concat(F.lpad(F.hex(size), 16, "0").cast("binary"), F.substring(body, 1, window), tail), 256))


def spread(values: Column) -> Column:
    """The population deviation of the numbers of an array: how much content a picture has."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(values))


def full_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)
