r"""Filter interaction audit: what each of several filters removes in any order, from one polynomial for each part.

Every document gets a mask of the filters it fails; from then on only counts of masks matter. The documents that a set S
of filters removes are the values at the corners of a multilinear polynomial,

    f(x) = sum of n_M * (1 - product over i in M of (1 - x_i)),  M over the masks,

which is kept by its coefficients a_T, one for each set T of filters. Its corners give the survivors of any order. The
Shapley value of filter i is the integral of df/dx_i along the diagonal, the sum of a_T / |T| over the T that hold i; it
is added up in exact rationals and scaled by the number of orders. Copies of the polynomial over the documents of quality
1 and over the toxic ones give the good and the toxic losses.

The filters: A under 100 words; B distinct words under 80 % of words; C letters A to Z over 10 % of code points; D any of
`#$%&*|`; E identical to the text of any smaller doc_id. Words are runs of other characters than the space and \t to \r.

Defined results: a null text is empty, so empty and null texts are identical; a null lang is the part of the empty string.
A document without a doc_id fails E never, makes no other one fail it, and has no labels; rows that repeat a doc_id are
judged each, and equal ones of the smallest doc_id all pass E. Where labels repeat a doc_id, one row of quality 1 (toxic 1)
is enough. A table without rows gives none. Further columns are left out.

Texts are grouped by their SHA-256. Documents meet their text's smallest doc_id by digest and doc_id together, so a text
that a third of all rows share is no hot key. What leaves Spark's functions is a row of at most 32 counts for each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm._common import materialise, small_batches, text_or_empty

FILTERS = "ABCDE"
MEASURES = ("n", "good", "toxic")
_SPACES, _CAPITALS, _MARKS = r"[ \t\n\x0B\f\r]+", r"[^A-Z]+", r"[#$%&*|]"
_AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def removal_polynomial(counts: dict[int, int], n: int) -> list[int]:
    """Coefficients a_T, by T as a bitmask, of the polynomial of mask counts over n filters."""
    holding = [0] * (1 << n)
    for mask, c in counts.items():
        holding[mask] += c
    for i in range(n):  # sums over the masks that hold T
        for t in range(1 << n):
            if not t >> i & 1:
                holding[t] += holding[t | 1 << i]
    return [0] + [h if t.bit_count() % 2 else -h for t, h in enumerate(holding)][1:]


def corner(poly: list[int], applied: int) -> int:
    """The polynomial where x_i is 1 for the filters of applied and 0 for the others: documents they remove together."""
    return sum(a for t, a in enumerate(poly) if t & applied == t)


def diagonal_integral(poly: list[int], i: int) -> Fraction:
    """The integral of the partial derivative by x_i along the diagonal: the Shapley value of filter i."""
    return sum((Fraction(a, t.bit_count()) for t, a in enumerate(poly) if t >> i & 1), Fraction(0))


def failed(docs: DataFrame) -> DataFrame:
    """part, doc_id, mask (A to D as bits 0 to 3) and digest of every document."""
    text = text_or_empty()
    words = F.array_remove(F.split(text, _SPACES), "")
    seen = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    n = F.size("words").cast("long")
    tests = (n < 100, F.size(F.array_distinct("words")) * 100 < n * 80, F.length(F.regexp_replace("text", _CAPITALS, "")) * 100 > F.length("text") * 10, F.col("text").rlike(_MARKS))
    mask = sum((t.cast("int") * (1 << i) for i, t in enumerate(tests)), F.lit(0))
    return seen.select("part", "doc_id", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (A to E) and how many documents have it: n, good (quality 1) and toxic."""
    rows = materialise(failed(docs), "shapley-masks")
    lowest = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    marked = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max(F.col(c).eqNullSafe(1)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))
    # written down, so that the joins are of plain shuffles, whose hot partitions Spark can split
    lowest = materialise(lowest.withColumn("first", F.lit(True)), "shapley-firsts")
    marked = materialise(marked.where("good OR toxic"), "shapley-marked")
    known = rows.join(lowest, ["digest", "doc_id"], "left").join(marked, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    sums = (F.count("*"), *(F.count_if(F.coalesce(c, F.lit(False))) for c in MEASURES[1:]))
    return known.groupBy("part", (F.col("mask") + copy.cast("int") * 16).alias("mask")).agg(*(s.alias(m) for s, m in zip(sums, MEASURES, strict=True)))


def _orders(filters: str):
    """Counts of masks of each part to a row for each order of the filters and step."""
    n, orders = len(filters), factorial(len(filters))

    def rows(part: str, counts: list[dict]) -> Iterator[tuple]:
        all_docs = sum(c["n"] for c in counts)
        polys = {m: removal_polynomial({c["mask"]: c[m] for c in counts}, n) for m in MEASURES}
        at = {m: [corner(p, s) for s in range(1 << n)] for m, p in polys.items()}
        value = [diagonal_integral(polys["n"], i) * orders for i in range(n)]
        assert all(v.denominator == 1 for v in value)
        for order in permutations(range(n)):
            before = 0
            for step, i in enumerate(order, 1):
                after = before | 1 << i
                removed, good, toxic = (at[m][after] - at[m][before] for m in MEASURES)
                alone = at["n"][-1] - at["n"][-1 - (1 << i)]
                yield part, "".join(filters[k] for k in order), step, all_docs - at["n"][after], removed, at["n"][1 << i] - removed, alone, good, toxic, int(value[i])
                before = after

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
        names = [c.split()[0] for c in _AUDIT.split(", ")]
        for batch in batches:
            for r in batch.to_pylist():
                out = zip(*rows(r["part"], r["counts"]), strict=True)
                yield pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    return run


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from counts: part, mask, n, good and toxic.

    kept after this step, removed at it, redundant (failing, but removed before), unique_fails (failing this filter only),
    good_lost and toxic_lost at it, and shapley: what the filter removes summed over all orders. Parts hold at most
    2 ** len(filters) counts each, so a part is a small row.
    """
    small_batches(counts.sparkSession)
    rows = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("counts"))
    return rows.mapInArrow(_orders(filters), _AUDIT)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS lowest FROM d),
flagged AS (
  SELECT w.doc_id, part, coalesce(quality, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > lowest, false)] AS fails
  FROM w LEFT JOIN labels USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
kinds AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flagged GROUP BY ALL),
places AS (
  SELECT part, fails, n, good, toxic, filter_order, [list_extract(fails, ascii(substr(filter_order, k, 1)) - 64) FOR k IN [1, 2, 3, 4, 5]] AS seq
  FROM kinds, orders),
steps AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS step, list_position(seq, true) AS hit FROM places),
told AS (
  SELECT part, filter_order, step, sum(CASE WHEN hit IS NULL OR hit = 0 OR hit > step THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN hit = step THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit < step AND hit > 0 AND seq[step] THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN seq[step] AND len(list_filter(seq, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, CAST(step AS INTEGER), 1)) AS BIGINT) AS shapley
FROM told"""
