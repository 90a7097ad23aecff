"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source's mean repetition rate is its target weight times the wanted rows, over its own rows. A document's count is
the Poisson quantile of a uniform number that a hash of seed and doc_id gives; a rate over MAX_STEP is split into equal
rates of as many draws as it takes, whose counts are added (a sum of Poisson counts is one of the summed rate), so there
is no largest rate. Documents are exploded by their counts and shuffled globally by another hash of doc_id and copy.

The sizes of sources are counted once, with partial sums, and written down. Where there are too many sources to
broadcast, documents are joined to their rates by a shuffle, whose hot partitions Spark splits.

Defined results: a null source is a source of its own. A null doc_id hashes as the word null. Rows of one doc_id get one
count. Sources of weight 0 or null, or that the weights don't name, get no rows. Other columns are carried along as they
are; columns of the input named like the new ones (copy, shuffle_key, rate) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.llm._common import materialise, parallelism

#: Sources weigh as their sizes to this power: below 1, small sources are lifted.
TEMPERATURE = 0.7
SEED = "mix-1"
#: The largest rate of one draw: it bounds the table of a draw's distribution to about 1 KB.
MAX_STEP = 32.0
#: Rates of so many sources may be broadcast (about 1 KB each).
BROADCAST_SOURCES = 20_000


def _hashed(*parts) -> Column:
    return F.md5(F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p for p in parts)))


def uniform(*parts) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 hash."""
    return F.conv(F.substring(_hashed(*parts), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_sizes(docs: DataFrame) -> DataFrame:
    """source and n: rows of each source, summed before the shuffle."""
    return docs.groupBy("source").agg(F.count("*").alias("n"))


def temperature_weights(sizes: DataFrame, power: float = TEMPERATURE) -> DataFrame:
    """source and weight: each source's size raised to power."""
    return sizes.select("source", F.pow(F.col("n").cast("double"), F.lit(power)).alias("weight"))


def rates(sizes: DataFrame, weights: DataFrame, rows: int | None = None) -> DataFrame:
    """source, rate, draws and cdf (of a draw): the mean repetition rate for about rows rows in all (by default as many
    as sizes counts)."""
    named = weights.where("weight > 0").groupBy("source").agg(F.sum("weight").cast("decimal(38,12)").alias("weight"))
    both = sizes.join(named.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    # two numbers come to the driver
    all_weight = both.agg(F.sum("weight").cast("double")).first()[0] or 1.0
    wanted = float(rows if rows is not None else sizes.agg(F.sum("n")).first()[0] or 0)
    rate = F.col("weight").cast("double") / F.lit(all_weight) * F.lit(wanted) / F.col("n")
    drawn = both.select("source", rate.alias("rate")).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_STEP)))
    return drawn.withColumn("cdf", poisson_cdf(F.col("rate") / F.col("draws")))


def poisson_cdf(rate: Column) -> Column:
    """Chances of at most 0, 1, 2, ... repetitions, as far as a 52-bit number can tell them from 1."""
    steps = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int"))
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    return F.aggregate(steps, start, step, lambda acc: acc["all"])


def mix(docs: DataFrame, weights: DataFrame | None = None, rows: int | None = None, seed: str = SEED) -> DataFrame:
    """docs with each document repeated by its Poisson count, in a global random order, and copy, shuffle_key and rate.

    Without weights, sources weigh by temperature_weights. Rows are dealt to partitions by shuffle_key and sorted by it
    there, so the files of the output, read in order, are in random order as a whole.
    """
    columns = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key", "rate")]
    # carried columns step aside, whatever their names
    held = {c: f"docs_{i}" for i, c in enumerate(columns)}
    plain = {c.lower(): n for c, n in held.items()}
    docs = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in held.items()))
    doc_id, source = F.col(plain["doc_id"]), F.col(plain["source"])
    sizes = materialise(source_sizes(docs.select(source.alias("source"))), "mix-sizes")
    sources = sizes.count()
    table = rates(sizes, weights if weights is not None else temperature_weights(sizes), rows).withColumnRenamed("source", "rate_source")
    if sources <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    counted = docs.join(table, source.eqNullSafe(F.col("rate_source")))
    u = F.transform(F.sequence(F.lit(1).cast("long"), F.col("draws")), lambda k: F.when(k == 1, uniform(seed, key)).otherwise(uniform(seed, "draw", key, k.cast("string"))))
    times = F.aggregate("u", F.lit(0).cast("long"), lambda n, x: n + F.size(F.filter("cdf", lambda c: c <= x)))
    repeated = counted.withColumn("u", u).withColumn("times", times.cast("int")).where("times > 0").drop("cdf", "u", "draws", "rate_source")
    copies = repeated.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")
    order = F.conv(F.substring(_hashed(seed, F.lit("order"), key, F.col("copy").cast("string")), 1, 15), 16, 10).cast("long")
    keyed = copies.withColumn("shuffle_key", order)
    n = parallelism(docs.sparkSession)
    return keyed.repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key").select(*(F.col(n).alias(c) for c, n in held.items()), "copy", "shuffle_key", "rate")


#: DuckDB: the rows that op5 returns.
ORACLE = f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) n FROM documents GROUP BY source),
w AS (SELECT source, n, CAST(pow(CAST(n AS DOUBLE), {TEMPERATURE}) AS DECIMAL(38,12)) weight FROM sizes),
t AS (SELECT CAST(sum(weight) AS DOUBLE) all_weight, CAST(sum(n) AS DOUBLE) all_rows FROM w),
r AS (SELECT source, CAST(weight AS DOUBLE) / all_weight * all_rows / n AS rate FROM w, t),
s AS (SELECT *, rate / draws AS step FROM (SELECT *, greatest(1, CAST(ceil(rate / {MAX_STEP}) AS BIGINT)) AS draws FROM r)),
cdf AS (
  SELECT source, step, 0 AS k, exp(-step) AS p, exp(-step) AS c FROM s
  UNION ALL
  SELECT source, step, k + 1, p * step / (k + 1), c + p * step / (k + 1) FROM cdf WHERE k < ceil(step + 12 * sqrt(step) + 30)
),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, d.*, s.rate, s.draws, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key FROM documents d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
q AS (
  SELECT *, CAST('0x' || substr(md5('{SEED}:' || CASE WHEN draw > 1 THEN 'draw:' || key || ':' || draw ELSE key END), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM (SELECT *, unnest(range(1, draws + 1)) AS draw FROM d)
),
drawn AS (
  SELECT *, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM q.source AND cdf.c <= q.u) AS part FROM q
),
counts AS (SELECT rid, CAST(sum(part) AS BIGINT) AS times FROM drawn GROUP BY rid),
counted AS (SELECT doc_id, text, lang, source, n_chars, rate, times FROM d JOIN counts USING (rid)),
e AS (SELECT * EXCLUDE (times), CAST(unnest(range(1, times + 1)) AS INTEGER) AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, copy,
  CAST('0x' || substr(md5('{SEED}:order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy), 1, 15) AS BIGINT) AS shuffle_key,
  round(rate, 9) AS rate
FROM e
"""
