"""Tables whose doc_ids are null or repeat: no key is a task of its own, and no rows meet all others."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cairnspark.llm import jaccard_product, quality_gbt, repair_ids
from cairnspark.llm._common import materialise
from tests.llm.conftest import WORDS

N = 20_000


def _texts(spark):
    """N texts of 60 words, in pairs of near copies."""
    r = random.Random(9)
    rows = []
    for k in range(N // 2):
        words = [r.choice(WORDS) + str(r.randrange(1000)) for _ in range(60)]
        rows.append((2 * k, " ".join(words)))
        words[r.randrange(60)] = "changed"
        rows.append((2 * k + 1, " ".join(words)))
    return materialise(spark.createDataFrame(rows, "k bigint, text string").repartition(4), "test-texts")


@pytest.fixture(scope="module")
def texts(spark):
    return _texts(spark)


@pytest.mark.parametrize("one", [None, 7])
def test_pairs_are_found_whatever_their_ids(spark, texts, one):
    took = []
    for ids in (F.col("k"), F.lit(one).cast("bigint")):
        t = time.time()
        rows = jaccard_product.jaccard_classes(texts.select(ids.alias("doc_id"), "text"), keys=True).select("root", "n_links").collect()
        took.append(time.time() - t)
        assert len(rows) == N and {r.n_links for r in rows} == {1} and len({r.root for r in rows}) == N // 2
    assert took[1] < 2 * took[0] + 10


def test_shards_of_one_id_are_many_and_in_order(spark, texts):
    docs = texts.select(F.lit(5).cast("bigint").alias("doc_id"), "text")
    manifest = repair_ids.write_shards(docs)
    parts = [r.n_docs for r in manifest.groupBy("part").agg(F.sum("n_docs").alias("n_docs")).collect()]
    assert sum(parts) == N and max(parts) < N // 2
    starts = sorted((r.start, r.n_tokens) for r in repair_ids.read_shards(manifest).select("start", "n_tokens").collect())
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_training_takes_a_repeated_id_once(spark, texts):
    docs = texts.select(F.when(F.col("k") < 100, F.col("k")).otherwise(3).alias("doc_id"), "text")
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id bigint, quality int")
    least = docs.where("doc_id = 3").count()
    assert least > N // 2
    one = quality_gbt.train(spark, docs.where("doc_id <> 3").unionByName(docs.where("doc_id = 3").limit(1)), labels)
    assert len(quality_gbt.train(spark, docs, labels).roots) == len(one.roots)
