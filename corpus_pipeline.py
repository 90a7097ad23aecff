"""A training corpus in five stages: quality rules, language ID, near duplicates, source mixing, BPE.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and works on all rows of it. Every
stage's result is written to the shared folder and read again as the next one's docs. All stages but the last return
the columns that docs has.

Defined results: a null or empty text, and one without letters, goes with the quality rules or the language. A null lang
only keeps a row out of the training of languages, and a null source is a source of its own. Rows that repeat a doc_id are
judged each by itself; of rows with equal or similar texts one stays, with the smallest doc_id (a null one only where there
is no other), whatever their sources; the copies of all rows of one doc_id are drawn alike. Without labels of both classes
the base rules alone decide, and without labelled languages no document is kept. An empty table gives an empty result.
Further columns, whatever their names, are carried along to the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm import bpe_batch, jaccard_product, langmask, poisson_mix, quality_gbt
from cairnspark.llm._common import materialise

#: Texts go whose language has less than this share of their n-grams; clean texts have over half.
MIN_KNOWN = 0.2


def _aside(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text")):
    """docs with all columns but those to keep renamed out of the way, and the expressions that name them back."""
    names = {c: c if c in keep else f"docs_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held, names = _aside(docs)
    judged = quality_gbt.judge(held, quality_gbt.train(spark, docs, labels), carry=held.columns)
    return judged.where("kept").select(*names)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: those without letters, and those whose n-grams no language knows."""
    held, names = _aside(docs)
    found = langmask.identify(held, langmask.train(docs), carry=held.columns)
    return found.where(f"lang_pred <> 'und' AND known >= {MIN_KNOWN}").select(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: that with the smallest doc_id."""
    return jaccard_product.keep_first(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated by their sources' target rates, and shuffled globally."""
    held, names = _aside(docs, ("doc_id", "source"))
    return poisson_mix.mix(held).select(*names)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text that they decode to, a row for each copy."""
    return bpe_batch.round_trip(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mixing", mixing), ("tokens", tokens)]
#: SQL can express neither the trained stages nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
