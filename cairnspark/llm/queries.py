"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm import bitplane_negatives, chat_grammar, filter_shapley, poisson_mix, warc_chunks


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnspark.llm.telephony import media_digests, write_media

    return media_digests(write_media(_read(spark, sf_dir, "documents"), packed=True))


def op2_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnspark.llm.warc_chunks import archive_round_trip

    return archive_round_trip(_read(spark, sf_dir, "pages"))


def op3_chat_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnspark.llm.chat_grammar import format_chats, read_back, with_hard_case

    return read_back(format_chats(with_hard_case(spark, _read(spark, sf_dir, "conversations"))))


def op4_langmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnspark.llm.langmask import identify, train, with_fold

    docs = _read(spark, sf_dir, "documents")
    return identify(with_fold(docs), train(docs), carry=["held_out"])


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnspark.llm.poisson_mix import mix

    return mix(_read(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 9))


def op6_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnspark.llm.repair_ids import shard_digests

    return shard_digests(_read(spark, sf_dir, "documents"))


def op9_bpe_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnspark.llm.bpe_batch import round_trip

    return round_trip(_read(spark, sf_dir, "documents"))


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnspark.llm.token_rollup import corpus_token_rollup

    return corpus_token_rollup(_read(spark, sf_dir, "documents"))


def op7_jaccard_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnspark.llm.jaccard_product import jaccard_classes

    return jaccard_classes(_read(spark, sf_dir, "documents"))


def op8_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnspark.llm.quality_gbt import judge, train

    docs = _read(spark, sf_dir, "documents")
    return judge(docs, train(spark, docs, _read(spark, sf_dir, "labels")))


def op11_filter_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_shapley.audit(filter_shapley.mask_counts(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")))


def op12_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnspark.llm.golay_simhash import simhash_classes

    return simhash_classes(_read(spark, sf_dir, "documents"))


def op13_bitplane_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane_negatives.hard_negatives(_read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_telephony, op2_warc_chunks, op3_chat_grammar, op4_langmask, op5_poisson_mix, op6_repair_ids, op7_jaccard_product, op8_quality_gbt, op9_bpe_batch, op10_token_rollup, op11_filter_shapley, op12_golay_simhash, op13_bitplane_negatives)}
ORACLE: dict[str, str] = {"op2_warc_chunks": warc_chunks.ORACLE, "op3_chat_grammar": chat_grammar.ORACLE, "op5_poisson_mix": poisson_mix.ORACLE, "op11_filter_shapley": filter_shapley.ORACLE, "op13_bitplane_negatives": bitplane_negatives.ORACLE}
