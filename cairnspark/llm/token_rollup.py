"""Token counts: delta-maintained rollups.

Every change is a signed row: an insert adds one document and its tokens, a delete takes them away, a revised count
takes the old tokens away and adds the new. A batch of changes is summed by source, language and tokenizer version and
committed once under its id: the summed rows are written aside and renamed into place, and a rename onto a committed
batch fails. So a batch that is replayed, or sent by two drivers, counts once. Totals are sums over committed batches;
compact() folds those so far into a snapshot, which is committed by a rename as well, so that totals stay cheap.

Defined results: null source, lang or tokenizer are groups of their own; null counts count 0. A null or empty text has
0 tokens. A repeated row counts again. Groups whose documents and tokens are all 0 are left out of the totals.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm._common import small_batches, materialise, scratch, text_or_empty
from cairnspark.llm.pieces import default_path, library_encoder

KEYS = ("source", "lang", "tokenizer")
_DDL = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, lang, text_md5 and n_tokens of every whole text."""
    path = path or default_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = library_encoder(path)
        for batch in batches:
            _, offsets = enc.encode(batch.column(5).to_pylist())
            yield pa.record_batch([*batch.columns[:5], pa.array(np.diff(offsets))], names=["doc_id", "source", "lang", "text_md5", "n_bytes", "n_tokens"])

    text = text_or_empty()
    rows = docs.select("doc_id", "source", "lang", F.md5(text).alias("text_md5"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, source string, lang string, text_md5 string, n_bytes bigint, n_tokens bigint")


def signed(rows: DataFrame, tokenizer: str, docs: int, tokens) -> DataFrame:
    """Change rows: docs (1, -1 or 0) and a signed token column for each of rows."""
    return rows.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.lit(tokenizer).alias("tokenizer"), F.lit(docs).cast("long").alias("docs"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))


def inserts(rows: DataFrame, tokenizer: str, tokens: str = "n_tokens") -> DataFrame:
    return signed(rows, tokenizer, 1, F.col(tokens))


def deletes(rows: DataFrame, tokenizer: str, tokens: str = "n_tokens") -> DataFrame:
    return signed(rows, tokenizer, -1, -F.col(tokens))


def revisions(rows: DataFrame, tokenizer: str, old: str, new: str) -> DataFrame:
    return signed(rows, tokenizer, 0, F.coalesce(F.col(new), F.lit(0)) - F.coalesce(F.col(old), F.lit(0)))


class Rollup:
    """Committed batches below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(at)

    def _fs(self, at: str):
        return self._path(at).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _move(self, source: str, target: str) -> bool:
        """Rename, unless the target is there: False then."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        context.mkdir(self._path(target.rpartition("/")[0]), jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault(), True)
        try:
            context.rename(self._path(source), self._path(target), gateway.new_array(rename, 0))
        except Exception:
            if self._fs(target).exists(self._path(target)):
                return False
            raise
        return True

    def _names(self, at: str) -> list[str]:
        fs = self._fs(at)
        return sorted(s.getPath().getName() for s in fs.listStatus(self._path(at))) if fs.exists(self._path(at)) else []

    def committed(self) -> list[str]:
        """Ids of all batches ever committed."""
        return [n[6:] for n in self._names(f"{self.folder}/batches")]

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """(folder of the latest snapshot, ids of the batches that it has folded in)."""
        if not (names := self._names(f"{self.folder}/snapshots")):
            return None, set()
        at = f"{self.folder}/snapshots/{names[-1]}"
        return at, {r[0] for r in self.spark.read.schema("batch string").parquet(f"{at}/folded").toLocalIterator()}

    def compact(self) -> bool:
        """Fold all committed batches into a new snapshot; False if there was nothing new, or another driver was first.

        Batches committed meanwhile aren't in it, and are read beside it. Their folders stay, so that a replay of an old
        batch is still known.
        """
        at, folded = self._snapshot()
        new = [b for b in self.committed() if b not in folded]
        if not new:
            return False
        aside = f"{self.folder}/aside/{scratch(self.spark, 'snapshot').rpartition('/')[2]}"
        self._rows(at, new).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{aside}/totals")
        self.spark.createDataFrame([(b,) for b in sorted(folded | set(new))], "batch string").write.parquet(f"{aside}/folded")
        number = int(at.rpartition("-")[2]) + 1 if at else 1
        return self._move(aside, f"{self.folder}/snapshots/snapshot-{number:09d}")

    def _rows(self, snapshot: str | None, batches: list[str]) -> DataFrame:
        at = ([f"{snapshot}/totals"] if snapshot else []) + [f"{self.folder}/batches/batch-{b}" for b in batches]
        return self.spark.read.schema(_DDL).parquet(*at)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of change rows; False if a batch of this id was committed before, whose rows then stay."""
        if not batch or "/" in batch or batch.startswith((".", "_")):
            raise ValueError(f"not a batch id: {batch!r}")
        target = f"{self.folder}/batches/batch-{batch}"
        if self._fs(target).exists(self._path(target)):
            return False
        aside = f"{self.folder}/aside/{scratch(self.spark, batch).rpartition('/')[2]}"
        # summed before the shuffle, so a source with a third of all rows is a row a task
        changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(aside)
        if self._move(aside, target):
            return True
        self._fs(aside).delete(self._path(aside), True)
        return False

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches: the snapshot and what came after it."""
        at, folded = self._snapshot()
        new = [b for b in self.committed() if b not in folded]
        if not at and not new:
            return self.spark.sql(f"SELECT {', '.join(f'CAST(NULL AS {c.split()[1]}) {c.split()[0]}' for c in _DDL.split(', '))} WHERE false")
        sums = self._rows(at, new).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 OR tokens <> 0")


def corpus_token_rollup(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Token totals of a corpus after a load, its replay, a revised count and a delete, all as committed batches.

    load: every document under both tokenizer versions. revise: the BPE count now has an end id for each document.
    retire: documents whose text is that of a document with a smaller doc_id are deleted, under both versions.
    """
    spark = docs.sparkSession
    counts = materialise(count_tokens(docs), "token-counts").withColumn("with_end", F.col("n_tokens") + 1)
    rollup = Rollup(spark, folder or scratch(spark, "token-rollup"))
    load = reduce(DataFrame.unionAll, [inserts(counts, "word_bpe_49k"), inserts(counts, "utf8_bytes", "n_bytes")])
    rollup.apply("0001-load", load)
    rollup.apply("0001-load", load)
    rollup.apply("0002-revise", revisions(counts, "word_bpe_49k", "n_tokens", "with_end"))
    first = counts.groupBy("text_md5").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    copies = counts.join(materialise(first, "token-copies"), "text_md5").where("doc_id > first_id")
    rollup.apply("0003-retire", deletes(copies, "word_bpe_49k", "with_end").unionAll(deletes(copies, "utf8_bytes", "n_bytes")))
    return rollup.totals()
