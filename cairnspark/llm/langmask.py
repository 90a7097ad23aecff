"""Language ID by bit-sliced Bloom filters over character n-grams.

All languages share their hash positions: the filter is an array of bit masks, a bit a language, and one look-up of an
n-gram (the AND of a few masks) returns all languages that contain it. A text's n-grams are looked up together; each
language's hits are counted, corrected for the share of n-grams that its filter lets through by chance, and the language
with the most wins.

Training uses a bounded sample of labelled documents (sample_rows a language, expected; picked by a hash of doc_id): an
n-gram belongs to a language if at least min_share of its sample documents have it, and if it isn't over contrast times
as common in another language. Documents are counted on the executors, only n-grams over the threshold come to the
driver, whose number a language is at most the distinct n-grams of a document over min_share.

Defined results: a null text, or one without letters, is und with score 0. Ties go to the first language by name. A text
of which no n-gram is known goes to the first language with score 0. Without labelled rows all texts are und. Repeated
rows are predicted each by itself; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm._common import small_batches, mix64

GRAMS = (3, 4)
SAMPLE_ROWS = 1500
MIN_SHARE = 0.01
CONTRAST = 8.0
HASHES = 3
#: Mask cells for each n-gram that the languages hold.
CELLS_A_GRAM = 12
FOLDS, HELD_OUT = 5, 0
#: Characters that are looked up at once.
JOIN_CHARS = 1 << 18


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point of the first planes whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x30000)), bool, 0x30000)


def gram_hashes(codes: np.ndarray, sizes: tuple[int, ...] = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first characters) of the n-grams of lower-case characters.

    Every letter-less character counts as one blank; n-grams may begin or end with a blank, but have none inside.
    """
    letter = _letters()[np.minimum(codes, 0x2FFFF)] & (codes < 0x30000)
    c = np.where(letter, codes, 0).astype(np.uint64)
    blank = ~letter
    out, where = [], []
    for size in sizes:
        n = len(c) - size + 1
        if n <= 0:
            continue
        h = np.full(n, size, np.uint64)
        inner = np.zeros(n, bool)
        for k in range(size):
            h = h * np.uint64(0x100000001B3) + c[k : k + n]
            if 0 < k < size - 1:
                inner |= blank[k : k + n]
        ok = np.flatnonzero(~inner & ~(blank[:n] & blank[size - 1 :]))
        out.append(mix64(h[ok]))
        where.append(ok)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(where)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)


class MaskFilter:
    """Bloom filters of many languages, sliced by bit: cells[i] has bit l if position i is set in language l's filter."""

    def __init__(self, languages: list[str], grams: list[np.ndarray], hashes: int = HASHES):
        self.languages, self.hashes = languages, hashes
        total = max([1, *(len(g) for g in grams)])
        self.size = 1 << max(10, (CELLS_A_GRAM * total - 1).bit_length())
        self.planes = -(-len(languages) // 64)
        self.cells = np.zeros((self.planes, self.size), np.uint64)
        for number, g in enumerate(grams):
            for k in range(hashes):
                self.cells[number // 64][self._at(g, k)] |= np.uint64(1 << number % 64)
        filled = np.array([np.count_nonzero(self.cells[n // 64] & np.uint64(1 << n % 64)) / self.size for n in range(len(languages))])
        self.chance = filled**hashes

    def _at(self, grams: np.ndarray, k: int) -> np.ndarray:
        return ((grams + np.uint64(k) * ((grams >> np.uint64(32)) | np.uint64(1))) & np.uint64(self.size - 1)).astype(np.int64)

    def masks(self, grams: np.ndarray, plane: int = 0) -> np.ndarray:
        """The languages that contain each n-gram, as bits."""
        out = self.cells[plane][self._at(grams, 0)]
        for k in range(1, self.hashes):
            out = out & self.cells[plane][self._at(grams, k)]
        return out

    def hits(self, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each text (n-grams between bounds) and language the hits beyond those expected by chance."""
        out = np.zeros((len(bounds) - 1, len(self.languages)))
        n = np.diff(bounds)
        for plane in range(self.planes):
            masks = self.masks(grams, plane)
            for number in range(plane * 64, min(len(self.languages), plane * 64 + 64)):
                sums = np.concatenate([[0], np.cumsum((masks >> np.uint64(number % 64)) & np.uint64(1), dtype=np.int64)])
                p = min(self.chance[number], 0.999)
                out[:, number] = np.maximum(0, (sums[bounds[1:]] - sums[bounds[:-1]] - n * p) / (1 - p))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(languages, scores, known): known is the share of a text's n-grams that the winner contains."""
        best, score, known = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if not self.languages:
            return best, score, known
        run: list[int] = []
        chars = 0

        def flush() -> None:
            nonlocal run, chars
            parts = [_codes(texts[i]) for i in run]
            lengths = np.cumsum([0] + [len(p) for p in parts])
            grams, where = gram_hashes(np.concatenate(parts))
            order = np.argsort(where, kind="stable")
            grams, where = grams[order], where[order]
            bounds = np.searchsorted(where, lengths)
            hits, n = self.hits(grams, bounds), np.maximum(np.diff(bounds), 1)
            win, total = hits.argmax(1), hits.sum(1)
            for j, i in enumerate(run):
                best[i] = self.languages[win[j]]
                top = hits[j, win[j]]
                score[i], known[i] = (top / total[j] if total[j] > 0 else 0.0), min(1.0, top / n[j])
            run, chars = [], 0

        for i, t in enumerate(texts):
            if t is None or not any(map(str.isalpha, t)):
                continue
            if run and chars + len(t) > JOIN_CHARS:
                flush()
            run.append(i)
            chars += len(t) + 2
        if run:
            flush()
        return best, score, known


def with_fold(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False)))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, min_share: float = MIN_SHARE, contrast: float = CONTRAST) -> MaskFilter:
    """Learn from text and lang of labelled documents outside the held-out fold (a null doc_id is outside it)."""
    spark = docs.sparkSession
    rows = with_fold(docs.select("doc_id", "text", "lang")).where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row a language
    languages = sorted(sizes)
    if not languages:
        return MaskFilter([], [])
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_rows / sizes[lang]))).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    small_batches(spark)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of this task's documents by language and n-gram; gram 0 counts the documents."""
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            for lang, parts in held.items():
                names, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.record_batch({"lang": pa.array([lang] * len(names), pa.string()), "gram": names.view(np.int64), "n": n})
            held, size = {}, 0

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = np.unique(np.append(gram_hashes(_codes(text))[0], np.uint64(0)))
                held.setdefault(lang, []).append(g)
                size += len(g)
            if size > 1_000_000:
                yield from flush()
        yield from flush()

    found = picked.mapInArrow(grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    seen = {r[0]: r[1] for r in found.where("gram = 0").select("lang", "n").collect()}
    languages = sorted(seen)
    least = F.lit(float("inf"))
    for lang in languages:
        least = F.when(F.col("lang") == lang, F.lit(max(2.0, min_share * seen[lang]))).otherwise(least)
    table = found.where((F.col("gram") != 0) & (F.col("n") >= least)).toArrow()
    code = np.array([languages.index(x) for x in table.column("lang").to_pylist()], np.int64)
    gram, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
    common = n / np.array([seen[x] for x in languages])[code] if len(code) else np.zeros(0)
    names, which = np.unique(gram, return_inverse=True)
    top = np.zeros(len(names))
    np.maximum.at(top, which, common)
    keep = common * contrast >= top[which] if len(code) else np.zeros(0, bool)
    return MaskFilter(languages, [np.sort(gram[keep & (code == k)]) for k in range(len(languages))])


def identify(docs: DataFrame, model: MaskFilter, carry: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score and known of every whole text; only the text is looked at. carry names columns to keep.

    A carried column that is named like a new one gives way to it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = list(dict.fromkeys(["doc_id", *(c for c in carry or [] if c.lower() not in ("lang_pred", "score", "known"))]))
    kinds = dict(docs.dtypes)
    shared = spark.sparkContext.broadcast(model)  # its size is bounded by the n-grams that training may keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score, known = shared.value.predict(batch.column(batch.schema.get_field_index("text")).to_pylist())
            out = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
            yield pa.record_batch(out | {"lang_pred": pa.array(best, pa.string()), "score": score, "known": known})

    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", lang_pred string, score double, known double"
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, ddl)
