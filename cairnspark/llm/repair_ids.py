"""Token-ID output: Re-Pair grammar compression of shards of documents' ids.

A shard file holds whole documents in ascending doc_id order. Frequent pairs of neighbouring symbols are replaced by new
symbols, again and again until no pair occurs LEAST times, never across documents. A round replaces, wherever it stands
between no more frequent ones, every pair that is replaced LEAST times so; the most frequent pair always is. Pairs are
counted exactly, without overlaps. Only the places of frequent pairs are looked at again: a pair of old symbols never
becomes more frequent, and new pairs stand where something was replaced.

The file keeps the rules, the length of each rule's expansion, the remaining symbols in packed blocks, and where each
document's begin. So a document, or any range of its ids, is decoded from the rules and the blocks that it stands in.

File, all little-endian: magic; documents, rounds, rules, symbols, blocks and the first rule's number as u64; rules of
each round u32; rules u32 pairs; expansion lengths u64; doc_id i64; doc_id is null u8; first symbol of each document u64
(and the end); ids of each document u64; where each block begins u64 (and the end); the blocks: the lowest bytes
of BLOCK symbols each, then the planes of their other 3 bytes, deflated.

Defined results: a null or empty text has only the end id. Null doc_ids come first; rows of one doc_id stand in the
order of their texts. An empty table has no shard and no rows. Other columns are left out. Ids are from 0 to 2 ** 31 - 1;
others raise an error.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.llm._common import small_batches, materialise, open_shared, parallelism, scratch
from cairnspark.llm.pieces import JOIN_CHARS, default_path, library_encoder

MAGIC = b"RPGRAM02"
END_ID = 2
SHARD_IDS = 1_000_000
#: A pair must be replaced so often in a round: a rule takes 16 bytes, and a replaced symbol saves 2 or more.
LEAST = 8
#: Symbols that are packed together, and unpacked to read any one of them.
BLOCK = 1 << 14
#: Characters by which the rows of a repeated doc_id are dealt out, and the most repeated doc_ids that are broadcast.
PREFIX, BROADCAST_IDS = 512, 200_000
#: Ids and rules stay below it.
MAX_SYMBOL = 1 << 32
_BUCKETS = 21


def _odd_ones(joined: np.ndarray) -> np.ndarray:
    """Of ascending places, whether a walk from the left leaves each out, if joined[i] says that place i overlaps the one
    before: every other one of a run."""
    k = np.arange(len(joined))
    return (k - np.maximum.accumulate(np.where(joined, 0, k))) % 2 == 1


class _Sequence:
    """Symbols as a linked list in arrays, with the number of the pair that begins at each place (-1 for none)."""

    def __init__(self, ids: np.ndarray, last: np.ndarray, least: int):
        n = len(ids)
        self.symbol, self.last = ids.astype(np.uint32), np.append(last, True)
        self.after, self.before = np.arange(1, n + 1), np.arange(-1, n)  # place n stands for the end
        self.pair = np.full(n + 1, -1, np.int64)
        self.names, self.twin = np.zeros(0, np.uint64), np.zeros(0, bool)
        # pairs by the bucket of a hash first: those of a bucket with few places can't be frequent, and needn't be sorted
        mixed = self.symbol[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.symbol[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        bucket = (mixed >> np.uint64(64 - _BUCKETS)).astype(np.int64)
        self.number(np.flatnonzero(np.bincount(bucket, minlength=1 << _BUCKETS)[bucket] >= least))

    def number(self, places: np.ndarray) -> None:
        """Number the pairs at places anew; none of them occurs elsewhere under an older number."""
        self.pair[places] = -1
        at = places[~self.last[places]]
        names, which = np.unique((self.symbol[at].astype(np.uint64) << np.uint64(32)) | self.symbol[self.after[at]], return_inverse=True)
        self.pair[at] = len(self.names) + which
        self.names = np.concatenate([self.names, names])
        self.twin = np.concatenate([self.twin, names >> np.uint64(32) == names & np.uint64(0xFFFFFFFF)])

    def overlapping(self, at: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Which of ascending places, with the pairs there, don't count as their pair overlaps the one before, as in x x x."""
        out = np.flatnonzero(self.twin[pairs])
        if len(out):
            same, twins = np.zeros(len(out), bool), at[out]
            same[1:] = (self.after[twins[:-1]] == twins[1:]) & (pairs[out[:-1]] == pairs[out[1:]])
            out = out[_odd_ones(same)]
        return out

    def replace(self, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Put symbols in the place of the pairs at these places; returns the places where new pairs may begin."""
        gone = self.after[at]
        self.symbol[at] = symbols
        self.last[at] |= self.last[gone]
        self.after[at] = self.after[gone]
        self.before[self.after[gone]] = at
        self.pair[gone] = -1
        new = np.zeros(len(self.symbol) + 1, bool)
        new[at] = new[self.before[at]] = True  # -1 marks the place of the end
        return np.flatnonzero(new[:-1])


def grammar(ids: np.ndarray, last: np.ndarray, least: int = LEAST, first_rule: int | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(symbols, last, rules of each round): ids with frequent pairs replaced; last marks the ends of documents."""
    first_rule = first_rule or (int(ids.max()) + 1 if len(ids) else 1)
    seq, rules, count = _Sequence(ids, last, least), [], 0
    alive = np.ones(len(ids), bool)
    active = np.flatnonzero(seq.pair[:-1] >= 0)
    order = np.zeros(len(ids) + 1, np.int64)  # how frequent the pair at a place is; its number breaks ties
    while len(active):
        pairs, total = seq.pair[active], len(seq.names)
        often = np.bincount(pairs, minlength=total)
        if len(over := seq.overlapping(active, pairs)):
            often -= np.bincount(pairs[over], minlength=total)
        keep = often[pairs] >= least
        order[active[~keep]] = 0
        active, pairs = active[keep], pairs[keep]
        if not len(active):
            break
        mine = (often[pairs] << 32) | pairs
        order[active] = mine
        top = (mine >= order[seq.after[active]]) & (mine >= order[seq.before[active]])  # -1 is the end, too
        at, pairs = active[top], pairs[top]
        if len(over := seq.overlapping(at, pairs)):
            at, pairs = np.delete(at, over), np.delete(pairs, over)
        good = np.bincount(pairs, minlength=total) >= least
        if first_rule + count + int(good.sum()) > MAX_SYMBOL:
            raise ValueError("a shard has too many symbols")
        chosen = good[pairs]
        at, number = at[chosen], first_rule + count + (np.cumsum(good) - 1)[pairs[chosen]]
        pairs = seq.names[good]
        rules.append(np.column_stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)]).astype(np.uint32))
        count += len(pairs)
        gone = seq.after[at]
        alive[gone], order[gone], order[at] = False, 0, 0
        new = seq.replace(at, number)
        order[new] = 0
        seq.number(new)
        stay = np.zeros(len(ids), bool)
        stay[active] = True
        stay[gone] = False
        stay[new] = seq.pair[new] >= 0
        active = np.flatnonzero(stay)
    return seq.symbol[alive], seq.last[:-1][alive], rules


@dataclass
class Expansions:
    """What each rule stands for: flat[at[k]:at[k] + length[k]] for rule first + k."""

    first: int
    flat: np.ndarray
    at: np.ndarray
    length: np.ndarray

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.first
        out[rule] = self.length[symbols[rule].astype(np.int64) - self.first]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        lengths = self.lengths(symbols)
        total = np.cumsum(lengths)
        out = np.repeat(symbols, lengths).astype(np.uint32)
        is_rule = symbols >= self.first
        rule = np.repeat(is_rule, lengths)
        begin = np.zeros(len(symbols), np.int64)
        begin[is_rule] = self.at[symbols[is_rule].astype(np.int64) - self.first]
        place = np.repeat(begin - (total - lengths), lengths) + np.arange(len(out))
        out[rule] = self.flat[place[rule]]
        return out


def expansions(rules: list[np.ndarray], first: int) -> Expansions:
    """Expand the rules round by round; a rule only uses symbols of earlier rounds."""
    out = Expansions(first, np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for pairs in rules:
        lengths = out.lengths(pairs.ravel()).reshape(-1, 2).sum(1)
        flat = out.expand(pairs.ravel())
        at = len(out.flat) + np.cumsum(lengths) - lengths
        out = Expansions(first, np.concatenate([out.flat, flat]), np.concatenate([out.at, at]), np.concatenate([out.length, lengths]))
    return out


def rule_lengths(rules: list[np.ndarray], first: int) -> np.ndarray:
    """The length of each rule's expansion."""
    out = np.zeros(0, np.int64)
    for pairs in rules:
        sides = [np.where(x >= first, out[np.maximum(x - first, 0)] if len(out) else 1, 1) for x in pairs.astype(np.int64).T]
        out = np.concatenate([out, sides[0] + sides[1]])
    return out


def _pack_block(symbols: np.ndarray) -> bytes:
    """The planes of the symbols' bytes: the lowest, which hardly shrinks, as it is, the others deflated."""
    planes = np.ascontiguousarray(symbols.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return planes[0].tobytes() + zlib.compress(planes[1:].tobytes(), 1)


def _unpack_block(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(data[:n] + zlib.decompress(data[n:]), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def encode_shard(doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> bytes:
    wide = np.asarray(ids, np.int64)
    if len(wide) and (wide.min() < 0 or wide.max() >= 1 << 31):
        raise ValueError("token ids must be from 0 to 2 ** 31 - 1")
    first = int(wide.max()) + 1 if len(wide) else 1
    last = np.zeros(len(ids), bool)
    ends = np.cumsum(lengths)
    last[ends[lengths > 0] - 1] = True
    seq, last, rules = grammar(wide, last, first_rule=first)
    closes = np.flatnonzero(last) + 1
    starts = np.zeros(len(lengths) + 1, np.uint64)
    starts[1:][lengths > 0] = closes
    starts = np.maximum.accumulate(starts)
    blocks = [_pack_block(seq[a : a + BLOCK]) for a in range(0, len(seq), BLOCK)]
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return b"".join([
        MAGIC, struct.pack("<6Q", len(lengths), len(rules), len(pairs), len(seq), len(blocks), first),
        np.array([len(r) for r in rules], "<u4").tobytes(), pairs.astype("<u4").tobytes(), rule_lengths(rules, first).astype("<u8").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(), starts.astype("<u8").tobytes(), lengths.astype("<u8").tobytes(),
        np.cumsum([0, *map(len, blocks)]).astype("<u8").tobytes(), *blocks,
    ])


class Shard:
    """A shard file, open for reading: documents, or ranges of their ids, are decoded from the blocks they stand in.

    file has seek and read; of the file the header is read at once, and the rules and blocks when they are needed.
    """

    def __init__(self, file):
        self.file = file
        head = self._read(0, 56)
        if head[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        docs, rounds, self.n_rules, self.n_symbols, blocks, self.first_rule = struct.unpack_from("<6Q", head, 8)
        self.at = {}
        at = 56
        for name, size in (("rounds", 4 * rounds), ("rules", 8 * self.n_rules), ("lengths", 8 * self.n_rules), ("doc_ids", 8 * docs), ("null", docs), ("starts", 8 * (docs + 1)), ("sizes", 8 * docs), ("blocks", 8 * (blocks + 1))):
            self.at[name] = (at, size)
            at += size
        self.data = at
        self.doc_ids = [None if z else i for i, z in zip(self._array("doc_ids", "<i8").tolist(), self._array("null", "u1").tolist(), strict=True)]
        self.starts, self.lengths = self._array("starts", "<u8").astype(np.int64), self._array("sizes", "<u8").astype(np.int64)
        self.block_at = self._array("blocks", "<u8").astype(np.int64)
        self.blocks_read = 0
        self._held: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))
        self._table: Expansions | None = None

    @classmethod
    def of(cls, data: bytes) -> Shard:
        return cls(io.BytesIO(data))

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        out = self.file.read(size)
        if len(out) != size:
            raise ValueError("the shard is cut short")
        return out

    def _array(self, name: str, kind: str) -> np.ndarray:
        return np.frombuffer(self._read(*self.at[name]), kind)

    @property
    def expansion_lengths(self) -> np.ndarray:
        return self._array("lengths", "<u8").astype(np.int64)

    @property
    def table(self) -> Expansions:
        if self._table is None:
            pairs, sizes = self._array("rules", "<u4").reshape(-1, 2), self._array("rounds", "<u4")
            self._table = expansions(np.split(pairs, np.cumsum(sizes)[:-1].astype(int)) if len(sizes) else [], self.first_rule)
        return self._table

    def _block(self, k: int) -> np.ndarray:
        if self._held[0] != k:
            data = self._read(self.data + int(self.block_at[k]), int(self.block_at[k + 1] - self.block_at[k]))
            self._held = k, _unpack_block(data, min(BLOCK, self.n_symbols - k * BLOCK))
            self.blocks_read += 1
        return self._held[1]

    def symbols(self, first: int, end: int) -> np.ndarray:
        """Symbols first to end of the shard, from the blocks that hold them."""
        parts = [self._block(k)[max(0, first - k * BLOCK) : end - k * BLOCK] for k in range(first // BLOCK, -(-end // BLOCK))] if end > first else []
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        """The ids of document k."""
        return self.table.expand(self.symbols(self.starts[k], self.starts[k + 1]))

    def documents(self, first: int, end: int) -> list[np.ndarray]:
        """The ids of documents first to end, expanded together."""
        ids = self.table.expand(self.symbols(self.starts[first], self.starts[end]))
        return np.split(ids, np.cumsum(self.lengths[first:end])[:-1]) if end > first else []

    def window(self, k: int, first: int, end: int) -> np.ndarray:
        """Ids first to end of document k; only the symbols that stand for them are expanded."""
        symbols = self.symbols(self.starts[k], self.starts[k + 1])
        sums = np.concatenate([[0], np.cumsum(self.table.lengths(symbols))])
        a, b = int(np.searchsorted(sums, first, side="right")) - 1, int(np.searchsorted(sums, end, side="left"))
        return self.table.expand(symbols[a:b])[first - sums[a] : end - sums[a]]


def runs_of(who: list, texts: list[str | None], chars: int) -> Iterator[tuple[list, list]]:
    """Runs of rows with up to chars characters in all, or one longer text."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > a and size + n > chars:
            yield who[a:i], texts[a:i]
            a, size = i, 0
        size += n
    if a < len(texts):
        yield who[a:], texts[a:]


def _in_order(docs: DataFrame) -> DataFrame:
    """doc_id and text in ranges of the order of both.

    Ranges end between doc_ids, but where a doc_id is null or repeated also between texts: its rows are dealt by the first
    PREFIX characters, which the order of texts agrees with. So only rows of a doc_id that agree in these share a task.
    """
    parts = parallelism(docs.sparkSession)
    counts = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    odd = materialise(counts.where("n > 1").select(F.col("doc_id").alias("odd_id"), F.lit(True).alias("odd")), "token-odd-ids")
    found = odd.count()
    if not found:
        return docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    odd = F.broadcast(odd) if found <= BROADCAST_IDS else odd
    start = F.when(F.col("odd"), F.substring("text", 1, PREFIX))
    marked = docs.join(odd, F.col("doc_id").eqNullSafe(F.col("odd_id")), "left").select("doc_id", "text", start.alias("start"))
    return marked.repartitionByRange(parts, "doc_id", "start").sortWithinPartitions("doc_id", "text").select("doc_id", "text")


def write_shards(docs: DataFrame, folder: str | None = None, path: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode whole texts, append END_ID to each, and write the shards in ascending doc_id order.

    Returns the committed manifest: part, seq, file, n_docs, n_ids, base (ids in the shards before). A task names its
    files anew on each attempt, and only those that a committed manifest row names are ever read.
    """
    spark = docs.sparkSession
    folder, path = folder or scratch(spark, "token-shards"), path or default_path()
    small_batches(spark)
    dealt = _in_order(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seq = library_encoder(path), TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            who = [d for ids, _, _ in held for d in ids]
            ids, lengths = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            file = f"{folder}/shard-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.rpg"
            with open_shared(file, "wb") as f:
                f.write(encode_shard(who, ids, lengths))
            out = pa.record_batch({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [file], "n_docs": pa.array([len(who)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64())})
            seq, held = seq + 1, []
            return out

        total = 0
        for batch in batches:
            for who, texts in runs_of(batch.column(0).to_pylist(), batch.column(1).to_pylist(), min(JOIN_CHARS, shard_ids)):
                ids, offsets = enc.encode(texts)
                held.append((who, np.insert(ids, offsets[1:], END_ID), np.diff(offsets) + 1))
                total += len(ids) + len(who)
                if total >= shard_ids:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    manifest = materialise(dealt.mapInArrow(run, "part int, seq int, file string, n_docs bigint, n_ids bigint"), "token-manifest")
    # ids are summed by part first, so that one task sees a row a part, of which there are as many as partitions
    rows = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(rows("part")), F.lit(0)).alias("parts_before"))
    inside = F.coalesce(F.sum("n_ids").over(rows("part", "seq")), F.lit(0))
    return manifest.withColumn("inside", inside).join(parts, "part").withColumn("base", (F.col("inside") + F.col("parts_before")).cast("long")).drop("inside", "parts_before")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids of every document, decoded from the files that the manifest names."""
    return _read(manifest, True)


def _read(manifest: DataFrame, with_ids: bool) -> DataFrame:
    spark = manifest.sparkSession
    small_batches(spark)
    ddl = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_shared(file, "rb") as f:
                    shard = Shard(f)
                    starts = base + np.cumsum(shard.lengths) - shard.lengths
                    for a in range(0, len(shard.doc_ids), 512):
                        each = shard.documents(a, min(a + 512, len(shard.doc_ids)))
                        out = {"doc_id": pa.array(shard.doc_ids[a : a + 512], pa.int64()), "start": starts[a : a + 512], "n_tokens": np.array([len(x) for x in each], np.int64), "ids_crc32": np.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], np.int64)}
                        if with_ids:
                            out["ids"] = pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32()))
                        yield pa.record_batch(out)

    return manifest.select("file", "base").repartition(parallelism(spark)).mapInArrow(run, ddl)


def shard_digests(docs: DataFrame) -> DataFrame:
    """Write the shards of docs and read back the digests of every document."""
    return _read(write_shards(docs), False)
