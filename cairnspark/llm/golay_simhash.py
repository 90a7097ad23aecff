"""SimHash near duplicates by Golay-code fuzzy hashing.

A text's fingerprint has a bit set where over half of its shingles' XXH64 hashes have it. Two fingerprints link at 3 or
fewer differing bits; components are what links reach.

Fingerprints are cut into three segments of at most 23 bits. Of two with up to 3 differing bits, two segments differ in
one bit at most each (pigeonhole: two segments with two each would make four). The binary Golay code is perfect: every
word of 23 bits is within 3 bits of exactly one codeword. Let two words differ in one bit at most. Either both decode to
the same codeword, or each stands 3 bits from its own codeword and 4 from the other's. A word at 3 bits from its own has
exactly five codewords at 4 bits; so a segment's keys are the index of its codeword and, at 3 bits, those of the five that
are smaller: two such segments always share the smaller one of their own indices. Fingerprints get a key for each pair of
segments and each pair of their indices, about 30 in all; equal keys meet in a shuffle, and the distances are verified.

A key is selective: 24 bits of index. Where a key still has more fingerprints than BLOCK, they are dealt into blocks, and
each pair of blocks is a task; inside a task only the links of a spanning forest leave it, never all pairs.

Defined results: words are lower-cased in A to Z only and split at the space and the bytes 9 to 13. Fewer than three words
are one shingle; a null text and one without words have fingerprint zero, which links like any other. Repeated rows and
rows that repeat a doc_id are rows of their own. component_id is the smallest doc_id of the component; a null doc_id never
is one unless the component has no other. Further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm._common import materialise, parallelism, small_batches, text_slices
from cairnspark.llm.components import connected_components
from cairnspark.llm.words import lower_ascii, word_spans

WIDTH, SEED, RADIUS = 3, 42, 3
#: Shingles that are hashed and counted at once.
CHUNK = 1 << 16
#: (first bit, bits) of the segments, and the pairs of them of which one differs in one bit at most each.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Fingerprints of a key that are compared at once; a key with more is cut into blocks.
BLOCK = 8192
#: Keys with up to so many fingerprints are compared many keys at once.
SMALL = 48
#: A table of cut keys is broadcast up to so many rows.
BROADCAST_KEYS = 100_000

# --- the code -----------------------------------------------------------------------------------------------------

_WORD, _INDEX = 23, 12
_CHECK = _WORD - _INDEX
#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the binary Golay code.
_GENERATOR = 0b110001110101


def _remainders() -> np.ndarray:
    """The check bits of the word whose upper 12 bits are i and whose lower ones are zero."""
    r = np.arange(1 << _INDEX, dtype=np.int64) << _CHECK
    for k in range(_WORD - 1, _CHECK - 1, -1):
        r ^= (r >> k & 1) * (_GENERATOR << (k - _CHECK))
    return r


_REST = _remainders()


def syndrome(words: np.ndarray) -> np.ndarray:
    return _REST[words >> _CHECK] ^ (words & ((1 << _CHECK) - 1))


def _errors() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error of up to 3 bits, and the differences of index to the five codewords one bit farther than 3."""
    ones = 1 << np.arange(_WORD, dtype=np.int64)
    i, j, k = (x.ravel() for x in np.meshgrid(*[np.arange(_WORD)] * 3, indexing="ij"))
    keep = (i < j) & (j < k)
    triples = ones[i[keep]] | ones[j[keep]] | ones[k[keep]]
    pairs = (ones[:, None] | ones)[np.triu_indices(_WORD, 1)]
    patterns = np.concatenate([[0], ones, pairs, triples])
    error = np.full(1 << _CHECK, -1, np.int64)
    error[syndrome(patterns)] = patterns
    codewords = (np.arange(1 << _INDEX, dtype=np.int64) << _CHECK) | _REST
    sevens = codewords[np.bitwise_count(codewords) == 7]
    farther = np.zeros((1 << _CHECK, 5), np.int64)
    holds = (sevens & triples[:, None]) == triples[:, None]
    farther[syndrome(triples)] = sevens[np.nonzero(holds)[1]].reshape(-1, 5) >> _CHECK
    return error, farther


_ERROR, _FARTHER = _errors()


def segment_keys(words: np.ndarray) -> np.ndarray:
    """Six columns of codeword indices for each word of up to 23 bits, -1 where there is none: its own, and the smaller ones
    of those that stand 4 bits away from a word that stands 3 from its own."""
    s = syndrome(words)
    own = (words ^ _ERROR[s]) >> _CHECK
    out = np.full((len(words), 6), -1, np.int64)
    out[:, 0] = own
    others = own[:, None] ^ _FARTHER[s]
    far = np.bitwise_count(_ERROR[s]) == 3
    out[:, 1:] = np.where(far[:, None] & (others < own[:, None]), others, -1)
    return out


def fingerprint_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, key): the keys of unsigned 64-bit fingerprints; a key holds the pair of segments and their two indices."""
    parts = [segment_keys((prints >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64)) for low, bits in SEGMENTS]
    which, keys = [], []
    for p, (a, b) in enumerate(PAIRS):
        both = (parts[a][:, :, None] << _INDEX) | parts[b][:, None, :]
        both[(parts[a] < 0)[:, :, None] | (parts[b] < 0)[:, None, :]] = -1
        row, i, j = np.nonzero(both >= 0)
        which.append(row)
        keys.append(both[row, i, j] | p << 2 * _INDEX)
    return np.concatenate(which), np.concatenate(keys)


# --- fingerprints -------------------------------------------------------------------------------------------------


def _spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space after each, and where they start and end there."""
    stops = np.cumsum(ends - starts + 1) - 1
    begins = stops - (ends - starts)
    out = np.full(len(stops) and int(stops[-1]) + 1, ord(" "), np.uint8)
    letter = np.ones(len(out), bool)
    letter[stops] = False
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    out[letter] = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    return out.tobytes(), begins, stops


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The fingerprints of UTF-8 texts, as unsigned 64-bit numbers."""
    low = lower_ascii(data)
    starts, ends, first = word_spans(low, offsets)
    text, begins, stops = _spaced(low, starts, ends)
    n = np.diff(first)
    shingles = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), shingles)
    at = first[:-1][owner] + np.arange(len(owner)) - (np.cumsum(shingles) - shingles)[owner]
    begin, stop = begins[at], stops[at + np.minimum(n, width)[owner] - 1]
    ones = np.zeros((len(n), 64), np.int64)
    for k in range(0, len(owner), CHUNK):
        hashes = np.array([xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(begin[k : k + CHUNK].tolist(), stop[k : k + CHUNK].tolist(), strict=True)], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        mine = owner[k : k + CHUNK]
        cuts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        ones[mine[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    over = 2 * ones > shingles[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()


def _prints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for a, b, data, offsets in text_slices(batch, "text"):
                yield pa.record_batch({"doc_id": ids.slice(a, b - a), "print": pa.array(fingerprints(data, offsets, width).view(np.int64))})

    return run


def simhashes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and print (a long) of every document."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_prints(width), f"doc_id {kind}, print bigint")


# --- links --------------------------------------------------------------------------------------------------------


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        for k in range(0, len(prints), CHUNK):
            which, keys = fingerprint_keys(prints[k : k + CHUNK])
            yield pa.record_batch({"key": pa.array(keys), "print": pa.array(prints[k : k + CHUNK][which].view(np.int64))})


def _walk(prints: np.ndarray) -> Iterator[np.ndarray]:
    """Links of a spanning forest of the links among prints: what a print has reached is not compared again."""
    left = prints
    while len(left):
        seeds, left = [left[0]], left[1:]
        while seeds and len(left):
            seed = seeds.pop()
            near = np.bitwise_count(left ^ seed) <= RADIUS
            if near.any():
                found = left[near]
                left = left[~near]
                seeds.extend(found)
                yield np.stack([np.full(len(found), seed, np.uint64), found])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prints that stand sorted by task to links of prints within RADIUS; links that join what is joined may be left out."""

    def linked(task: np.ndarray, prints: np.ndarray) -> Iterator[np.ndarray]:
        cuts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]]))
        size = np.diff(cuts)
        for g in np.flatnonzero(size > SMALL):
            yield from _walk(np.unique(prints[cuts[g] : cuts[g + 1]]))
        keep = np.repeat(size <= SMALL, size)
        task, prints = task[keep], prints[keep]
        for shift in range(1, SMALL):  # of the small tasks all pairs, those so many rows apart at once
            same = np.flatnonzero(task[shift:] == task[:-shift])
            if not len(same):
                break
            a, b = prints[same], prints[same + shift]
            near = np.bitwise_count(a ^ b) <= RADIUS
            yield np.stack([a[near], b[near]])

    def out(task: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        for pairs in linked(task, prints):
            a, b = (x.view(np.int64) for x in pairs)
            yield pa.record_batch({"a": pa.array(np.maximum(a, b)), "b": pa.array(np.minimum(a, b))})

    held: list[tuple[np.ndarray, np.ndarray]] = []  # the rows of the last task so far
    for batch in batches:
        if not batch.num_rows:
            continue
        task, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if held and held[0][0][0] != task[0]:
            yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
        last = int(np.searchsorted(task, task[-1]))
        if last:
            head = [*held, (task[:last], prints[:last])]
            yield from out(*(np.concatenate(x) for x in zip(*head, strict=True)))
            held = []
        held.append((task[last:], prints[last:]))
    if held:
        yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))


def print_links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: links of distinct prints (a column print) that join all within RADIUS of each other into components."""
    spark = prints.sparkSession
    small_batches(spark)
    parts = parallelism(spark)
    keys = materialise(prints.select("print").mapInArrow(_keys, "key bigint, print bigint"), "golay-keys")
    crowded = materialise(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "golay-crowded")
    cuts = crowded.select("key", F.ceil(F.col("n") / block).alias("cuts"))
    found = crowded.count()
    tasks = keys.withColumn("task", F.shiftleft("key", 32))
    if found:
        cuts = F.broadcast(cuts) if found <= BROADCAST_KEYS else cuts
        mine = F.pmod(F.xxhash64("print"), F.col("cuts"))
        spread = keys.join(cuts, "key", "left").withColumn("own", mine)
        # with the rows of each other block; a key that isn't cut is one task
        others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1), lambda x: x != F.col("own"))
        spread = spread.withColumn("other", F.explode(F.coalesce(others, F.array(F.lit(0).cast("long")))))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        number = F.coalesce(low * F.col("cuts") + high, F.lit(0)).cast("long")
        tasks = spread.withColumn("task", F.shiftleft("key", 32) + number)
    dealt = tasks.select("task", "print").repartition(parts, "task").sortWithinPartitions("task")
    return dealt.mapInArrow(_links, "a bigint, b bigint")


def simhash_classes(docs: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document. Steps are written to the shared folder."""
    rows = materialise(simhashes(docs, width), "golay-prints")
    nodes = materialise(rows.groupBy("print").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("weight")), "golay-nodes")
    groups = connected_components(materialise(print_links(nodes, block), "golay-links"), "golay-groups")
    roots = nodes.join(groups.withColumnRenamed("node", "print"), "print", "left").where("root IS NOT NULL OR weight > 1")
    roots = materialise(roots.select("print", F.coalesce("root", "print").alias("root"), "first_id"), "golay-roots")
    smallest = materialise(roots.groupBy("root").agg(F.min("first_id").alias("component")), "golay-smallest")
    many = materialise(roots.join(smallest, "root").select("print", "component"), "golay-classes")
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return rows.join(many, "print", "left").select("doc_id", digits.alias("fingerprint"), F.coalesce("component", "doc_id").alias("component_id"))
