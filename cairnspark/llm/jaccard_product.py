"""N-gram Jaccard join: a blocked sparse matrix product of the document by n-gram incidence.

The incidence matrix M has a row per distinct shingle set (node) and a column per word shingle; M Mt holds the overlaps.
1. Names. Every text gets the 128-bit name of its shingle set; equal sets are one node from here on. Nodes have 64-bit
   numbers: the first half of the name, or the second where two nodes share the first.
2. Column blocks. Each task packs the columns of its nodes by column block: one shuffled row per task and block, with
   numpy arrays inside. A block counts the nodes of each of its columns. Columns of one node add to no overlap and end
   here; the other columns go back, with their counts, to the nodes they came from.
3. Size-derived bounds. A link needs an overlap of 3/4 of either set. Nodes that share fewer columns than that with all
   others have no link. Of the rest, only the rarest columns (a quarter of the set, and one) can hold the first common
   column of a link; they give the candidate pairs, blocked by column again.
4. Exact product. Candidates that hang together are multiplied: the overlaps of small groups are accumulated sparsely,
   column by column, for many groups at once; those of large ones as blocks of 0/1 columns. Pairs below the bound fall
   out. A large group is cut into blocks by nodes and by bytes, and each pair of blocks is a task; of the links only a
   spanning forest and the link counts leave the task.

Memory: blocks hold about BLOCK_ENTRIES entries, a task holds one block at a time, and Spark sorts (and spills) what is
dealt to it. Columns of over about HOT nodes, found by counting a sample, aren't dealt out at all: they rank behind all
others, each node counts its own, and nodes whose rarest columns they are hang on one node for each such column. The
sample decides only which way a column goes, never the result.

Steps 2 and 3 use 32-bit column numbers inside a block and a slack for their collisions, so they can only let more
through. Step 4 compares 128-bit shingle names. No step lists all pairs of a group.

Defined results: a null text, or one without words, has an empty set: n_shingles 0, component_id its own doc_id, no
links. Equal sets are linked (both copies of a repeated row, too). A null doc_id takes part in links, is never the
smallest id, and a component of such rows alone has a null component_id. Other columns are left out.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.llm._common import small_batches, materialise, mix64, parallelism, text_slices
from cairnspark.llm.components import connected_components
from cairnspark.llm.words import shingle_sets

WIDTH = 5
#: Entries that a task packs at once.
PACK = 1_500_000
#: Entries of a column block, about: a task holds one block at a time.
BLOCK_ENTRIES = 2_000_000
#: Column blocks may have so many times the session's shuffle partitions.
MORE_TASKS = 4
#: Nodes that make a column hot, and the most columns that are treated so (8 bytes each are broadcast).
HOT, MAX_HOT = 1 << 20, 1 << 20
#: Nodes of a block of a candidate group, at most; groups of up to SMALL_NODES aren't cut, larger ones into up to
#: FEW_CUTS blocks of that size, before blocks grow.
BLOCK_NODES, SMALL_NODES, FEW_CUTS = 2048, 128, 16
#: Cells of a dense block of columns.
CELLS = 8_000_000
#: Pairs that the sparse product may list for each entry; groups with more go through dense blocks.
SPARSE_PAIRS = 16
#: Document ids that may be broadcast (about 60 bytes each, hashed); beyond it the texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Posting lists up to this length give their pairs, filtered by position; longer ones give a chain.
SHORT_LIST = 8


def _pack(*arrays: np.ndarray) -> bytes:
    head = struct.pack(f"<{len(arrays)}I", *(len(a) for a in arrays))
    return head + b"".join(a.tobytes() for a in arrays)


def _unpack(data: bytes, kinds: str) -> list[np.ndarray]:
    sizes, at, out = struct.unpack_from(f"<{len(kinds)}I", data), 4 * len(kinds), []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(data, dtype=(dt := np.dtype({"Q": "<u8", "I": "<u4", "q": "<i8"}[kind])), count=n, offset=at))
        at += n * dt.itemsize
    return out


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def set_name(shingles: np.ndarray) -> tuple[int, int]:
    """The 128-bit name of a shingle set (two rows of lanes), as two 64-bit halves that don't depend on its order."""
    keys = np.array([[0xA0761D6478BD642F], [0xE7037ED1A0B428DB]], np.uint64)
    sums = np.add.reduce(mix64(shingles ^ keys), axis=1, dtype=np.uint64)
    hi, lo = mix64(sums + np.uint64(shingles.shape[1])).tolist()
    return hi, lo


def _block(token: np.ndarray, blocks: int) -> np.ndarray:
    return ((token >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)


def _slack(n: np.ndarray) -> np.ndarray:
    return 1 + n // 4096


def need(n: np.ndarray) -> np.ndarray:
    """Columns that a set of n must share with a linked one, less the slack."""
    return np.maximum(1, (3 * n + 3) // 4 - _slack(n))


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1])
    return starts, np.diff(np.append(starts, len(sorted_keys)))


# --- names --------------------------------------------------------------------------------------------------------

_NAMES = "kind int, doc_id bigint, hi bigint, lo bigint, n bigint"


def _names(width: int, sample: int, mask: int):
    """Texts to rows: kind 0 a document with the name of its set, kind 1 a column (hi) of a sampled node (lo)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b, data, offsets in text_slices(batch, "text"):
                sets = shingle_sets(data, offsets, width)
                names = np.array([set_name(s) if s.shape[1] else (0, 0) for s in sets], np.uint64).reshape(-1, 2)
                names[:, 0] &= np.uint64(mask)
                n = np.array([s.shape[1] for s in sets], np.int64)
                kind = pa.array(np.zeros(b - a, np.int32))
                yield pa.record_batch({"kind": kind, "doc_id": batch.column(0).slice(a, b - a), "hi": _signed(names[:, 0]), "lo": _signed(names[:, 1]), "n": n})
                # each sampled node once a task, however many copies it has there
                for i in np.flatnonzero((names[:, 1] % np.uint64(sample) == 0) & (n > 0)):
                    if (node := int(names[i, 1])) not in seen:
                        seen.add(node)
                        k = int(n[i])
                        none = pa.nulls(k, pa.int64())
                        lo = _signed(np.full(k, node, np.uint64))
                        yield pa.record_batch({"kind": pa.array(np.ones(k, np.int32)), "doc_id": none, "hi": _signed(sets[i][0]), "lo": lo, "n": none})

    return run


def hot_columns(named: DataFrame, hot: int, sample: int) -> np.ndarray:
    """Sorted first lanes of the columns that about hot nodes or more have, judged by a sample; MAX_HOT at most."""
    often = named.where("kind = 1").groupBy("hi").agg(F.count_distinct("lo").alias("n")).where(F.col("n") >= max(2, hot // sample // 2))
    found = often.orderBy(F.desc("n"), "hi").limit(MAX_HOT).toArrow().column("hi").to_numpy()
    return np.sort(found.view(np.uint64))


def _numbering(nodes: DataFrame) -> tuple[list[int], int]:
    """(first halves that several nodes share, salt): such nodes are numbered by lo ^ salt, the others by hi.

    n nodes share about n * n / 2 ** 65 first halves: a handful in ten billion.
    """
    twice = [r[0] for r in nodes.groupBy("hi").count().where("count > 1").select("hi").toLocalIterator()]
    if not twice:
        return [], 0
    lows = [r[0] for r in nodes.where(F.col("hi").isin(twice)).select("lo").toLocalIterator()]
    for salt in itertools.count():
        mine = [x ^ salt for x in lows]
        if len(set(mine)) == len(mine) and nodes.where(F.col("hi").isin(mine)).isEmpty():
            return twice, salt


def _node(twice: list[int], salt: int) -> Column:
    other = F.col("lo").bitwiseXOR(F.lit(salt).cast("long"))
    return F.when(F.col("hi").isin(twice), other).otherwise(F.col("hi")) if twice else F.col("hi")


# --- columns ------------------------------------------------------------------------------------------------------

#: kind 1: packed entries of column block part; 2: packed sizes of the nodes of bucket part; 3: an edge a, b between
#: nodes of a hot column; 4: a hot column a and a node b that has it.
_ROWS = "part int, kind int, a bigint, b bigint, payload binary"


def _rows(part, kind: int, payload: list[bytes]) -> pa.RecordBatch:
    k = len(payload)
    none = pa.nulls(k, pa.int64())
    return pa.record_batch({"part": pa.array(part, pa.int32()), "kind": pa.array(np.full(k, kind, np.int32)), "a": none, "b": none, "payload": pa.array(payload, pa.binary())})


def _links(kind: int, a: np.ndarray, b: np.ndarray, blocks: int) -> pa.RecordBatch:
    part = pa.array((np.arange(len(a)) % blocks).astype(np.int32))
    return pa.record_batch({"part": part, "kind": pa.array(np.full(len(a), kind, np.int32)), "a": _signed(a), "b": _signed(b), "payload": pa.nulls(len(a), pa.binary())})


def _dealt(key: np.ndarray, kind: int, pack) -> Iterator[pa.RecordBatch]:
    """Rows for the runs of equal, ascending keys; pack gives the payload of a run."""
    starts, lengths = _runs(key)
    for i in range(0, len(starts), 64):
        runs = [slice(a, a + k) for a, k in zip(starts[i : i + 64].tolist(), lengths[i : i + 64].tolist(), strict=True)]
        yield _rows([int(key[r.start]) for r in runs], kind, [pack(r) for r in runs])


def _by_node(who: np.ndarray, r: slice) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, entries of each) in a run of entries that are sorted by node."""
    runs, counts = _runs(who[r])
    return who[r.start + runs], counts.astype(np.uint32)


def _incidence(blocks: int, width: int, mask: int, twice: list[int], salt: int, hot):
    """Texts to the rows of _ROWS; copies of a set are packed once a task."""

    def hot_rows(nodes: np.ndarray, n: np.ndarray, who: np.ndarray, tokens: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Hot columns among a node's rarest: they come last in the order of columns, by their names."""
        starts = np.cumsum(count) - count
        place = np.arange(len(who)) - starts[who]
        rare = place <= (count - need(n))[who]
        who, tokens = who[rare], tokens[rare]
        order = np.lexsort((nodes[who], tokens))
        who, tokens = who[order], tokens[order]
        starts, lengths = _runs(tokens)
        head = nodes[who[starts]]
        yield _links(4, tokens[starts], head, blocks)
        pair = np.unique(np.stack([nodes[who], np.repeat(head, lengths)]), axis=1)
        pair = pair[:, pair[0] != pair[1]]
        yield _links(3, pair[0], pair[1], blocks)

    def flush(held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        nodes, n = np.array([x for x, _ in held], np.uint64), np.array([len(s) for _, s in held])
        tokens, who, count = np.concatenate([s for _, s in held]), np.repeat(np.arange(len(held)), n), np.zeros(len(held), np.int64)
        known = hot.value
        if len(known):
            is_hot = known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens
            count = np.bincount(who[is_hot], minlength=len(held))
            if is_hot.any():
                yield from hot_rows(nodes, n, who[is_hot], tokens[is_hot], count)
            tokens, who = tokens[~is_hot], who[~is_hot]
        bucket = (mix64(nodes) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        yield from _dealt(bucket[order], 2, lambda r: _pack(nodes[order[r]], n[order[r]].astype(np.uint32), count[order[r]].astype(np.uint32)))
        block = _block(tokens, blocks)
        order = np.argsort(block, kind="stable")  # entries of a block stay in the order of their nodes
        tokens, who = tokens[order].astype(np.uint32), who[order]

        def entries(r: slice) -> bytes:
            at, counts = _by_node(who, r)
            return _pack(nodes[at], counts, tokens[r])

        yield from _dealt(block[order], 1, entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = {x % (1 << 64) for x in twice}
        held, total, seen = [], 0, set()
        for batch in batches:
            for _, _, data, offsets in text_slices(batch, "text"):
                for s in shingle_sets(data, offsets, width):
                    if not s.shape[1]:
                        continue
                    hi, lo = set_name(s)
                    node = lo ^ salt if (hi := hi & mask) in shared else hi
                    if node not in seen:
                        seen.add(node)
                        held.append((node, s[0]))
                        total += s.shape[1]
                if total >= PACK:
                    yield from flush(held)
                    held, total = [], 0
                    if len(seen) > PACK:
                        seen.clear()
        if held:
            yield from flush(held)

    return run


def _blocks_of(batches: Iterator[pa.RecordBatch], kinds: tuple[int, ...]) -> Iterator[tuple[int, list[list[bytes]]] | pa.RecordBatch]:
    """(part, payloads of each of kinds) of one part after another; batches of all other kinds as they are."""
    part, held = None, [[] for _ in kinds]
    for batch in batches:
        kind = batch.column(1).to_numpy()
        mine = np.isin(kind, kinds)
        if not mine.all():
            yield batch.filter(pa.array(~mine))
        for p, k, data in zip(batch.column(0).to_numpy()[mine].tolist(), kind[mine].tolist(), batch.column(4).filter(pa.array(mine)), strict=True):
            if p != part:
                if part is not None:
                    yield part, held
                part, held = p, [[] for _ in kinds]
            held[kinds.index(k)].append(data.as_py())
    if part is not None:
        yield part, held


def _gather(parts: list[bytes], kinds: str) -> list[np.ndarray]:
    cols = [_unpack(p, kinds) for p in parts]
    return [np.concatenate(c) for c in zip(*cols, strict=True)]


def _shared_columns(blocks: int):
    """Column blocks to the columns that two or more nodes have, packed for their nodes' bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _blocks_of(batches, (1,)):
            if isinstance(found, pa.RecordBatch):
                yield found
                continue
            block, [parts] = found
            nodes, counts, tokens = _gather(parts, "QII")
            parts.clear()
            names, rank = np.unique(nodes, return_inverse=True)
            key = np.unique((tokens.astype(np.uint64) << np.uint64(32)) | np.repeat(rank.astype(np.uint64), counts))
            del tokens, nodes
            token = (key >> np.uint64(32)).astype(np.uint32)
            _, lengths = _runs(token)
            df = np.repeat(lengths, lengths)
            shared = df > 1
            token, who, df = token[shared], (key[shared] & np.uint64(0xFFFFFFFF)).astype(np.int64), df[shared].astype(np.uint32)
            bucket = (mix64(names) % np.uint64(blocks)).astype(np.int64)[who]
            order = np.lexsort((token, who, bucket))
            token, who, df = token[order], who[order], df[order]

            def entries(r: slice, who=who, token=token, df=df, names=names, block=block) -> bytes:
                at, counts = _by_node(who, r)
                return _pack(np.array([block], np.uint32), names[at], counts, token[r], df[r])

            yield from _dealt(bucket[order], 1, entries)

    return run


def _rare_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of nodes to the rarest columns of those that share enough of them, packed by column block."""
    for _, [parts, sizes] in _blocks_of(batches, (1, 2)):
        if not parts:
            continue
        names, n, hot = _gather(sizes, "QII")
        names, first = np.unique(names, return_index=True)
        n, hot = n[first].astype(np.int64), hot[first].astype(np.int64)
        cols = [_unpack(p, "IQIII") for p in parts]
        parts.clear()
        who = np.repeat(np.searchsorted(names, np.concatenate([c[1] for c in cols])), np.concatenate([c[2] for c in cols]))
        token = np.concatenate([(c[0].astype(np.uint64)[0] << np.uint64(32)) | c[3].astype(np.uint64) for c in cols])
        df = np.concatenate([c[4] for c in cols])
        shared = np.bincount(who, minlength=len(names)) + hot
        keep = (shared >= need(n))[who]
        who, token, df = who[keep], token[keep], df[keep]
        order = np.lexsort((token, df, who))
        who, token = who[order], token[order]
        starts, lengths = _runs(who)
        pos = np.arange(len(who)) - np.repeat(starts, lengths) + np.repeat((n - shared)[who[starts]], lengths)
        rare = pos <= (n - need(n))[who]
        who, token, pos = who[rare], token[rare], pos[rare]
        block = (token >> np.uint64(32)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        who, token, pos = who[order], token[order].astype(np.uint32), pos[order].astype(np.uint32)
        at, size = names[who], n[who].astype(np.uint32)
        yield from _dealt(block[order], 1, lambda r, token=token, at=at, size=size, pos=pos: _pack(token[r], at[r], size[r], pos[r]))


def _candidate_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rare columns to edges that connect all candidate pairs: pairs of short lists, chains by size of long ones."""
    for _, [parts] in _blocks_of(batches, (1,)):
        token, node, n, pos = _gather(parts, "IQII")
        parts.clear()
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        order = np.lexsort((n, token))
        token, node, n, pos = token[order], node[order], n[order], pos[order]
        starts, lengths = _runs(token)
        run_of, length = np.repeat(np.arange(len(starts)), lengths), np.repeat(lengths, lengths)
        left, right = [], []
        for gap in range(1, SHORT_LIST):
            a = np.flatnonzero(run_of[:-gap] == run_of[gap:]) if len(run_of) > gap else np.zeros(0, np.int64)
            short = length[a] <= SHORT_LIST
            a = a[short | (gap == 1)]
            b = a + gap
            ok = 100 * n[a] >= 75 * n[b]
            # common columns before these two aren't counted; at most the rest of either set is common
            bound = np.minimum(n[a] - pos[a], n[b] - pos[b]) + _slack(n[b])
            ok &= (length[a] > SHORT_LIST) | (7 * bound >= 3 * (n[a] + n[b]))
            left.append(node[a[ok]])
            right.append(node[b[ok]])
        a, b = np.concatenate(left), np.concatenate(right)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.uint64)
        yield pa.record_batch({"a": _signed(pair[0]), "b": _signed(pair[1])})


# --- product ------------------------------------------------------------------------------------------------------


def _columns(who: np.ndarray, lanes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, column): entries sorted by column, and the number of each one's; columns of two groups differ."""
    order = np.lexsort((who, lanes[0], group))
    new = np.ones(len(order), bool)
    g, x, y = group[order], lanes[0, order], lanes[1, order]
    new[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
    if (y[1:] != y[:-1])[~new[1:]].any():  # shingles that share the first half of their names
        order = np.lexsort((who, lanes[1], lanes[0], group))
        g, x, y = group[order], lanes[0, order], lanes[1, order]
        new[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return order, np.cumsum(new) - 1


def dense_overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """The overlap counts of two blocks of sets (of one with itself without right), summed over dense blocks of columns."""
    sets = left + (right or [])
    lanes = np.concatenate(sets, axis=1)
    who = np.repeat(np.arange(len(sets)), [s.shape[1] for s in sets])
    order, column = _columns(who, lanes, np.zeros(len(who), np.int8))
    who = who[order]
    counts = np.bincount(column) if len(column) else np.zeros(0, np.int64)
    common = (counts > 1)[column]
    column, who = (np.cumsum(counts > 1) - 1)[column[common]], who[common]
    m, k = len(left), len(right) if right is not None else len(left)
    out, step = np.zeros((m, k), np.float32), max(1, CELLS // len(sets))  # exact below 2 ** 24
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, [c, c + step])
        dense = np.zeros((len(sets), min(step, int(column[hi - 1]) - c + 1)), np.float32)
        dense[who[lo:hi], column[lo:hi] - c] = 1
        out += dense[:m] @ (dense[m:] if right is not None else dense).T
    return out


def sparse_links(n: np.ndarray, who: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j), from entries sorted by column: overlaps are counted only where two sets have a column."""
    left, right = [], []
    for gap in itertools.count(1):
        a = np.flatnonzero(column[:-gap] == column[gap:]) if len(column) > gap else np.zeros(0, np.int64)
        if not len(a):
            break
        i, j = who[a], who[a + gap]
        near = 100 * np.minimum(n[i], n[j]) >= 75 * np.maximum(n[i], n[j])  # else no overlap is enough
        left.append(i[near])
        right.append(j[near])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair, both = np.unique(np.concatenate(left) * len(n) + np.concatenate(right), return_counts=True)
    i, j = pair // len(n), pair % len(n)
    linked = 100 * both >= 75 * (n[i] + n[j] - both)
    return i[linked], j[linked]


def _roots(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number that the pairs reach from each number below size."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _large(side: np.ndarray, node: np.ndarray, weight: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
    """The links of one task with many nodes: a block with itself (side 0), or two blocks (-1 and 1) across."""
    n = np.array([s.shape[1] for s in sets], np.int64)
    across = side.any()
    left, right = (np.flatnonzero(side < 0), np.flatnonzero(side > 0)) if across else (np.arange(len(node)),) * 2
    both = dense_overlaps([sets[i] for i in left], [sets[i] for i in right] if across else None)
    link = 100 * both >= 75 * (n[left][:, None] + n[right][None, :] - both)
    if not across:
        np.fill_diagonal(link, False)
    links = np.zeros(len(node), np.int64)
    links[left] = link @ weight[right]
    if across:
        links[right] = weight[left] @ link
    # a spanning forest: enough pairs that every linked one hangs together
    rows = np.flatnonzero(link.any(1))
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in rows:
        to = np.flatnonzero(link[r])
        i.append(np.full(len(to), left[r]))
        j.append(right[to])
        if len(i) > 256:
            i, j = _forest(len(node), i, j)
    i, j = _forest(len(node), i, j)
    root = _roots(len(node), i[0], j[0])
    return pa.record_batch({"node": node, "root": node[root], "links": links})


def _forest(size: int, i: list[np.ndarray], j: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    root = _roots(size, np.concatenate(i), np.concatenate(j))
    child = np.flatnonzero(root != np.arange(size))
    return [child], [root[child]]


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of (task, side, node, weight, set) to (node, root, links): the links of a task as a forest and counts."""

    def products(tasks: list[dict]) -> Iterator[pa.RecordBatch]:
        rows = [(g, *r) for g, t in enumerate(tasks) for r in sorted(t.values(), key=lambda r: r[1])]  # ascending nodes
        group, side, node, weight = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        sets = [np.frombuffer(r[4], np.uint64).reshape(2, -1) for r in rows]
        n = np.array([s.shape[1] for s in sets], np.int64)
        who = np.repeat(np.arange(len(sets)), n)
        order, column = _columns(who, np.concatenate(sets, axis=1), group[who])
        who, lengths = who[order], np.bincount(column)
        starts = np.cumsum(lengths) - lengths
        of = group[who[starts]]
        pairs = np.bincount(of, lengths * (lengths - 1) / 2, minlength=len(tasks))
        entries = np.bincount(of, lengths, minlength=len(tasks))
        dense = (pairs > SPARSE_PAIRS * entries) | (np.bincount(group, side != 0) > 0)
        for g in np.flatnonzero(dense):
            at = np.flatnonzero(group == g)
            yield _large(side[at], node[at], weight[at], [sets[i] for i in at])
        mine = ~dense[group[who]]
        i, j = sparse_links(n, who[mine], column[mine])
        links = np.bincount(i, weight[j], minlength=len(n)) + np.bincount(j, weight[i], minlength=len(n))
        root = _roots(len(n), i, j)
        some = ~dense[group]
        yield pa.record_batch({"node": node[some], "root": node[root[some]], "links": links[some].astype(np.int64)})

    task, rows, held, total = None, {}, [], 0
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(5)]
        for t, s, x, w, data in zip(*cols, strict=True):
            if t != task:
                if rows:
                    held.append(rows)
                if total >= PACK:
                    yield from products(held)
                    held, total = [], 0
                task, rows = t, {}
            if x not in rows:
                rows[x] = (s, x, w, data)
                total += len(data) // 16
    if rows:
        held.append(rows)
    if held:
        yield from products(held)


def _sets(width: int, mask: int):
    """Candidate texts to their whole shingle sets; a row whose text isn't the one that was meant goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo = (batch.column(batch.schema.get_field_index(c)).to_numpy().view(np.uint64) for c in ("hi", "lo"))
            for a, b, data, offsets in text_slices(batch, "text"):
                sets = shingle_sets(data, offsets, width)
                names = [set_name(s) if s.shape[1] else None for s in sets]
                keep = [i for i, x in enumerate(names) if x and (x[0] & mask, x[1]) == (int(hi[a + i]), int(lo[a + i]))]
                part = batch.slice(a, b - a).take(pa.array(keep, pa.int64()))
                out = {c: part.column(part.schema.get_field_index(c)) for c in ("node", "weight", "root", "cuts")}
                yield pa.record_batch(out | {"lanes": pa.array([sets[i].tobytes() for i in keep], pa.binary())})

    return run


def _sorted_parts(df: DataFrame, blocks: int, parts: int) -> DataFrame:
    """Rows dealt by part, a partition each; beyond MORE_TASKS times the session's partitions several parts share one, which
    is then sorted, so that a task meets one after another."""
    tasks = min(blocks, MORE_TASKS * parts)
    out = df.repartitionById(tasks, F.col("part"))
    return out.sortWithinPartitions("part") if blocks > tasks else out


def _name_of(width: int):
    """Texts to the names of their shingle sets; null without shingles."""

    def run(text: pa.Array) -> pa.Array:
        out: list[dict | None] = []
        for _, _, data, offsets in text_slices(pa.record_batch({"text": text}), "text"):
            for s in shingle_sets(data, offsets, width):
                out.append(dict(zip(("hi", "lo"), np.array(set_name(s), np.uint64).view(np.int64).tolist(), strict=True)) if s.shape[1] else None)
        return pa.array(out, pa.struct([("hi", pa.int64()), ("lo", pa.int64())]))

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "hi bigint, lo bigint")


def _picked(texts: DataFrame, named: DataFrame, wanted: DataFrame, width: int, mask: int) -> DataFrame:
    """text, hi, lo, node, weight, root and cuts: a text for each wanted node.

    A doc_id of one row is enough to find the text by. The texts of null and repeated doc_ids are named again and found by
    doc_id and set together, so that the rows of such a doc_id don't meet all nodes that it stands for; one row for each
    node goes on.
    """
    fields = ("hi", "lo", "node", "weight", "root", "cuts")
    pick = wanted.select(F.col("first_id").alias("want_id"), *fields)
    few = wanted.count() <= BROADCAST_IDS // 2
    hint = F.broadcast if few else (lambda df: df)
    same_id = F.col("doc_id").eqNullSafe(F.col("want_id"))
    rows = named.where("kind = 0").select("doc_id").join(hint(pick.select("want_id")), same_id, "left_semi")
    odd = materialise(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id IS NULL OR n > 1").select(F.col("doc_id").alias("odd_id")), "jaccard-odd-nodes")
    if odd.isEmpty():
        return texts.join(hint(pick), same_id).select("text", *fields)
    is_odd = F.col("want_id").eqNullSafe(F.col("odd_id"))
    known = texts.join(hint(pick.join(odd, is_odd, "left_anti")), same_id).select("text", *fields)
    again = texts.join(odd, F.col("doc_id").eqNullSafe(F.col("odd_id")), "left_semi").withColumn("name", _name_of(width)(F.col("text"))).where("name IS NOT NULL")
    # written down, so that the join is of plain shuffles, whose hot partitions Spark can split
    again = materialise(again.select("doc_id", "text", F.col("name.hi").bitwiseAND(mask if mask < 1 << 63 else mask - (1 << 64)).alias("set_hi"), F.col("name.lo").alias("set_lo")), "jaccard-odd-texts")
    by_set = same_id & (F.col("set_hi") == F.col("hi")) & (F.col("set_lo") == F.col("lo"))
    found = again.join(hint(pick.join(odd, is_odd, "left_semi")), by_set)
    first = found.groupBy(*fields).agg(F.first("text").alias("text")).select("text", *fields)
    return known.unionAll(first)


def jaccard_classes(docs: DataFrame, width: int = WIDTH, keys: bool = False, hot: int = HOT, block_entries: int = BLOCK_ENTRIES, mask: int = (1 << 64) - 1) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every document; links are Jaccard similarities of 0.75 or more.

    component_id is the smallest doc_id that links reach; n_links counts the other documents linked directly, copies
    included. With keys also hi and lo, the name of the document's shingle set (null without shingles), and root, which
    tells components apart even where doc_ids repeat. mask narrows the first half of names, to test how nodes that
    share it are told apart. The operator runs jobs and writes its steps to the shared folder.
    """
    spark = docs.sparkSession
    parts, sample = parallelism(spark), max(1, hot // 64)
    texts = docs.select("doc_id", "text")
    small_batches(spark)
    named = materialise(texts.mapInArrow(_names(width, sample, mask), _NAMES), "jaccard-names")
    full = named.where("kind = 0 AND n > 0")
    nodes = materialise(full.groupBy("hi", "lo").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("weight"), F.min("n").alias("n")), "jaccard-nodes")
    twice, salt = _numbering(nodes)
    node = _node(twice, salt)
    nodes = nodes.withColumn("node", node)

    blocks = max(parts, -(-(nodes.agg(F.sum("n")).first()[0] or 0) // block_entries))
    known = spark.sparkContext.broadcast(hot_columns(named, hot, sample))
    packed = _sorted_parts(texts.mapInArrow(_incidence(blocks, width, mask, twice, salt, known), _ROWS), blocks, parts)
    step1 = materialise(packed.mapInArrow(_shared_columns(blocks), _ROWS), "jaccard-columns")
    rare = _sorted_parts(step1.where("kind IN (1, 2)"), blocks, parts).mapInArrow(_rare_columns, _ROWS)
    edges = _sorted_parts(rare, blocks, parts).mapInArrow(_candidate_edges, "a bigint, b bigint")
    if len(known.value):
        heads = step1.where("kind = 4").select("a", "b")
        mins = heads.groupBy("a").agg(F.min("b").alias("m"))  # a row for each of up to MAX_HOT columns
        edges = edges.unionAll(step1.where("kind = 3").select("a", "b")).unionAll(heads.join(F.broadcast(mins), "a").select("b", "m"))
    # written down, so that both sides of the joins by root are plain shuffles, whose hot partitions Spark can split
    groups = connected_components(materialise(edges, "jaccard-candidates"), "jaccard-groups")
    wanted = nodes.join(groups, "node")
    sizes = wanted.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("entries"))
    few = F.least(F.ceil(F.col("size") / SMALL_NODES), F.lit(FEW_CUTS))
    cuts = F.greatest(few, F.ceil(F.col("size") / BLOCK_NODES), F.ceil(F.col("entries") / block_entries)).cast("long")
    sizes = materialise(sizes.select("root", F.least(cuts, "size").alias("cuts")), "jaccard-sizes")
    wanted = materialise(wanted.join(sizes, "root"), "jaccard-wanted")

    picked = _picked(texts, named, wanted, width, mask)
    sets = picked.mapInArrow(_sets(width, mask), "node bigint, weight bigint, root bigint, cuts bigint, lanes binary")
    cut = sets.withColumn("own", F.pmod(F.xxhash64("node"), F.col("cuts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") > low, 1).otherwise(F.when(low == high, 0).otherwise(-1))
    tasks = cut.select(F.concat_ws(":", "root", low, high).alias("task"), side.alias("side"), "node", "weight", "lanes")
    dealt = tasks.repartition(parts, "task").sortWithinPartitions("task")
    links = materialise(dealt.mapInArrow(_multiply, "node bigint, root bigint, links bigint"), "jaccard-links")
    if wanted.where("cuts > 1").isEmpty():
        roots = links
    else:
        counts = links.groupBy("node").agg(F.sum("links").alias("links"))
        reached = connected_components(links.selectExpr("node a", "root b"), "jaccard-reached")
        roots = counts.join(reached, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "links")
    smallest = materialise(roots.join(wanted.select("node", "first_id"), "node").groupBy("root").agg(F.min("first_id").alias("component")), "jaccard-components")
    key = ["root"] * keys
    linked = roots.join(smallest, "root").select("node", "component", "links", *key)
    classes = nodes.join(linked, "node", "left").where("weight > 1 OR links > 0")
    component, count = F.when(F.col("links") > 0, F.col("component")).otherwise(F.col("first_id")), F.coalesce("links", F.lit(0)) + F.col("weight") - 1
    many = materialise(classes.select("node", component.alias("component"), count.alias("links"), *key), "jaccard-classes")
    rows = named.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "hi", "lo", F.when(F.col("n") > 0, node).alias("node"))
    out = rows.join(many, "node", "left")
    more = [F.when(F.col("n_shingles") > 0, F.col(c)).alias(c) for c in ("hi", "lo")] + [F.coalesce("root", "node").alias("root")] if keys else []
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), *more)


def keep_first(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with one row of each component left: that with the smallest doc_id.

    Rows are told apart by doc_id and shingle set together, so rows that repeat a doc_id, or have none, each go with
    their own component. A null doc_id stays only where a component has no other; among such rows that with the
    smallest set name stays. Of rows with one doc_id and equal sets the smallest by all columns stays. Rows without
    shingles are linked to none and stay.
    """
    spark = docs.sparkSession
    classes = materialise(jaccard_classes(docs, width, keys=True), "jaccard-rows")
    mine = classes.where("hi IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hi", "lo")
    firsts = mine.groupBy("root").agg(F.min(order).alias("stay")).select("stay.doc_id", "stay.hi", "stay.lo")
    ids = classes.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("hi").alias("named"))
    # a doc_id of one row is enough to know the row by
    single = ids.where("doc_id IS NOT NULL AND n = 1")
    stay = firsts.join(single.where("named = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id")
    keep = materialise(stay.unionAll(single.where("named = 0").select("doc_id")), "jaccard-keep")
    pick = F.broadcast(keep) if keep.count() <= BROADCAST_IDS else keep
    out = docs.join(pick, "doc_id", "left_semi").select(*docs.columns)
    odd = materialise(ids.where("doc_id IS NULL OR n > 1").select(F.col("doc_id").alias("odd_id")), "jaccard-odd")
    if odd.isEmpty():
        return out
    # the other rows are known by their set, too
    small_batches(spark)
    held = [F.col(f"`{c}`").alias(f"docs_{i}") for i, c in enumerate(docs.columns)]
    back = [F.col(f"docs_{i}").alias(c) for i, c in enumerate(docs.columns)]
    again = docs.join(odd, F.col("doc_id").eqNullSafe(F.col("odd_id")), "left_semi").select("doc_id", _name_of(width)(F.col("text")).alias("name"), *held)
    want = materialise(firsts.join(odd, F.col("doc_id").eqNullSafe(F.col("odd_id")), "left_semi").select(F.col("doc_id").alias("want_id"), F.col("hi").alias("want_hi"), F.col("lo").alias("want_lo")), "jaccard-stay")
    known = again.where("name IS NOT NULL").select("doc_id", F.col("name.hi").alias("hi"), F.col("name.lo").alias("lo"), *(f"docs_{i}" for i in range(len(held))))
    same = F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.col("hi") == F.col("want_hi")) & (F.col("lo") == F.col("want_lo"))
    chosen = known.join(want, same, "left_semi").groupBy("doc_id", "hi", "lo").agg(F.min(F.struct(*(f"docs_{i}" for i in range(len(held))))).alias("row"))
    return out.unionAll(chosen.select("row.*").select(*back)).unionAll(again.where("name IS NULL").select(*back))
