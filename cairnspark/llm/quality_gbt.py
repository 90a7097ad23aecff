"""Quality rules: gradient-boosted trees over document statistics.

The statistics are counted in numpy over the bytes of many texts at once. The trees are grown here on a bounded
sample of labelled documents, with monotonic constraints on chosen features, and flattened into node arrays
(feature, threshold, left, right, value), which score all rows of a batch together, one tree level at a time.

Defined results: a null or empty text has no words and all counts 0, so the base rules reject it. A null doc_id stays
null. Repeated rows are scored each by itself. Without labelled rows of both classes there is no model, and the
verdict is that of the base rules. A sample too small to split gives trees of one leaf, and every document the share of
good ones in it. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm._common import small_batches, distinct_spans, text_slices
from cairnspark.llm.words import _SPACE, word_spans

#: Words that a document needs.
MIN_WORDS = 50
#: Most percent of the words that may stand in repeated windows.
MAX_REPEAT_PERCENT = 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"
#: Bound of the labelled rows that training may use (expected number; rows are picked by a hash of doc_id).
TRAIN_ROWS = 12_000
#: A document is kept at this chance of good quality, or more.
KEEP_AT = 0.35
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Name of each feature and the sign of its monotonic constraint on quality: -1 never rises with it, 0 free.
FEATURES = {
    "log_words": 0, "mean_word_chars": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
    "digit_share": 0, "bang_share": -1, "distinct_share": 0, "pipe_share": -1, "punct_share": 0, "mean_line_words": 0, "other_share": 0,
}

_IS = {}
for _name, _chars in {"symbol": SYMBOLS, "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "bang": "!?", "pipe": "|", "punct": ".,;:'\"()-", "line": "\n"}.items():
    _IS[_name] = np.zeros(256, bool)
    _IS[_name][[ord(c) for c in _chars]] = True
_IS["letter"] = np.zeros(256, bool)
_IS["letter"][[*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _again(text_no: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, later): whether a code occurs in its text at least twice, and whether it did before."""
    span = int(codes.max()) + 1 if len(codes) else 1
    # text numbers ascend, so a stable order by code inside them is all that is needed
    order = np.argsort(text_no * span + codes, kind="stable") if span < 1 << 40 else np.lexsort((codes, text_no))
    same = (codes[order][1:] == codes[order][:-1]) & (text_no[order][1:] == text_no[order][:-1])
    repeated, later = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    later[order[1:][same]] = True
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    return repeated, later


def _windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Codes of the windows of width codes: equal windows, equal codes, and no others."""
    n, out = len(codes) - width + 1, codes
    base = int(codes.max()) + 1 if len(codes) else 1
    for k in range(1, width):
        if int(out.max()) >= (1 << 62) // base:  # too large for another factor: numbered anew
            out = np.unique(out, return_inverse=True)[1]
        out = out[: len(codes) - k] * base + codes[k:]
    return out[:n]


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts and features of each text, from the UTF-8 bytes of all."""
    n = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    n_words = np.diff(first)
    word_no = np.repeat(np.arange(n), n_words)
    words = distinct_spans(data, starts, ends)[0]
    chars = ~_SPACE[data] & ((data & 0xC0) != 0x80)
    out = {"n_words": n_words, "word_chars": _per_text(chars, offsets), "n_symbols": _per_text(_IS["symbol"][data], offsets)}

    # lines: spans between line feeds and the ends of texts
    feeds = np.flatnonzero(_IS["line"][data])
    line_starts = np.union1d(offsets[:-1][offsets[:-1] < offsets[1:]], feeds + 1)
    line_starts = line_starts[line_starts < len(data)]
    line_no = np.searchsorted(offsets, line_starts, side="right") - 1
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), offsets[line_no + 1]) if len(line_starts) else line_starts
    if len(line_starts):
        line_ends = line_ends - (_IS["line"][data[np.maximum(line_ends - 1, 0)]] & (line_ends > line_starts))
        has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        line_starts, line_ends, line_no = line_starts[has_word], line_ends[has_word], line_no[has_word]
    _, later = _again(line_no, distinct_spans(data, line_starts, line_ends)[0])
    n_lines = np.bincount(line_no, minlength=n)
    out["n_dup_lines"] = np.bincount(line_no[later], minlength=n)

    # windows inside one text
    covered = np.zeros(len(words) + WINDOW, bool)
    if len(words) >= WINDOW:
        at = np.flatnonzero(word_no[: len(words) - WINDOW + 1] == word_no[WINDOW - 1 :])
        repeated, _ = _again(word_no[at], _windows(words, WINDOW)[at])
        for k in range(WINDOW):
            covered[at[repeated] + k] = True
    out["n_repeat_words"] = np.bincount(word_no[covered[: len(words)]], minlength=n)

    _, word_later = _again(word_no, words)
    n_bytes = np.maximum(np.diff(offsets), 1)
    safe_words, safe_chars = np.maximum(n_words, 1), np.maximum(out["word_chars"], 1)
    letters = _per_text(_IS["letter"][data], offsets)
    out["x"] = np.column_stack([
        np.log1p(n_words), out["word_chars"] / safe_words, out["n_symbols"] / safe_chars, out["n_dup_lines"] / np.maximum(n_lines, 1), out["n_repeat_words"] / safe_words,
        _per_text(_IS["upper"][data], offsets) / np.maximum(letters, 1), _per_text(_IS["digit"][data], offsets) / safe_chars, _per_text(_IS["bang"][data], offsets) / safe_words,
        1 - np.bincount(word_no[word_later], minlength=n) / safe_words, _per_text(_IS["pipe"][data], offsets) / safe_words, _per_text(_IS["punct"][data], offsets) / safe_words, n_words / np.maximum(n_lines, 1),
        1 - (letters + _per_text(_IS["digit"][data] | _IS["punct"][data] | _SPACE[data], offsets)) / n_bytes,
    ]).astype(np.float64)
    return out


@dataclass
class Trees:
    """Boosted trees as flat arrays; node 0 of tree t stands at roots[t], a leaf has feature -1 and points to itself."""

    bias: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    meta: dict = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                go_left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(f < 0, at, np.where(go_left, self.left[at], self.right[at]))
            out += self.value[at]
        return out

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, penalty: float = 1.0, min_rows: int = 10) -> Trees:
    """Fit boosted trees to 0/1 labels by second-order steps on binned features.

    A split on a feature with sign s is allowed only if s * (right value - left value) >= 0, and the values below either
    side are held on their side of the middle, so the whole sum is monotonic in that feature.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    margin = np.full(len(y), bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, len(left)), (right, len(right)), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(node())
        open_nodes = [(roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
        while open_nodes:
            at, rows, low, high, level = open_nodes.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[at] = float(np.clip(-gs / (hs + penalty), low, high)) * rate
            margin[rows] += value[at]
            if level == depth or len(rows) < 2 * min_rows:
                continue
            best = (1e-6, None)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, minlength=len(e) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                vl, vr = np.clip(-gl / (hl + penalty), low, high), np.clip(-(gs - gl) / (hs - hl + penalty), low, high)
                gain = -(gl * vl + 0.5 * (hl + penalty) * vl**2) - ((gs - gl) * vr + 0.5 * (hs - hl + penalty) * vr**2)
                gain -= gs * gs / (2 * (hs + penalty))
                gain[(nl < min_rows) | (len(rows) - nl < min_rows) | (signs[j] * (vr - vl) < 0)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, vl[k], vr[k]))
            if best[1] is None:
                continue
            j, k, vl, vr = best[1]
            margin[rows] -= value[at]
            feature[at], threshold[at] = j, float(edges[j][k])
            left[at], right[at] = node(), node()
            goes = binned[rows, j] <= k
            mid, s = (vl + vr) / 2, signs[j]
            ll, lh, rl, rh = low, high, low, high
            if s > 0:
                lh, rl = mid, mid
            elif s < 0:
                ll, rh = mid, mid
            open_nodes.append((left[at], rows[goes], ll, lh, level + 1))
            open_nodes.append((right[at], rows[~goes], rl, rh, level + 1))
    arrays = (np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value))
    return Trees(bias, *arrays, depth)


_STATS_DDL = "doc_id bigint, quality int, x array<double>"


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Trees | None:
    """Grow the trees on up to about max_rows labelled documents, picked by a hash of doc_id; None without two classes.

    Only the features of the picked rows (a few dozen numbers each) come to the driver: where rows repeat a doc_id, of its
    features the least in their order, so that it counts once.
    """
    from pyspark.sql import types as T

    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    n = known.count()
    if not n:
        return None
    chance = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    picked = known.where(chance < min(1.0, max_rows / n))
    # max_rows bounds the rows on this side, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text")
    small_batches(spark)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch, "text"):
                x = statistics(data, offsets)["x"]
                yield pa.record_batch({"doc_id": batch.column(0).slice(a, b - a), "quality": batch.column(1).slice(a, b - a), "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))})

    scored = rows.mapInArrow(score, T._parse_datatype_string(_STATS_DDL))
    found = scored.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toArrow()
    y = found.column("quality").to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    x = np.array(found.column("x").combine_chunks().flatten()).reshape(len(y), -1)
    order = np.lexsort((*x.T, y, found.column("doc_id").to_numpy()))  # the same trees whatever order the rows came in
    return grow(x[order], y[order].astype(float), list(FEATURES.values()))


def judge(docs: DataFrame, trees: Trees | None, keep_at: float = KEEP_AT, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, kept and quality_score of every document; carry names columns to keep beside.

    A carried column that is named like a new one gives way to it.
    """
    carry = [c for c in carry or [] if c.lower() not in (*COUNTS, "base_failed", "kept", "quality_score")]
    spark = docs.sparkSession
    small_batches(spark)
    kinds = dict(docs.dtypes)
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in dict.fromkeys(["doc_id", *carry])), *(f"{c} bigint" for c in COUNTS), "base_failed boolean, kept boolean, quality_score double"])
    names = list(dict.fromkeys(["doc_id", *carry]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch, "text"):
                s = statistics(data, offsets)
                failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
                score = trees.chance(s["x"]) if trees else np.ones(b - a)
                out = {c: batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in names}
                out |= {c: pa.array(s[c].astype(np.int64)) for c in COUNTS}
                yield pa.record_batch(out | {"base_failed": pa.array(failed), "kept": pa.array(~failed & (score >= keep_at)), "quality_score": pa.array(score)})

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, ddl)
