"""Words of UTF-8 texts as arrays: white space is the space and the bytes 9 to 13, all else belongs to words.

Everything works on the bytes of many texts at once; no word becomes a Python string.
"""

from __future__ import annotations

import numpy as np

from cairnspark.llm._common import mix64, span_names

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): spans of the words of all texts, and the number of words before each text."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    # a word also ends where its text ends
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] |= inside[cuts]
    stops[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Odd multipliers of the two lanes of a window's name.
_STEP = np.array([[0xD6E8FEB86659FD93], [0xA24BAED4963EE407]], np.uint64)


def _fold(lanes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Names of word sequences with one more word at their ends."""
    h = (lanes ^ word) * _STEP
    return h ^ (h >> np.uint64(32))


def window_names(words: np.ndarray, width: int) -> np.ndarray:
    """128-bit names of the windows of width words that begin at each word, as far as there are width words."""
    n = max(0, words.shape[1] - width + 1)
    h = np.full((2, n), width, np.uint64)
    for k in range(width):
        h = _fold(h, words[:, k : k + n])
    return mix64(h)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The distinct word shingles of each text as 128-bit names (two rows of lanes), sorted by the first lane.

    Shorter texts have their whole word sequence as one.
    """
    low = lower_ascii(data)
    starts, ends, first = word_spans(low, offsets)
    words = span_names(low, starts, ends)
    windows = window_names(words, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(_distinct(windows[:, a : b - width + 1]))
        elif b > a:
            out.append(window_names(words[:, a:b], b - a))
        else:
            out.append(np.zeros((2, 0), np.uint64))
    return out


def _distinct(names: np.ndarray) -> np.ndarray:
    order = np.argsort(names[0], kind="stable")
    names = names[:, order]
    same = names[0, 1:] == names[0, :-1]
    if not same.any():
        return names
    if (names[1, 1:] != names[1, :-1])[same].any():  # one first lane, several second ones
        names = names[:, np.lexsort(names[::-1])]
        same = (names[:, 1:] == names[:, :-1]).all(0)
    return names[:, np.concatenate([[True], ~same])]
