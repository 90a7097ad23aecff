"""Pieces of texts for byte-pair encoding, cut in numpy, each distinct piece encoded once.

The tokenizer file's normaliser (NFC, white space to spaces, lower case) and split pattern are followed on arrays of
characters for texts made of common Latin characters, for which both are known to be the same in every Unicode version.
Any other text, and any text that spells a special token, is cut by the tokenizers library itself, one by one; so are
all texts if the file names another normaliser or split pattern.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from cairnspark.llm._common import span_names

#: Distinct pieces that a worker keeps; beyond it the table starts anew.
KEEP_PIECES = 1_200_000
_SLOT_BITS = 19
#: Characters that are joined and cut at once.
JOIN_CHARS = 512 << 10
#: New pieces that the library encodes as one text.
JOIN_PIECES = 200

#: Ranges of characters that stay what they are under NFC and whose case and class no Unicode version changes.
_PLAIN = "\t\n\x0b\x0c\r\x20-\x7e\xa1-\xffŒœ‐-―‘-‟†-•…€™"
_OTHER_CHAR = re.compile(f"[^{_PLAIN}]")
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


@lru_cache(1)
def _classes() -> np.ndarray:
    import unicodedata

    out = np.full(0x2200, _OTHER, np.uint8)
    for c in range(len(out)):
        kind = unicodedata.category(chr(c))[0]
        out[c] = _SPACE if chr(c) in "\t\n\x0b\x0c\r " else {"L": _LETTER, "N": _NUMBER}.get(kind, _OTHER)
    return out


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(2)
def tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@lru_cache(2)
def specials(path: str) -> tuple[dict[str, int], re.Pattern | None]:
    with open(path, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    pattern = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
    return added, pattern


#: The normaliser and the pre-tokeniser that cut() follows, as the tokenizer file names them.
_NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


@lru_cache(2)
def cuts_here(path: str) -> bool:
    """Whether cut() gives the pieces of this tokenizer file."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    split = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    byte_level = split[-1].get("type") == "ByteLevel" and not split[-1].get("add_prefix_space") and split[-1].get("use_regex") is False
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in file["added_tokens"])
    return file.get("normalizer") == _NORMALISER and split[:-1] == [_SPLIT] and byte_level and plain


def cut(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pieces of lower-case characters: contractions, runs of letters, single numbers, runs of others."""
    kind = np.zeros(len(codes) + 4, np.uint8)
    kind[: len(codes)] = _classes()[codes]
    before = np.zeros(len(kind), np.uint8)
    before[1:] = kind[:-1]
    begins = (kind != _SPACE) & ((kind != before) | (kind == _NUMBER))
    at = np.flatnonzero((codes == 39) & begins[: len(codes)] & (kind[1 : len(codes) + 1] == _LETTER))
    if len(at):
        padded = np.concatenate([codes, np.zeros(4, codes.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for hit, width in ((short, 2), (long & ~short, 3)):
            a = at[hit]
            begins[a + 1] = False
            begins[a + width] |= kind[a + width] == _LETTER
    starts = np.flatnonzero(begins)
    # a piece ends at the next start or space
    stop = begins | (kind == _SPACE)
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, side="right")] if len(starts) else starts
    return starts, ends


class PieceEncoder:
    """Texts to token ids. encode_pieces gets distinct lower-case pieces and gives all their ids and how many each has;
    encode_text gets a text that must not be cut here."""

    def __init__(self, path: str, encode_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], encode_text: Callable[[str], np.ndarray]):
        self.encode_pieces, self.encode_text = encode_pieces, encode_text
        self.special, self.cuts = specials(path)[1], cuts_here(path)
        self._clear()

    def _clear(self) -> None:
        # a table of the pieces met last, and below it all pieces, sorted by the first lane of their names
        self.slot_name, self.slot_at = np.zeros((2, 1 << _SLOT_BITS), np.uint64), np.full(1 << _SLOT_BITS, -1, np.int32)
        self.names, self.places = np.zeros((2, 0), np.uint64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        total, n = len(ids), len(lengths)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + total] = ids
        self.start[self.count : self.count + n] = self.used + np.cumsum(lengths) - lengths
        self.length[self.count : self.count + n] = lengths
        self.used, self.count = self.used + total, self.count + n

    def _places(self, names: np.ndarray, text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the ids of each piece stand. names are 128 bits wide, and both halves are compared."""
        slot = (names[0] >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        at = self.slot_at[slot].astype(np.int64)
        miss = np.flatnonzero((self.slot_name[:, slot] != names).any(0) | (at < 0))
        while len(miss):
            _, first, back = np.unique(names[0, miss], return_index=True, return_inverse=True)
            first = miss[first]
            mine = names[1, first][back] == names[1, miss]
            found = self._find(names[:, first], text, starts[first], ends[first])
            self.slot_name[:, slot[first]], self.slot_at[slot[first]] = names[:, first], found
            at[miss[mine]] = found[back[mine]]
            miss = miss[~mine]  # other pieces with the same first half
        return at

    def _find(self, names: np.ndarray, text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of pieces whose first halves differ and ascend; new pieces are encoded and added."""
        near = np.searchsorted(self.names[0], names[0])
        found, taken = np.full(names.shape[1], -1, np.int64), np.zeros(names.shape[1], bool)
        inside = np.flatnonzero(near < self.names.shape[1])
        inside = inside[self.names[0, near[inside]] == names[0, inside]]
        taken[inside] = True
        same = inside[self.names[1, near[inside]] == names[1, inside]]
        found[same] = self.places[near[same]]
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = self.count + np.arange(len(new))
            self._add(*self.encode_pieces([text[i:j] for i, j in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]))
            new = new[~taken[new]]  # the first half of another piece is taken: not kept, so encoded again when it comes again
            self.names = np.insert(self.names, near[new], names[:, new], axis=1)
            self.places = np.insert(self.places, near[new], found[new].astype(np.int32))
        return found

    def _joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each text) of plain texts."""
        if self.count > KEEP_PIECES:
            self._clear()
        low = "\n".join(texts).lower()
        try:
            codes = np.frombuffer(low.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            codes = np.frombuffer(low.encode("utf-32-le"), np.uint32)
        starts, ends = cut(codes)
        at = self._places(span_names(codes, starts, ends), low, starts, ends)
        lengths = self.length[at]
        total = np.cumsum(lengths)
        n = int(total[-1]) if len(total) else 0
        ids = self.flat[np.repeat(self.start[at] - (total - lengths), lengths) + np.arange(n)]
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        sums = np.concatenate([[0], total])
        return ids, np.diff(sums[np.searchsorted(starts, bounds)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all texts one after another, and where each text's begin; null counts as empty."""
        texts = [t or "" for t in texts]
        out: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        run, chars = [], 0

        def flush() -> None:
            nonlocal run, chars
            if run:
                ids, n = self._joined(run)
                out.append(ids)
                counts.append(n)
                run, chars = [], 0

        for t in texts:
            if not self.cuts or _OTHER_CHAR.search(t) or (self.special and "<|" in t and self.special.search(t)):
                flush()
                ids = self.encode_text(t)
                out.append(ids)
                counts.append(np.array([len(ids)], np.int64))
                continue
            if run and chars + len(t) > JOIN_CHARS:
                flush()
            run.append(t)
            chars += len(t) + 1
        flush()
        ids = np.concatenate(out).astype(np.uint32, copy=False) if out else np.zeros(0, np.uint32)
        return ids, np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64) if counts else np.zeros(1, np.int64)


@lru_cache(2)
def library_encoder(path: str) -> PieceEncoder:
    """An encoder whose ids all come from the tokenizers library."""
    tok = tokenizer(path)
    with open(path, encoding="utf-8") as f:
        suffix = json.load(f)["model"].get("end_of_word_suffix")
    ends = np.zeros(tok.get_vocab_size(), bool)
    ends[[i for s, i in tok.get_vocab().items() if suffix and s.endswith(suffix)]] = True

    def pieces(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many pieces as one text, with blanks between: the ids that end words tell them apart again."""
        ids, lengths = [], []
        runs = [new[i : i + JOIN_PIECES] for i in range(0, len(new), JOIN_PIECES)]
        for run, e in zip(runs, tok.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
            found = np.array(e.ids, np.uint32)
            last = np.flatnonzero(ends[found])
            if len(last) != len(run) or last[-1] != len(found) - 1:  # not so: one by one
                each = [np.array(x.ids, np.uint32) for x in tok.encode_batch_fast(run, add_special_tokens=False)]
                found, last = np.concatenate(each), np.cumsum([len(x) for x in each]) - 1
            ids.append(found)
            lengths.append(np.diff(last, prepend=-1))
        return np.concatenate(ids), np.concatenate(lengths)

    return PieceEncoder(path, pieces, lambda t: np.array(tok.encode(t, add_special_tokens=False).ids, np.uint32))
