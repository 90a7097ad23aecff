"""BPE encoding and decoding: batched numpy merge rounds.

The symbols of many pieces stand in one flat array. In each round the ranks of all neighbouring pairs are found by
binary search over the sorted pair keys of the merge table; every piece merges its lowest-ranked pair (all places of it,
from the left), until no piece has a pair left. Pieces are distinct, and each is encoded once a worker.

Defined results: a null or empty text has no ids, and decodes to the empty string. Repeated rows give equal rows.
Ids that the vocabulary lacks are left out by decoding, as the tokenizers library does. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairnspark.llm._common import small_batches
from cairnspark.llm.pieces import PieceEncoder, default_path, specials, tokenizer

_NONE = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the other bytes for the characters from 256 on, in order.
    """
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class MergeTable:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, split = file["model"], (file.get("pre_tokenizer") or {}).get("pretokenizers") or [file.get("pre_tokenizer") or {}]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or odd or split[-1].get("type") != "ByteLevel":
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer: {odd or model.get('type')}")
        self.decoder = file.get("decoder")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.size = max([*self.vocab.values(), *(t["id"] for t in file["added_tokens"])]) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([self.vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.into = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.symbols = byte_symbols()
        self.inside = {c: self.vocab[c] for c in self.symbols if c in self.vocab}
        self.last = {c: self.vocab[c + self.end] for c in self.symbols if c + self.end in self.vocab}
        self.byte_to_symbol = {b: c for b, c in enumerate(self.symbols)}
        self.strings: list[str | None] = [None] * self.size
        for s, i in [*self.vocab.items(), *((t["content"], t["id"]) for t in file["added_tokens"])]:
            self.strings[i] = s

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pieces that are spelt in byte symbols, all pieces in the same rounds, and how many each has."""
        flat = [t for p in pieces if p for t in (*map(self.inside.__getitem__, p[:-1]), self.last[p[-1]])]
        sizes = np.array([len(p) for p in pieces], np.int64)
        symbol, word = np.array(flat, np.int64), np.repeat(np.arange(len(pieces)), sizes)
        done_symbol, done_word = [], []
        while len(symbol):
            rank = np.full(len(symbol), _NONE)
            rank[:-1] = self.ranks(symbol[:-1], symbol[1:])
            rank[:-1][word[:-1] != word[1:]] = _NONE
            starts = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
            best = np.minimum.reduceat(rank, starts)
            best_of = np.repeat(best, np.diff(np.append(starts, len(word))))
            open_ = best_of < _NONE
            if not open_.all():
                done_symbol.append(symbol[~open_])
                done_word.append(word[~open_])
                symbol, word, rank, best_of = symbol[open_], word[open_], rank[open_], best_of[open_]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == best_of)
            # x x x: the second pair overlaps the first; of a run of places every other one merges
            k = np.arange(len(at))
            new_run = np.ones(len(at), bool)
            new_run[1:] = at[1:] != at[:-1] + 1
            at = at[(k - np.maximum.accumulate(np.where(new_run, k, 0))) % 2 == 0]
            symbol[at] = self.into[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, word = symbol[keep], word[keep]
        symbol, word = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_symbol, done_word))
        order = np.argsort(word, kind="stable")
        return symbol[order].astype(np.uint32), np.bincount(word, minlength=len(pieces))

    def spell(self, piece: str) -> str:
        return "".join(map(self.byte_to_symbol.__getitem__, piece.encode("utf-8")))


@lru_cache(2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


@lru_cache(2)
def batch_encoder(path: str) -> PieceEncoder:
    """An encoder whose ids all come from the merge rounds; the library only cuts texts of rare characters."""
    table = merge_table(path)
    added, pattern = specials(path)

    def text(t: str) -> np.ndarray:
        tok, out = tokenizer(path), []
        for part in pattern.split(t) if pattern else [t]:
            if part in added:
                out.append(np.array([added[part]], np.uint32))
            elif part:
                clean = tok.normalizer.normalize_str(part) if tok.normalizer else part
                out.append(table.merge([p for p, _ in tok.pre_tokenizer.pre_tokenize_str(clean) if p])[0])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    return PieceEncoder(path, lambda new: table.merge([table.spell(p) for p in new]), text)


def decode_ids(ids: np.ndarray, path: str) -> str:
    """The text of ids: their strings with spaces between where the file names no decoder, else as the library decodes."""
    if merge_table(path).decoder is not None:
        return tokenizer(path).decode(ids.tolist(), skip_special_tokens=False)
    strings = merge_table(path).strings
    return " ".join([s for s in map(strings.__getitem__, ids.tolist()) if s is not None])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""
    path = path or default_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = batch_encoder(path)
        for batch in batches:
            ids, offsets = enc.encode(batch.column(1).to_pylist())
            yield pa.record_batch({"doc_id": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids count as none."""
    path = path or default_path()
    small_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = merge_table(path).size
        for batch in batches:
            rows = [np.array([i for i in (x or []) if i is not None and 0 <= i < size], np.int64) for x in batch.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0), "text": pa.array([decode_ids(x, path) for x in rows], pa.string())})

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, encoded and decoded in one pass."""
    path = path or default_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = batch_encoder(path)
        for batch in batches:
            ids, offsets = enc.encode(batch.column(1).to_pylist())
            each = [ids[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.record_batch({
                "doc_id": batch.column(0),
                "n_tokens": pa.array(np.diff(offsets)),
                "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(decode_ids(x, path).encode()).hexdigest() for x in each], pa.string()),
            })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
