"""Batched BPE, shards of token ids, token rollups."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnspark.llm import bpe_batch, pieces, repair_ids, token_rollup

PATH = pieces.default_path()
ODD = [
    "", "'s", "don't we'll I'VE they'red x'", "''s '' 'S !'s", "a'tb 'l 'lla", "x²³ ¼½ 123 4.5", "ΑΒΣ ΟΔΟΣ İstanbul", "é\u0301a  b\x1cq\x85z", "<|endoftext|> hi <|startoftext|>é<|", "日本語 テスト 한국어", "aaaaaaa aaaa lllllll",
    "🙂 emoji 👍🏽", "ﬁ ﬂ ™ € “q” ‘s ’s", "Œuvre Ǆ ß ẞ", "  \n\n\t ", "naïve café ÀÉÎ õ", "'ll'll'll", "_a_b __ a1b2", "\u00a0x\u3000y", "A\u030a n\u0303",
]


def _library(text: str) -> list[int]:
    return pieces.tokenizer(PATH).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("make", [bpe_batch.batch_encoder, pieces.library_encoder])
def test_ids_are_the_librarys(make):
    enc = make(PATH)
    ids, offsets = enc.encode([*ODD, None])
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [*map(_library, ODD), []]


@pytest.mark.parametrize("make", [bpe_batch.batch_encoder, pieces.library_encoder])
def test_pieces_that_polynomial_hashes_confuse(make):
    word = lambda n, ab: "".join(ab[i.bit_count() & 1] for i in range(n))
    texts = [word(n, ab) + end for n in (1024, 4096) for ab in ("ab", "ba") for end in ("", " “x”")]
    ids, offsets = make(PATH).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [*map(_library, texts)]


def test_pieces_that_share_half_a_name(monkeypatch):
    real = pieces.span_names
    monkeypatch.setattr(pieces, "span_names", lambda *a: real(*a) & np.array([[3], [0xFFFFFFFFFFFFFFFF]], np.uint64))
    enc = pieces.PieceEncoder(PATH, bpe_batch.batch_encoder(PATH).encode_pieces, bpe_batch.batch_encoder(PATH).encode_text)
    for _ in range(2):
        texts = [f"word{i} and thing{i % 3}" for i in range(50)]
        ids, offsets = enc.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [*map(_library, texts)]


def test_other_tokenizer_files():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, texts = pieces.tokenizer(path), ["Hello there,  it's 12 o'clock", "Ünï 日本\n\nx", "", "aB <|endoftext|> c"]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for make in (bpe_batch.batch_encoder, pieces.library_encoder):
        ids, offsets = make(path).encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == want
    assert [bpe_batch.decode_ids(np.array(w), path) for w in want] == [tok.decode(w, skip_special_tokens=False) for w in want]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abé'st lL\n1²!<|ΣßÀ’…_\u0301") | st.characters(codec="utf-8"), max_size=30), max_size=4))
def test_any_text_encodes_and_decodes_as_the_library_does(texts):
    ids, offsets = bpe_batch.batch_encoder(PATH).encode(texts)
    for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        assert ids[a:b].tolist() == _library(t)
        assert bpe_batch.decode_ids(ids[a:b], PATH) == pieces.tokenizer(PATH).decode(_library(t), skip_special_tokens=False)


def test_the_table_of_pieces_may_start_anew(monkeypatch):
    monkeypatch.setattr(pieces, "KEEP_PIECES", 3)
    monkeypatch.setattr(pieces, "JOIN_CHARS", 20)
    enc = pieces.PieceEncoder(PATH, bpe_batch.batch_encoder(PATH).encode_pieces, bpe_batch.batch_encoder(PATH).encode_text)
    texts = [f"word{i} and thing{i % 3}" for i in range(50)]
    ids, offsets = enc.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [*map(_library, texts)]


def test_round_trip_rows(odd_docs, no_docs):
    got = sorted(map(repr, (tuple(r) for r in bpe_batch.round_trip(odd_docs).collect())))
    tok, want = pieces.tokenizer(PATH), []
    for r in odd_docs.select("doc_id", "text").collect():
        ids = _library(r.text or "")
        text = tok.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(map(repr, want))
    assert bpe_batch.round_trip(no_docs).count() == 0
    some = odd_docs.where("doc_id < 11 AND length(text) < 2000")
    back = {r.doc_id: r.text for r in bpe_batch.decode(bpe_batch.encode(some)).collect()}
    assert back[8] == tok.decode(_library("two words"), skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6) | st.integers(0, 49407), max_size=80), min_size=1, max_size=8), st.integers(1, 6))
def test_shards_come_back(docs, times):
    docs = [np.array(d * times + [2], np.uint32) for d in docs]
    ids, lengths = np.concatenate(docs), np.array([len(d) for d in docs])
    names = [None, *range(len(docs) - 1)]
    shard = repair_ids.Shard.of(repair_ids.encode_shard(names, ids, lengths))
    assert shard.doc_ids == names
    for k, d in enumerate(docs):
        assert np.array_equal(shard.document(k), d)
        a = len(d) // 3
        assert np.array_equal(shard.window(k, a, len(d)), d[a:])
    assert np.array_equal(shard.expansion_lengths, shard.table.length)
    assert all(np.array_equal(a, b) for a, b in zip(shard.documents(0, len(docs)), docs, strict=True)) and shard.documents(1, 1) == []


def test_repeats_shrink_and_rules_expand():
    ids = np.tile(np.arange(50, dtype=np.uint32), 2000)
    shard = repair_ids.Shard.of(repair_ids.encode_shard([1], ids, np.array([len(ids)])))
    assert shard.n_symbols < len(ids) / 1000 and np.array_equal(shard.document(0), ids)
    assert np.array_equal(shard.window(0, 777, 791), ids[777:791])


def _most_frequent(symbols, last) -> int:
    """The count of the most frequent pair inside documents, each counted from the left without overlaps."""
    best: dict = {}
    doc: list = []
    for x, end in zip(symbols, last):
        doc.append(int(x))
        if end:
            seen: dict = {}
            for k, pair in enumerate(zip(doc, doc[1:])):
                if seen.get(pair) != k - 1:
                    best[pair], seen[pair] = best.get(pair, 0) + 1, k
            doc = []
    return max(best.values(), default=0)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=200), min_size=1, max_size=6), st.integers(2, 9))
def test_no_frequent_pair_is_left(docs, least):
    ids, lengths = np.concatenate([np.array(d) for d in docs]), np.array([len(d) for d in docs])
    last = np.zeros(len(ids), bool)
    last[np.cumsum(lengths) - 1] = True
    seq, ends, rules = repair_ids.grammar(ids, last, least)
    assert _most_frequent(seq, ends) < least and ends.sum() == len(docs)
    assert np.array_equal(repair_ids.expansions(rules, int(ids.max()) + 1).expand(seq), ids)
    # no rule is used less often than it takes to be one
    used = np.bincount(np.concatenate([seq, *[r.ravel() for r in rules]]).astype(int))
    assert not rules or used[int(ids.max()) + 1 :].min() > 0


def test_ids_of_any_size():
    ids = np.array([70_000, 5, (1 << 31) - 1, 65_536] * 300)
    shard = repair_ids.Shard.of(repair_ids.encode_shard([4], ids, np.array([len(ids)])))
    assert np.array_equal(shard.document(0), ids) and np.array_equal(shard.window(0, 501, 777), ids[501:777])
    for bad in (-1, 1 << 31):
        with pytest.raises(ValueError):
            repair_ids.encode_shard([4], np.array([3, bad]), np.array([2]))


def test_a_document_is_read_from_its_own_blocks():
    r = np.random.default_rng(8)
    docs = [r.integers(0, 60_000, 3000) for _ in range(40)]
    data = repair_ids.encode_shard(list(range(40)), np.concatenate(docs), np.array([3000] * 40))
    shard = repair_ids.Shard.of(data)
    assert np.array_equal(shard.document(17), docs[17]) and shard.blocks_read <= 2 < len(shard.block_at) - 1


def test_shards_are_in_order(odd_docs, no_docs):
    manifest = repair_ids.write_shards(odd_docs, shard_ids=500)
    assert manifest.count() > 4
    rows = repair_ids.read_shards(manifest).collect()
    source = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in odd_docs.select("doc_id", "text").collect()))
    at, want = 0, []
    for there, i, _, text in source:
        ids = [*_library(text), 2]
        want.append((i if there else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(rows, key=lambda r: r.start)[0].start == 0
    assert [tuple(r)[:4] for r in sorted(rows, key=lambda r: r.start)] == want
    assert repair_ids.shard_digests(no_docs).count() == 0


def test_rollup_commits_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", 3), ("a", "en", 4), (None, "de", 5), ("b", None, None)], "source string, lang string, n_tokens bigint")
    r = token_rollup.Rollup(spark, f"file://{tmp_path}/rollup")
    assert r.totals().count() == 0
    assert r.apply("one", token_rollup.inserts(rows, "v1")) and not r.apply("one", token_rollup.inserts(rows, "v1"))
    key = lambda df: {(x.source, x.lang, x.tokenizer): (x.docs, x.tokens) for x in df.collect()}
    assert key(r.totals()) == {("a", "en", "v1"): (2, 7), (None, "de", "v1"): (1, 5), ("b", None, "v1"): (1, 0)}
    assert r.apply("two", token_rollup.revisions(rows.withColumn("new", F.col("n_tokens") + 10), "v1", "n_tokens", "new"))
    assert r.apply("three", token_rollup.deletes(rows.where("source IS NULL").withColumn("n_tokens", F.lit(15)), "v1"))
    assert key(r.totals()) == {("a", "en", "v1"): (2, 27), ("b", None, "v1"): (1, 0)}
    with pytest.raises(ValueError):
        r.apply("a/b", token_rollup.inserts(rows, "v1"))
    before = key(r.totals())
    assert r.compact() and not r.compact() and key(r.totals()) == before
    assert not r.apply("two", token_rollup.inserts(rows, "v1"))  # folded in, and still known
    assert r.apply("four", token_rollup.inserts(rows.where("source = 'b'"), "v1"))
    assert key(r.totals()) == {**before, ("b", None, "v1"): (2, 0)} and r.compact() and key(r.totals()) == {**before, ("b", None, "v1"): (2, 0)}
    assert len(r.committed()) == 4 and r._snapshot()[1] == {"one", "two", "three", "four"}


def test_a_rename_onto_a_committed_batch_fails(spark, tmp_path):
    r = token_rollup.Rollup(spark, f"file://{tmp_path}/rollup")
    for name in ("x", "y"):
        spark.range(1).write.parquet(f"file://{tmp_path}/rollup/aside/{name}")
    assert r._move(f"{r.folder}/aside/x", f"{r.folder}/batches/batch-1") and not r._move(f"{r.folder}/aside/y", f"{r.folder}/batches/batch-1")


def test_corpus_rollup_matches_brute_force(odd_docs, no_docs):
    got = {(x.source, x.lang, x.tokenizer): (x.docs, x.tokens) for x in token_rollup.corpus_token_rollup(odd_docs).collect()}
    rows = odd_docs.select("doc_id", "text", "source", "lang").collect()
    low: dict = {}
    for r in rows:
        if r.doc_id is not None:
            low[r.text or ""] = min(low.get(r.text or "", r.doc_id), r.doc_id)
    want: dict = {}
    for r in rows:
        if r.doc_id is not None and r.doc_id > low[r.text or ""]:
            continue
        for v, n in (("word_bpe_49k", len(_library(r.text or "")) + 1), ("utf8_bytes", len((r.text or "").encode()))):
            d, t = want.get((r.source, r.lang, v), (0, 0))
            want[r.source, r.lang, v] = (d + 1, t + n)
    assert got == want
    assert token_rollup.corpus_token_rollup(no_docs).count() == 0
    random.seed(0)
