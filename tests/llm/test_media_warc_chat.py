"""Telephony audio, WARC chunks and chat formatting."""

import base64
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnspark.llm import chat_grammar, telephony, warc_chunks


def test_expansion_tables_have_the_known_values():
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    assert (mu[0xFF], mu[0x7F], mu[0x00], mu[0x80]) == (0, 0, -32124, 32124)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)


def _adpcm_one(block: bytes) -> list[int]:
    """One nibble after another."""
    value, index = int.from_bytes(block[:2], "little", signed=True), block[2]
    out, steps, moves = [value], telephony.step_sizes().tolist(), [-1, -1, -1, -1, 2, 4, 6, 8]
    for byte in block[4:]:
        for nib in (byte & 15, byte >> 4):
            step = steps[index]
            diff = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                diff += part if nib & bit else 0
            value = max(-32768, min(32767, value - diff if nib & 8 else value + diff))
            index = max(0, min(88, index + moves[nib & 7]))
            out.append(value)
    return out


def test_adpcm_blocks_decode_as_one_by_one():
    r = random.Random(3)
    blocks = [bytes([r.randrange(256), r.randrange(256), r.randrange(89), 0]) + r.randbytes(60) for _ in range(9)]
    got = telephony.decode_adpcm(np.array([list(b) for b in blocks], np.uint8))
    assert got.tolist() == [_adpcm_one(b) for b in blocks]


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=0, max_size=1500), st.sampled_from(telephony.CODECS))
def test_payloads_come_back_from_wav_files(data, codec):
    payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
    media = telephony.wav(codec, payload)
    assert telephony.payload_of(media) == payload
    assert int.from_bytes(media[4:8], "little") == len(media) - 8
    [(rate, samples)] = telephony.decode_media([media])
    assert rate == 8000 and len(samples) == (len(payload) if codec != "ima_adpcm" else len(payload) // 576 * 1153)


def test_resampling_keeps_a_tone():
    x = np.rint(12000 * np.sin(2 * np.pi * 440 * np.arange(4000) / 8000)).astype(np.int16)
    for to in (16000, 12000, 6000):
        y = telephony.resample(x, 8000, to)
        assert len(y) == -(-4000 * to // 8000)
        want = 12000 * np.sin(2 * np.pi * 440 * np.arange(len(y)) / to)
        assert np.abs(y[100:-100] - want[100:-100]).max() < 300
    assert len(telephony.resample(x[:0], 8000, 16000)) == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=1200), st.sampled_from(["any", "mulaw", "alaw"]), st.integers(1, 3), st.booleans())
def test_packed_pcm_comes_back_whatever_it_is(data, kind, up, resampled):
    x = np.frombuffer(data[: len(data) // 2 * 2], "<i2") if kind == "any" else telephony.law_table(kind)[np.frombuffer(data, np.uint8)]
    pcm = telephony.resample(x, 8000, 8000 * up) if resampled else x
    packed = telephony.pack_pcm(pcm, up)
    assert telephony.unpack_pcm(packed).tolist() == pcm.tolist()
    if resampled:  # nothing but the samples that were there before
        assert len(packed) <= telephony.PACKED.size + len(x) * (2 if kind == "any" else 1)


def test_stored_media_and_pcm_are_small_and_whole(spark, sf_dir, tmp_path):
    import os

    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet").where("length(text) > 0")
    media = telephony.write_media(docs, f"file://{tmp_path}/media", packed=True)
    stored = sum(os.path.getsize(f"{tmp_path}/media/{f}") for f in os.listdir(f"{tmp_path}/media") if f.endswith(".parquet"))
    text = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert stored < 1.5 * text  # raw PCM made it several times the text
    plain = telephony.to_pcm(media.drop("packed"))
    found, again, known = (sorted(telephony.media_digests(m).collect()) for m in (media, telephony.unpacked(media), plain))
    assert len(found) == docs.count() and found == again == known


def test_media_rows_match_brute_force(odd_docs, no_docs):
    got = telephony.media_digests(telephony.write_media(odd_docs)).collect()
    rows = odd_docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    want = []
    for r in rows:
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        media = telephony.wav(telephony.codec_for(payload), payload)
        want.append((r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest()))
    assert sorted(map(repr, (tuple(r)[:7] for r in got))) == sorted(map(repr, want))
    assert len({r.feature for r in got if r.payload_sha256 == got[0].payload_sha256}) == 1
    assert telephony.media_digests(telephony.write_media(no_docs)).count() == 0


def test_resampled_pcm_is_stored(spark, odd_docs, tmp_path):
    media = telephony.write_media(odd_docs.where("doc_id IN (1, 4, 10)"), f"file://{tmp_path}/media")
    rows = spark.read.parquet(f"file://{tmp_path}/media").collect()
    assert len(rows) == 3
    for r in rows:
        [(rate, x)] = telephony.decode_media([bytes(r.media)])
        assert np.array_equal(np.frombuffer(r.pcm, "<i2"), telephony.resample(x, rate, telephony.PCM_RATE))
    digests = {r.doc_id: r.feature for r in telephony.media_digests(media).collect()}
    assert all(digests[r.doc_id].endswith(f":{zlib.crc32(r.pcm):08x}") for r in rows)


def test_stored_pcm_is_the_resampled_audio(odd_docs):
    small = odd_docs.where("length(text) < 2000 OR text IS NULL")
    rows = telephony.to_pcm(telephony.store(small), 16000).collect()
    for r in rows:
        [(rate, x)] = telephony.decode_media([bytes(r.media)])
        assert np.array_equal(np.frombuffer(r.pcm, "<i2"), telephony.resample(x, rate, 16000))


def test_null_media_have_null_digests(spark):
    media = spark.createDataFrame([(1, None, None), (2, None, telephony.wav("mulaw", b"\xff" * 576))], "doc_id bigint, n_bytes bigint, media binary")
    rows = {r.doc_id: r for r in telephony.media_digests(telephony.to_pcm(media)).collect()}
    assert tuple(rows[1]) == (1, *[None] * 7) and rows[2].payload_bytes == 576 and rows[2].feature.startswith("mulaw:576:0:0:0:")


def _expand(code: int, law: str) -> int:
    """One sample, from the bit fields of its code."""
    if law == "mulaw":
        code ^= 0xFF
        size = ((2 * (code & 15) + 33) << (code >> 4 & 7)) - 33 << 2
        return -size if code & 0x80 else size
    code ^= 0x55
    exponent, mantissa = code >> 4 & 7, code & 15
    size = (2 * mantissa + 1 << 3) if exponent == 0 else (2 * mantissa + 33 << exponent + 2)
    return size if code & 0x80 else -size


def test_tables_are_the_formulas():
    assert telephony.mulaw_table().tolist() == [_expand(c, "mulaw") for c in range(256)]
    assert telephony.alaw_table().tolist() == [_expand(c, "alaw") for c in range(256)]


@pytest.mark.parametrize("to", [16000, 12000, 6000, 11025])
def test_resampling_is_a_sum_over_taps(to):
    r = random.Random(to)
    x = np.array([r.randint(-32768, 32767) for _ in range(90)], np.int16)
    up, down = (to // (g := __import__("math").gcd(8000, to))), 8000 // g
    taps = telephony._taps(up, down)
    half, want = taps.shape[1] // 2, []
    for m in range(-(-90 * up // down)):
        at, phase = divmod(m * down, up)
        total = sum(int(taps[phase, k]) * int(x[i]) for k in range(2 * half) if 0 <= (i := at + k - half + 1) < 90)
        want.append(max(-32768, min(32767, total + 8192 >> 14)))
    assert telephony.resample(x, 8000, to).tolist() == want


def test_features_match_brute_force(odd_docs):
    rows = telephony.media_digests(telephony.write_media(odd_docs.where("doc_id IN (1, 4, 5, 8, 10, 100, 101, 102)"))).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        codec = telephony.CODECS[zlib.crc32(payload) % 3]
        if codec == "ima_adpcm":
            x = [v for k in range(0, len(payload), 576) for v in _adpcm_one(bytes(4) + payload[k : k + 576])]
        else:
            x = [_expand(b, codec) for b in payload]
        pcm = telephony.resample(np.array(x, np.int16), 8000, 16000).astype("<i2").tobytes()
        flips = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        assert r.feature == f"{codec}:{len(x)}:{max(map(abs, x))}:{sum(v * v for v in x) // len(x)}:{flips}:{zlib.crc32(pcm):08x}"


PAGES = "page_id bigint, url string, html string, sha1 string"


def test_archives_come_back(spark):
    rows = [(3, "http://x/é y", "same", None), (1, "http://x/1", "same", None), (2, None, "same", None), (4, "http://x/4", None, None), (5, "u", "", None), (6, "u", "long" * 200_000, None), (None, "u", "same", None), (1, "http://x/1", "same", None), (7, "u", "WARC/1.1\r\n\r\nHTTP/1.1", None)]
    pages = spark.createDataFrame(rows, PAGES)
    got = sorted((tuple(r) for r in warc_chunks.archive_round_trip(pages).collect()), key=repr)
    first = {"same": 1, "": 4}
    want = []
    for i, _, html, _ in rows:
        h = (html or "").encode()
        ref = first.get(html or "")
        ref = None if ref is None or ref == i else ref
        want.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if ref is None else "revisit", ref))
    assert got == sorted(want, key=repr)
    assert warc_chunks.archive_round_trip(pages.limit(0)).count() == 0


def test_writers_get_chunks_and_chunk_tables_hold_payloads(spark):
    texts = {1: "é" * 700, 2: "", 3: "x" * 256, 4: "y" * 257, 5: "x" * 256}
    pages = spark.createDataFrame([(i, "u", t, None) for i, t in texts.items()], PAGES)
    planned = warc_chunks.plan_revisits(pages)
    rows = warc_chunks.payload_chunks(planned, 256).collect()
    assert max(len(r.chunk or b"") for r in rows) == 256 and sum(r.page_id == 1 for r in rows) == 6
    table = warc_chunks.read_chunks(warc_chunks.write_archives(planned, chunk_bytes=256), chunk_bytes=100).collect()
    for i, t in texts.items():
        mine = sorted((r for r in table if r.page_id == i), key=lambda r: r.chunk_no)
        assert b"".join(bytes(r.payload or b"") for r in mine) == (b"" if i == 5 else t.encode())
        assert mine[-1].is_last and mine[-1].digest_so_far == base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()


def test_chunks_carry_running_digests():
    payload = bytes(range(256)) * 5
    data = gzip.compress(b"".join(warc_chunks.record_parts(9, "http://a", payload, None))) + gzip.compress(b"".join(warc_chunks.record_parts(10, None, payload, 9))) + gzip.compress(b"".join(warc_chunks.record_parts(11, "b", b"", None)))
    rows = list(warc_chunks.read_records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))), chunk_bytes=100))
    mine = [r for r in rows if r[2] == 9]
    assert b"".join(r[8] for r in mine) == payload and [r[1] for r in mine] == list(range(13)) and max(r[7] for r in mine) == 100
    for r in mine:
        assert r[9] == base64.b32encode(hashlib.sha1(payload[: r[6] + r[7]]).digest()).decode()
    assert [r[10] for r in mine] == [False] * 12 + [True]
    assert [(r[3], r[5], r[11]) for r in rows if r[2] == 10] == [("revisit", 9, len(payload))]
    assert [(r[7], r[10]) for r in rows if r[2] == 11] == [(0, True)]


def test_a_damaged_record_is_an_error():
    data = b"".join(warc_chunks.record_parts(9, "http://a", b"payload", None))
    with pytest.raises(ValueError):
        list(warc_chunks.read_records(io.BytesIO(data.replace(b"payload", b"paYload"))))
    with pytest.raises(ValueError):
        list(warc_chunks.read_records(io.BytesIO(data[:-8])))


NASTY = ["", "\\", "\\\\", "\\h", "\\e\\", "###", "####", "</turn>", "</turn>\n", "### assistant: x</turn>\n### user: y", "a\\</turn>\\", "\\### Assistant: </turn> ok", "C:\\dir\\new", "line\n\n", ": :", "\\\\h\\h", "##", "#", "é日🙂", "x</turn"]
CHATS = "conv_id bigint, turn bigint, role string, text string, formatted string"


def test_chats_come_back(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system", "a: b", "x:", "\\c", "###", "n\n", None]), r.choice([*NASTY, None]), "f") for c in range(60) for t in range(r.randint(1, 6))]
    rows += [(None, None, None, None, "f"), (None, 1, "assistant", "hi", "f"), (7, 0, "user", "tie", "f"), (7, 0, "user", "tie", "f"), (500, 0, "assistant", "word " * 40_000, "f")]
    df = spark.createDataFrame(rows, CHATS)
    got = {x.conv_id: x for x in chat_grammar.read_back(chat_grammar.format_chats(df)).collect()}
    by: dict = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        said, loss = "".join(f"{a}\n{b}\n" for _, a, b in turns), "".join(b for _, a, b in turns if a == "assistant")
        x = got[c]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()), (c, turns)
    assert chat_grammar.read_back(chat_grammar.format_chats(df.limit(0))).count() == 0


def test_control_strings_only_stand_where_the_template_puts_them(spark):
    df = chat_grammar.with_hard_case(spark, spark.createDataFrame([(1, 0, "user", "plain", "f")], CHATS))
    rows = {r.conv_id: r for r in chat_grammar.format_chats(df).collect()}
    assert rows[1].formatted == "### user: plain</turn>\n"
    assert rows[-7].formatted.count("</turn>") == 2 and rows[-7].formatted.count("###") == 2
    [span] = rows[-7].loss_spans
    back = df.sparkSession.range(1).select(chat_grammar.unescape(F.lit(rows[-7].formatted[span.start : span.start + span.length]))).first()[0]
    assert back == chat_grammar.HARD_CASE
