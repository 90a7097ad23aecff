"""Media columns: telephony audio. Mu-law, A-law and IMA ADPCM in WAV containers, decoded to 16-bit PCM and resampled.

Mu-law and A-law expand by 256-entry tables built from their formulas. ADPCM is sequential inside a block but not
between blocks, so numpy decodes the k-th nibble of all blocks of a batch together. Resampling is a polyphase filter
with integer taps: the same samples on every machine.

Defined results: a null or empty text has a payload of 576 filler bytes. Null media decode to null: their PCM and all
their digests are null, and PCM that is null has a null feature. Media that are no such WAV file raise an error. Equal texts give equal rows. Other columns are left out.

PCM is stored as it is or packed without loss (pack_pcm): a packed value alone gives all its samples back, whatever they are.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm._common import small_batches, scratch, text_slices

#: Payloads are filled up with FILL to a positive multiple of UNIT bytes.
UNIT, FILL = 576, 0xFF
RATE, PCM_RATE = 8000, 16000
#: WAV format tags, fixed by the format.
TAGS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 0x11}
CODECS = ("mulaw", "alaw", "ima_adpcm")
#: Packed PCM begins with its number of samples, which of them are kept, and their form: codes of a law, or samples.
PACKED, LAWS, PLAIN = struct.Struct("<QIB"), ("mulaw", "alaw"), 2
#: How hard the stored table is compressed: 6 took 93 % of the bytes of Spark's 3 on prose.
ZSTD_LEVEL = 6
#: Step changes of the IMA ADPCM nibbles 0 to 7 (8 to 15 alike), fixed by the format.
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8])
LAST_STEP = 88


@lru_cache(1)
def step_sizes() -> np.ndarray:
    """The 89 IMA step sizes: fixed values of the format."""
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
        7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ], np.int64)


@lru_cache(1)
def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


@lru_cache(1)
def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    low, segment = (code & 0x0F) << 4, (code & 0x70) >> 4
    size = np.where(segment == 0, low + 8, low + 0x108 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


@lru_cache(1)
def adpcm_moves() -> tuple[np.ndarray, np.ndarray]:
    """For each step index and nibble (16 * index + nibble): by how much the sample changes, and 16 times the next index."""
    step, nib = step_sizes()[:, None], np.arange(16)[None, :]
    part = nib & 7
    change = (step >> 3) + np.where(part & 4, step, 0) + np.where(part & 2, step >> 1, 0) + np.where(part & 1, step >> 2, 0)
    index = np.clip(np.arange(LAST_STEP + 1)[:, None] + INDEX_STEPS[part], 0, LAST_STEP)
    return np.where(nib & 8, -change, change).ravel(), (16 * index).ravel()


def law_table(law: str) -> np.ndarray:
    return mulaw_table() if law == "mulaw" else alaw_table()


@lru_cache(2)
def law_codes(law: str) -> np.ndarray:
    """A code of the law for each 16-bit sample (as unsigned); it stands for that sample only if the law has it."""
    codes = np.zeros(1 << 16, np.uint8)
    codes[law_table(law).view(np.uint16)] = np.arange(256)
    return codes


def wav(codec: str, payload: bytes) -> bytes:
    """A mono WAV file of the payload: its bytes as 8-bit samples, or as the nibbles of ADPCM blocks of UNIT bytes."""
    if codec == "ima_adpcm":
        if len(payload) % UNIT:
            raise ValueError(f"ADPCM payloads are multiples of {UNIT} bytes")
        blocks = np.zeros((len(payload) // UNIT, UNIT + 4), np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        data, align, bits, extra = blocks.tobytes(), UNIT + 4, 4, struct.pack("<HH", 2, 2 * UNIT + 1)
    else:
        data, align, bits, extra = payload, 1, 8, struct.pack("<H", 0)
    rate = RATE if bits == 8 else RATE * align // (2 * UNIT + 1)
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, RATE, rate, align, bits) + extra
    samples = len(payload) if bits == 8 else len(payload) // UNIT * (2 * UNIT + 1)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(media: bytes) -> tuple[str, int, int, memoryview]:
    """(codec, rate, block bytes, data) of a WAV file that wav() or another writer made."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            codec = {v: k for k, v in TAGS.items()}.get(fmt[0] if fmt else -1)
            if codec is None or fmt[1] != 1:
                raise ValueError("not mono mu-law, A-law or IMA ADPCM")
            return codec, fmt[2], fmt[4], memoryview(media)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def payload_of(media: bytes) -> bytes:
    """The payload that wav() stored, read back from the file."""
    codec, _, align, data = parse_wav(media)
    if codec != "ima_adpcm":
        return bytes(data)
    return np.frombuffer(data, np.uint8).reshape(-1, align)[:, 4:].tobytes()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """16-bit samples of IMA ADPCM blocks (rows: 2 bytes first sample, step index, 0, nibbles low first), all at once."""
    n, size = blocks.shape
    value = blocks[:, 0].astype(np.int64) | (blocks[:, 1].astype(np.int64) << 8)
    value = np.where(value >= 32768, value - 65536, value)
    index = np.minimum(blocks[:, 2].astype(np.int64), LAST_STEP)
    nibbles = np.empty((2 * (size - 4), n), np.uint8)
    nibbles[0::2], nibbles[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((2 * (size - 4) + 1, n), np.int16)
    out[0] = value
    changes, nexts = adpcm_moves()
    row = index * 16
    for k in range(len(nibbles)):
        at = row + nibbles[k]
        value = np.minimum(np.maximum(value + changes[at], -32768), 32767)
        row = nexts[at]
        out[k + 1] = value
    return np.ascontiguousarray(out.T)


def decode_media(media: list[bytes | None]) -> list[tuple[int, np.ndarray] | None]:
    """(rate, 16-bit samples) of each WAV file; the ADPCM blocks of all files are decoded together."""
    out: list = [None] * len(media)
    adpcm: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for i, m in enumerate(media):
        if m is None:
            continue
        codec, rate, align, data = parse_wav(m)
        raw = np.frombuffer(data, np.uint8)
        if codec == "ima_adpcm":
            adpcm.setdefault(align, []).append((i, rate, raw[: len(raw) // align * align].reshape(-1, align)))
        else:
            out[i] = rate, law_table(codec)[raw]
    for rows in adpcm.values():
        samples, at = decode_adpcm(np.concatenate([b for _, _, b in rows])), 0
        for i, rate, b in rows:
            out[i] = rate, samples[at : at + len(b)].ravel()
            at += len(b)
    return out


@lru_cache(8)
def _taps(up: int, down: int, zeros: int = 6) -> np.ndarray:
    """Integer taps (units of 2 ** -14) of a windowed sinc for the rate up / down, a row for each phase."""
    cut = min(1.0, up / down)
    half = math.ceil(zeros / cut)
    t = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    window = np.where(np.abs(t) < half, 0.5 + 0.5 * np.cos(np.pi * t / half), 0)
    return np.rint(cut * np.sinc(cut * t) * window * (1 << 14))


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """16-bit samples at another rate: ceil(n * to / rate) samples, each a filter over the samples around its time."""
    if rate == to or not len(samples):
        return samples
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    taps = _taps(up, down)
    half = taps.shape[1] // 2
    n = -(-len(samples) * up // down)
    x = np.concatenate([np.zeros(half - 1), samples.astype(np.float64), np.zeros(half + 1)])
    out = np.empty(n)
    for k in range(up):  # every up-th output has one phase; sums of integers below 2 ** 53 are exact in any order
        mine, row = out[k::up], taps[k * down % up]
        if np.count_nonzero(row) == 1:  # the phase falls onto samples
            at = int(np.argmax(row != 0))
            found = x[at : len(x) - len(row) + 1 + at] * row[at]
        else:
            found = np.convolve(x, row[::-1], mode="valid")
        mine[:] = found[k * down // up :: down][: len(mine)]
    return np.clip(np.floor((out + (1 << 13)) / (1 << 14)), -32768, 32767).astype(np.int16)


def pack_pcm(pcm: np.ndarray, up: int) -> bytes:
    """16-bit samples in fewer bytes, without loss: every up-th one, and by how much all differ from what lies between these.

    Audio that was resampled by up differs nowhere, and then no differences are kept; any other takes up to half as much
    again. The samples are codes of mu-law or A-law if that law has all of them.
    """
    pcm = np.ascontiguousarray(pcm, "<i2")
    kept = np.ascontiguousarray(pcm[::up])
    form, body = PLAIN, kept
    for k, law in enumerate(LAWS):
        codes = law_codes(law)[kept.view("<u2")]
        if np.array_equal(law_table(law)[codes], kept):
            form, body = k, codes
            break
    rest = pcm.view("<u2") - resample(kept, 1, up)[: len(pcm)].astype("<i2").view("<u2")
    return PACKED.pack(len(pcm), up, form) + body.tobytes() + (rest.tobytes() if rest.any() else b"")


def unpack_pcm(packed: bytes) -> np.ndarray:
    """The samples that pack_pcm was given."""
    n, up, form = PACKED.unpack_from(packed)
    count, body = -(-n // up), memoryview(packed)[PACKED.size :]
    size = count * (2 if form == PLAIN else 1)
    kept = np.frombuffer(body[:size], "<i2") if form == PLAIN else law_table(LAWS[form])[np.frombuffer(body[:size], np.uint8)]
    pcm = resample(kept, 1, up)[:n].astype("<i2")
    rest = np.frombuffer(body[size:], "<u2")
    return (pcm.view("<u2") + rest).view("<i2") if len(rest) else pcm


def codec_for(payload: bytes) -> str:
    """Which codec stores a payload: by its checksum, so equal payloads are stored alike."""
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text, filled up, as a WAV file in a binary column."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch, "text", 8 << 20):
                raw = data.tobytes()
                media, sizes = [], np.diff(offsets)
                for i, n in enumerate(sizes.tolist()):
                    payload = raw[offsets[i] : offsets[i + 1]] + bytes([FILL]) * (max(1, -(-n // UNIT)) * UNIT - n)
                    media.append(wav(codec_for(payload), payload))
                yield pa.record_batch({"doc_id": batch.column(0).slice(a, b - a), "n_bytes": pa.array(sizes), "media": pa.array(media, pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def to_pcm(media: DataFrame, rate: int = PCM_RATE, packed: bool = False) -> DataFrame:
    """All columns of media, and pcm: the decoded and resampled samples as little-endian 16-bit PCM at rate; or packed."""
    small_batches(media.sparkSession)
    keep = [c for c in media.columns if c not in ("pcm", "packed")]
    name = "packed" if packed else "pcm"

    def stored(samples: np.ndarray, was: int) -> bytes:
        pcm = resample(samples, was, rate)
        return pack_pcm(pcm, rate // was if rate % was == 0 else 1) if packed else pcm.astype("<i2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _ in text_slices(batch, "media", 1 << 20):
                part = batch.slice(a, b - a)
                found = decode_media(part.column(part.schema.get_field_index("media")).to_pylist())
                pcm = [None if x is None else stored(x[1], x[0]) for x in found]
                yield pa.record_batch([*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(pcm, pa.binary())], names=[*keep, name])

    return media.select(*keep).mapInArrow(run, f"{_ddl(media, keep)}, {name} binary")


def unpacked(media: DataFrame) -> DataFrame:
    """All columns of media, with pcm, 16-bit PCM, in the place of packed."""
    small_batches(media.sparkSession)
    keep = [c for c in media.columns if c not in ("pcm", "packed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _ in text_slices(batch, "packed", 1 << 20):
                part = batch.slice(a, b - a)
                pcm = [None if x is None else unpack_pcm(x).tobytes() for x in part.column(len(keep)).to_pylist()]
                yield pa.record_batch([*part.columns[: len(keep)], pa.array(pcm, pa.binary())], names=[*keep, "pcm"])

    return media.select(*keep, "packed").mapInArrow(run, f"{_ddl(media, keep)}, pcm binary")


def _ddl(df: DataFrame, columns: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def feature(codec: str, samples: np.ndarray, pcm: np.ndarray) -> str:
    """codec, decoded samples, peak, mean square, sign changes, and the checksum of the resampled PCM."""
    x = samples.astype(np.int64)
    flips = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"{codec}:{len(x)}:{int(np.abs(x).max())}:{int(x @ x) // len(x)}:{flips}:{zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def media_digests(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and digests of the stored media, the payload read back from them, and the stored PCM (packed or pcm)."""
    small_batches(media.sparkSession)
    packed = "packed" in media.columns

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        stored, pcm = part.column(2).to_pylist(), part.column(3).to_pylist()
        audio = decode_media(stored)
        payloads = [None if m is None else payload_of(m) for m in stored]

        def each(values: list, make, kind: pa.DataType) -> pa.Array:
            return pa.array([None if x is None else make(x) for x in values], kind)

        heard = [
            None if m is None or p is None else feature(parse_wav(m)[0], x[1], unpack_pcm(p) if packed else np.frombuffer(p, "<i2"))
            for m, x, p in zip(stored, audio, pcm, strict=True)
        ]
        return pa.record_batch({
            "doc_id": part.column(0),
            "n_bytes": part.column(1),
            "payload_bytes": each(payloads, len, pa.int64()),
            "payload_sha256": each(payloads, lambda p: hashlib.sha256(p).hexdigest(), pa.string()),
            "tail_crc32": each(payloads, lambda p: zlib.crc32(p[-32:]), pa.int64()),
            "media_bytes": each(stored, len, pa.int64()),
            "media_sha256": each(stored, lambda m: hashlib.sha256(m).hexdigest(), pa.string()),
            "feature": pa.array(heard, pa.string()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _ in text_slices(batch, "media", 1 << 20):
                yield rows(batch.slice(a, b - a))

    ddl = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media", F.col("packed" if packed else "pcm")).mapInArrow(run, ddl)


def write_media(docs: DataFrame, at: str | None = None, rate: int = PCM_RATE, packed: bool = False) -> DataFrame:
    """Write store(docs) with its resampled PCM, as it is or packed, as a Parquet table and return it as read back.

    Row groups are small: PCM is several times the text, and a reader holds up to a whole group in memory.
    """
    spark = docs.sparkSession
    at = at or scratch(spark, "telephony")
    rows = to_pcm(store(docs), rate, packed)
    writer = rows.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", ZSTD_LEVEL)
    writer.option("parquet.block.size", 16 << 20).parquet(at)
    return spark.read.schema(rows.schema).parquet(at)
