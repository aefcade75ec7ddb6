"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers.

Companded samples are expanded through 256-entry tables; ADPCM blocks (of any size and number of
channels, as the header says) are decoded with numpy across blocks, one step of all blocks at a
time. Decoded speech is mixed to one channel, resampled to 16 kHz by a windowed-sinc filter and
stored as 16-bit PCM.

``text_media`` stores the bytes of texts as such audio without loss: the payload is padded with
zero bytes to a positive multiple of 64 (one ADPCM block) and is the data chunk of the container.
The coding is chosen by the payload's CRC-32, so equal texts give equal media.

Defined cases: a null text is empty (a payload of 64 zero bytes); a null ``doc_id`` stays null;
media that are null, no WAV container, without samples' format or data, or of another coding give
null PCM; of a data chunk that is cut off, the whole samples or blocks that are there are decoded;
equal rows give equal values; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, table, text_parts

BLOCK = 64
RATE = 8000
#: WAV format tags by coding.
TAGS = {"mulaw": 7, "alaw": 6, "ima_adpcm": 17}
CODINGS = tuple(TAGS)
#: Samples of an ADPCM block: one in its header and two in each byte after it.
BLOCK_SAMPLES = 1 + 2 * (BLOCK - 4)
#: Payload bytes decoded together.
CHUNK_BYTES = 2_000_000


def _mulaw() -> np.ndarray:
    u = ~np.arange(256, dtype=np.uint8)
    size = (((u & 15).astype(np.int32) << 3) + 132 << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    a = np.arange(256, dtype=np.uint8) ^ 0x55
    part, size = ((a >> 4) & 7).astype(np.int32), ((a & 15).astype(np.int32) << 4) + 8
    size = np.where(part > 0, (size + 256) << np.maximum(part - 1, 0), size)
    return np.where(a & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": _mulaw(), "alaw": _alaw()}

#: Step sizes of IMA ADPCM, each 1.1 times the last as the standard lists them.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
_CODE = np.arange(16, dtype=np.int32)
_DIFF = (STEPS[:, None] >> 3) + np.where(_CODE & 4, STEPS[:, None], 0) + np.where(_CODE & 2, STEPS[:, None] >> 1, 0) + np.where(_CODE & 1, STEPS[:, None] >> 2, 0)
#: Change of the sample and next step, by 16 * step + code.
DIFF = np.where(_CODE & 8, -_DIFF, _DIFF).astype(np.int32).ravel()
NEXT = np.clip(np.arange(89)[:, None] + np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2), 0, 88).astype(np.int32).ravel()


def decode_adpcm(data: np.ndarray, block: int = BLOCK, channels: int = 1) -> np.ndarray:
    """16-bit samples (a row for each time, a column for each channel) of IMA ADPCM blocks, all blocks at once."""
    blocks = data[: len(data) // block * block].reshape(-1, block)
    head = blocks[:, : 4 * channels].reshape(-1, 4)
    words = (block - 4 * channels) // (4 * channels)
    body = blocks[:, 4 * channels : 4 * channels * (1 + words)].reshape(-1, words, channels, 4)
    codes = np.ascontiguousarray(body.transpose(1, 3, 0, 2).reshape(4 * words, -1))
    out = np.empty((1 + 8 * words, len(head)), np.int16)
    now = head[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    step = np.minimum(head[:, 2], 88).astype(np.int32)
    out[0] = now
    for k in range(8 * words):
        code = codes[k >> 1] >> 4 if k & 1 else codes[k >> 1] & 15
        at = (step << 4) | code
        now += DIFF[at]
        np.clip(now, -32768, 32767, out=now)
        step = NEXT[at]
        out[k + 1] = now
    return out.reshape(1 + 8 * words, -1, channels).transpose(1, 0, 2).reshape(-1, channels)


def encode_adpcm(samples: np.ndarray) -> bytes:
    """IMA ADPCM blocks of 16-bit samples (padded by zeros to whole blocks), all blocks at once."""
    x = np.zeros(-(-max(1, len(samples)) // BLOCK_SAMPLES) * BLOCK_SAMPLES, np.int32)
    x[: len(samples)] = samples
    x = x.reshape(-1, BLOCK_SAMPLES).T
    out = np.zeros((x.shape[1], BLOCK), np.uint8)
    now, step = x[0].copy(), np.zeros(x.shape[1], np.int32)
    out[:, :2] = now.astype("<i2").view(np.uint8).reshape(-1, 2)
    for k in range(BLOCK_SAMPLES - 1):
        gap = x[k + 1] - now
        code = np.minimum(np.abs(gap) * 4 // STEPS[step], 7).astype(np.int32) | np.where(gap < 0, 8, 0)
        at = (step << 4) | code
        now = np.clip(now + DIFF[at], -32768, 32767)
        step = NEXT[at]
        out[:, 4 + (k >> 1)] |= (code << (4 * (k & 1))).astype(np.uint8)
    return out.tobytes()


def wav(coding: str, data: bytes, rate: int = RATE, block: int = BLOCK, channels: int = 1) -> bytes:
    """A WAV container; ``coding`` is one of ``TAGS`` (companded: one channel) or ``pcm`` (16-bit)."""
    if coding == "pcm":
        form = struct.pack("<HHIIHH", 1, channels, rate, 2 * channels * rate, 2 * channels, 16)
    elif coding == "ima_adpcm":
        samples = 1 + (block - 4 * channels) // (4 * channels) * 8
        form = struct.pack("<HHIIHHHH", 17, channels, rate, rate * block // samples, block, 4, 2, samples)
    else:
        form = struct.pack("<HHIIHHH", TAGS[coding], 1, rate, rate, 1, 8, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


class Format(NamedTuple):
    coding: str
    rate: int
    channels: int
    #: Bytes of a block (ADPCM) or of the samples of one time.
    block: int


def read_wav(media: bytes) -> tuple[Format, memoryview] | None:
    """Format and data of a container; null if it is none, or of a coding that isn't known here."""
    view = memoryview(media)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(view):
        kind, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if kind == b"fmt " and size >= 16 and at + 24 <= len(view):
            tag, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", view, at + 8)
            coding = {(7, 8): "mulaw", (6, 8): "alaw", (17, 4): "ima_adpcm", (1, 16): "pcm", (1, 8): "pcm8"}.get((tag, bits))
            whole = block > 4 * channels and block % 4 == 0 if coding == "ima_adpcm" else block == channels * bits // 8
            form = Format(coding, rate, channels, block) if coding and channels and rate and whole else None
        elif kind == b"data":
            return (form, view[at + 8 : at + 8 + size]) if form else None
        at += 8 + size + size % 2
    return None


def expand(form: Format, data: np.ndarray) -> np.ndarray:
    """16-bit samples of the data, a column for each channel."""
    if form.coding == "ima_adpcm":
        return decode_adpcm(data, form.block, form.channels)
    data = data[: len(data) // form.block * form.block]
    if form.coding == "pcm":
        out = data.view("<i2")
    else:
        out = TABLES[form.coding][data] if form.coding in TABLES else ((data.astype(np.int16) - 128) << 8)
    return out.reshape(-1, form.channels)


def mono(samples: np.ndarray) -> np.ndarray:
    return samples[:, 0] if samples.shape[1] == 1 else (samples.astype(np.int32).sum(axis=1) // samples.shape[1]).astype(np.int16)


#: Taps on either side of a new sample, and the half-band filter in whole numbers (they sum to 2**15).
TAPS = 8
_at = np.arange(TAPS) + 0.5
_half = np.sinc(_at) * (0.54 + 0.46 * np.cos(np.pi * _at / TAPS))
HALF_BAND = np.round(_half / _half.sum() / 2 * 32768).astype(np.int64)
HALF_BAND[0] += 16384 - HALF_BAND.sum()
TARGET_RATE = 2 * RATE


def resample(pcm: np.ndarray, rate: int = RATE, to: int = TARGET_RATE) -> np.ndarray:
    """16-bit samples at another rate, by a windowed sinc; the doubling of telephony's rate in whole numbers."""
    if rate == to or not len(pcm):
        return pcm.astype(np.int16)
    if 2 * rate == to:
        wide = np.pad(pcm.astype(np.int64), TAPS, mode="edge")
        n = len(pcm)
        between = sum(c * (wide[TAPS - k : TAPS - k + n] + wide[TAPS + 1 + k : TAPS + 1 + k + n]) for k, c in enumerate(HALF_BAND))
        out = np.empty(2 * n, np.int16)
        out[::2] = pcm
        out[1::2] = np.clip((between + 16384) >> 15, -32768, 32767)
        return out
    # Below the lower of both rates only; the filter is longer as that is lower.
    low = min(1.0, to / rate)
    reach = int(np.ceil(TAPS / low))
    wide = np.pad(pcm.astype(np.float64), reach, mode="edge")
    n = max(1, len(pcm) * to // rate)
    out = np.empty(n, np.int16)
    for start in range(0, n, 100_000):
        at = np.arange(start, min(n, start + 100_000)) * (rate / to)
        first = np.floor(at).astype(np.int64)
        near = np.arange(-reach + 1, reach + 1)
        gap = (at - first)[:, None] - near
        weight = np.sinc(gap * low) * (0.54 + 0.46 * np.cos(np.pi * np.clip(gap / reach, -1, 1)))
        got = (wide[first[:, None] + near + reach] * weight).sum(axis=1) / weight.sum(axis=1)
        out[start : start + len(at)] = np.clip(np.round(got), -32768, 32767)
    return out


def stored_pcm(pcm: np.ndarray, rate: int = RATE) -> bytes:
    """A WAV container of the samples as 16 kHz PCM."""
    return wav("pcm", resample(pcm, rate).astype("<i2").tobytes(), TARGET_RATE)


def features(coding: str, pcm: np.ndarray) -> str:
    """Whole numbers only: coding, samples, peak, root mean square, zero crossings."""
    wide = pcm.astype(np.int64)
    power = int(np.dot(wide, wide)) // max(1, len(wide))
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{coding};{len(pcm)};{int(np.abs(wide).max(initial=0))};{isqrt(power)};{crossings}"


def decode_many(media: list[bytes]) -> list[tuple[Format, memoryview, np.ndarray] | None]:
    """Format, data and one channel of 16-bit samples of containers; ADPCM blocks of a kind are decoded together."""
    read = [read_wav(x) for x in media]
    kinds: dict[tuple[int, int], list[int]] = {}
    out: list = [None] * len(read)
    for i, r in enumerate(read):
        if r is None:
            continue
        if r[0].coding == "ima_adpcm":
            kinds.setdefault((r[0].block, r[0].channels), []).append(i)
        else:
            out[i] = (*r, mono(expand(r[0], np.frombuffer(r[1], np.uint8))))
    for (block, channels), own in kinds.items():
        blocks = [len(read[i][1]) // block for i in own]
        data = b"".join(read[i][1][: n * block] for i, n in zip(own, blocks))
        both = mono(decode_adpcm(np.frombuffer(data, np.uint8), block, channels))
        samples = 1 + (block - 4 * channels) // (4 * channels) * 8
        ends = np.cumsum(blocks) * samples
        for i, x in zip(own, np.split(both, ends[:-1])):
            out[i] = (*read[i], x)
    return out


def decode_media(df: DataFrame, media: str = "media", pcm: str = "pcm") -> DataFrame:
    """``df`` (a key and a binary column of containers) with the speech as stored 16 kHz PCM in column ``pcm``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != pcm) + f", `{pcm}` binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if pcm in b:
                b = b.drop(columns=pcm)
            got = decode_many([x if x is not None else b"" for x in b[media]])
            b[pcm] = pd.Series([None if x is None else stored_pcm(x[2], x[0].rate) for x in got], index=b.index, dtype=object)
            yield b

    return df.mapInPandas(run, schema)


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def text_media(text: str | None) -> bytes:
    data = payload_of(text)
    return wav(CODINGS[zlib.crc32(data) % len(CODINGS)], data)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"
ARROW = pa.schema([(name, {"long": pa.int64(), "string": pa.string()}[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))])


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``SCHEMA`` of batches (doc_id, text): beside a batch a worker holds the media of about ``CHUNK_BYTES``."""
    for b, texts in text_parts(batches, CHUNK_BYTES):
        rows = []
        media = [text_media(t) for t in texts]
        for i, (t, m, (form, data, pcm)) in enumerate(zip(texts, media, decode_many(media))):
            speech = stored_pcm(pcm)
            raw = len((t or "").encode("utf-8", "surrogatepass"))
            row = (b.column(0)[i].as_py(), raw, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest())
            rows.append((*row, features(form.coding, pcm), len(speech), hashlib.sha256(speech).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), ARROW.types)], schema=ARROW)
    release()


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores each text as audio, reads the stored bytes back and describes them."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(digested, SCHEMA)


def store_texts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, media, pcm): the lossless audio form, and its speech as 16 kHz PCM."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "media": [text_media(t) for t in b["text"]]})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return decode_media(slim.mapInPandas(run, "doc_id long, media binary"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op7_audio`` that SQL can say, from the same operator."""
    return op7_audio(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


PAYLOADS_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, octet_length(b)::BIGINT AS n, greatest(64, (octet_length(b) + 63) // 64 * 64)::BIGINT AS m, b FROM d)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(b || unhex(repeat('00', (m - n)::INT))) AS payload_sha256 FROM p"""


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
