"""Telephony audio columns: G.711 mu-law and A-law, IMA ADPCM, resampled PCM.

Media are RIFF/WAVE files in a binary column. Companded samples are expanded by
256-entry lookup tables; ADPCM blocks are decoded with numpy, all blocks of a
batch of files side by side, one step for each sample position.

``store_payloads`` stores bytes losslessly in all three forms: as 8-bit mu-law
or A-law samples, or as whole ADPCM blocks. Which one a payload gets follows from
its bytes alone. ``payload_digests`` reads the stored files and gives digests,
features and the resampled 16-bit PCM.

Defined results: null media stay null, as null payloads give null media; a null
text is an empty payload. A file whose data chunk is empty gives empty PCM; a
truncated data chunk gives the samples that are there; what isn't a WAVE file is
an error. Equal payloads give equal files. Rows that repeat stay rows; an empty
table gives no rows; other columns of the input pass through ``encode_column``
and ``decode_column`` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MULAW, ALAW, IMA_ADPCM, PCM = 7, 6, 17, 1
NAMES = {"mulaw": MULAW, "alaw": ALAW, "ima_adpcm": IMA_ADPCM, "pcm": PCM}


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    magnitude = (((u & 0x0F) << 3) + 0x84 << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -magnitude, magnitude).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    exponent, mantissa = (a & 0x70) >> 4, (a & 0x0F) << 4
    magnitude = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, magnitude, -magnitude).astype(np.int16)


EXPAND = {MULAW: _mulaw_table(), ALAW: _alaw_table()}


def _compress_table(codec: int) -> np.ndarray:
    """For each 16-bit value (plus 32768) the code whose expansion is nearest."""
    levels = EXPAND[codec].astype(np.int32)
    order = np.argsort(levels, kind="stable")
    cuts = (levels[order][1:] + levels[order][:-1]) / 2
    return order[np.searchsorted(cuts, np.arange(-32768, 32768))].astype(np.uint8)


_COMPRESS: dict[int, np.ndarray] = {}


def compress(samples: np.ndarray, codec: int) -> np.ndarray:
    if codec not in _COMPRESS:
        _COMPRESS[codec] = _compress_table(codec)
    return _COMPRESS[codec][samples.astype(np.int32) + 32768]


INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int32,
)


def adpcm_decode(data: bytes, block: int) -> np.ndarray:
    """Mono IMA ADPCM: each block is a 4-byte head (sample, index) and nibbles, low first.

    The blocks are independent, so sample position k of every block is decoded
    in one numpy step. A last block that is short is padded with zero nibbles
    whose samples are cut off again.
    """
    if len(data) < 4:
        return np.zeros(0, np.int16)
    n = -(-len(data) // block)
    tail = len(data) - (n - 1) * block
    raw = np.zeros((n, block), np.uint8)
    raw.reshape(-1)[: len(data)] = np.frombuffer(data, np.uint8)
    value = raw[:, 0:2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(raw[:, 2], 88).astype(np.int32)
    nibbles = np.empty((n, 2 * (block - 4)), np.uint8)
    nibbles[:, 0::2], nibbles[:, 1::2] = raw[:, 4:] & 15, raw[:, 4:] >> 4
    out = np.empty((n, nibbles.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(nibbles.shape[1]):
        code, step = nibbles[:, k], STEPS[index]
        diff = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - diff, value + diff), -32768, 32767)
        index = np.clip(index + INDEX_STEP[code], 0, 88)
        out[:, k + 1] = value
    lost = 2 * (block - tail) if tail >= 4 else out.shape[1]
    return out.reshape(-1)[: out.size - lost]


def adpcm_encode(samples: np.ndarray, block: int) -> bytes:
    """The inverse up to quantisation; the last block is padded with its last sample."""
    per = 2 * (block - 4) + 1
    n = max(1, -(-len(samples) // per))
    padded = np.full(n * per, samples[-1] if len(samples) else 0, np.int32)
    padded[: len(samples)] = samples
    grid = padded.reshape(n, per)
    value, index = grid[:, 0].copy(), np.zeros(n, np.int32)
    codes = np.zeros((n, per - 1), np.uint8)
    for k in range(per - 1):
        step, delta = STEPS[index], grid[:, k + 1] - value
        code = np.where(delta < 0, 8, 0)
        left = np.abs(delta)
        diff = step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            take = left >= part
            code, left, diff = code + bit * take, left - part * take, diff + part * take
        value = np.clip(np.where(code & 8, value - diff, value + diff), -32768, 32767)
        index = np.clip(index + INDEX_STEP[code], 0, 88)
        codes[:, k] = code
    raw = np.zeros((n, block), np.uint8)
    raw[:, 0:2] = grid[:, :1].astype("<i2").view(np.uint8)
    raw[:, 4:] = codes[:, 0::2] | codes[:, 1::2] << 4
    return raw.tobytes()


def wav(data: bytes, codec: int, rate: int, block: int = 1) -> bytes:
    bits = {MULAW: 8, ALAW: 8, IMA_ADPCM: 4, PCM: 16}[codec]
    extra = struct.pack("<HH", 2, 2 * (block - 4) + 1) if codec == IMA_ADPCM else struct.pack("<H", 0)
    align = block if codec == IMA_ADPCM else bits // 8
    speed = rate * block // (2 * (block - 4) + 1) if codec == IMA_ADPCM else rate * align
    head = struct.pack("<HHIIHH", codec, 1, rate, speed, align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """Codec, rate, block size and the data chunk of a RIFF/WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            codec, _, rate, _, align, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            fmt = codec, rate, align
        elif name == b"data" and fmt:
            return *fmt, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def expand(media: bytes) -> tuple[np.ndarray, int]:
    """16-bit PCM and sample rate of a stored file, decoded by its own codec."""
    return expand_all([media])[0]


def expand_all(media: list[bytes]) -> list[tuple[np.ndarray, int]]:
    """``expand`` of each file; the ADPCM blocks of all files that have one block size are decoded at once."""
    parsed = [parse_wav(m) for m in media]
    out: list = [None] * len(media)
    blocks: dict[int, list[int]] = {}
    for k, (codec, rate, block, data) in enumerate(parsed):
        if codec in EXPAND:
            out[k] = EXPAND[codec][np.frombuffer(data, np.uint8)], rate
        elif codec == PCM:
            out[k] = np.frombuffer(data[: len(data) // 2 * 2], "<i2"), rate
        elif codec == IMA_ADPCM:
            blocks.setdefault(block, []).append(k)
        else:
            raise ValueError(f"codec {codec} is not supported")
    for block, own in blocks.items():
        whole = [len(parsed[k][3]) // block for k in own]
        samples = adpcm_decode(b"".join(parsed[k][3][: n * block] for k, n in zip(own, whole)), block)
        at = 0
        for k, n in zip(own, whole):
            end = at + n * (2 * (block - 4) + 1)
            tail = adpcm_decode(parsed[k][3][n * block :], block)
            out[k] = np.concatenate([samples[at:end], tail]), parsed[k][1]
            at = end
    return out


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in integers, so every machine gets the same samples."""
    n = len(samples) * to // rate
    if n == 0 or rate == to:
        return samples[:n].astype(np.int16)
    at = np.arange(n, dtype=np.int64) * rate
    left, part = at // to, at % to
    x = samples.astype(np.int64)
    right = np.minimum(left + 1, len(x) - 1)
    return ((x[left] * (to - part) + x[right] * part) // to).astype(np.int16)


def pcm_features(samples: np.ndarray) -> str:
    """Level, peak and crossings of PCM, with its checksum; integers only but for the level."""
    if not len(samples):
        return "n=0"
    x = samples.astype(np.int64)
    power = int((x * x).sum()) // len(x)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={len(x)};power={power};peak={int(np.abs(x).max())};mean={int(x.sum()) // len(x)};crossings={crossings};crc32={zlib.crc32(samples.astype('<i2').tobytes())}"


def encode_column(df: DataFrame, payload: str, media: str, codec: str = "mulaw", rate: int = 8000) -> DataFrame:
    """Adds the binary column ``media``: the bytes of ``payload`` as the samples of a WAV file.

    For companded codecs a byte is one 8-bit sample, so the payload is stored
    losslessly. Null payloads give null media.
    """
    kind = NAMES[codec]

    @F.pandas_udf(T.BinaryType())
    def to_wav(column):
        return column.map(lambda b: None if b is None else wav(bytes(b), kind, rate))

    return df.withColumn(media, to_wav(F.col(payload)))


PCM_TYPE = T.StructType([T.StructField("pcm", T.BinaryType()), T.StructField("rate", T.IntegerType()), T.StructField("feature", T.StringType())])


def decode_column(df: DataFrame, media: str, out: str, to_rate: int = 16000) -> DataFrame:
    """Adds the struct column ``out``: resampled 16-bit PCM, its rate and its features."""
    import pandas as pd

    @F.pandas_udf(PCM_TYPE)
    def to_pcm(column):
        rows = []
        for m in column:
            if m is None:
                rows.append((None, None, None))
                continue
            samples, rate = expand(bytes(m))
            samples = resample(samples, rate, to_rate)
            rows.append((samples.astype("<i2").tobytes(), to_rate, pcm_features(samples)))
        return pd.DataFrame(rows, columns=["pcm", "rate", "feature"])

    return df.withColumn(out, to_pcm(F.col(media)))


def pad(payload: bytes, unit: int = 576, fill: int = 255) -> bytes:
    """``payload`` with ``fill`` appended up to a positive multiple of ``unit``."""
    return payload + bytes([fill]) * (max(1, -(-len(payload) // unit)) * unit - len(payload))


#: Bytes of an ADPCM block of a payload; a divisor of the payload's unit.
PAYLOAD_BLOCK = 64
FORMS = ("mulaw", "alaw", "ima_adpcm")
STORED = "doc_id long, n_bytes long, media binary"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, pcm_rate int, pcm binary"


def payload_wav(payload: bytes, rate: int = 8000, codec: str | None = None) -> bytes:
    """``payload`` as the data of a WAV file, in the form that its checksum picks if none is named."""
    kind = NAMES[codec or FORMS[zlib.crc32(payload) % len(FORMS)]]
    return wav(payload, kind, rate, PAYLOAD_BLOCK if kind == IMA_ADPCM else 1)


def store_payloads(docs: DataFrame, codec: str | None = None, rate: int = 8000) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the padded UTF-8 bytes of the text as a WAV file."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [b or b"" for b in part.column(1).to_pylist()]
                media = [payload_wav(pad(b), rate, codec) for b in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(b) for b in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(encode, STORED)


def payload_digests(stored: DataFrame, to_rate: int = 16000, batch_bytes: int = 2_000_000) -> DataFrame:
    """Digests, PCM features and resampled PCM of stored files, all from the bytes read back."""
    names = [x.split()[0] for x in DIGEST.split(", ")]
    kinds = (*[pa.int64()] * 3, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary())
    called = {v: k for k, v in NAMES.items()}

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[2])
                if size >= batch_bytes:
                    yield made(held)
                    held, size = [], 0
            if held:
                yield made(held)

    def made(held: list[tuple]) -> pa.RecordBatch:
        rows = []
        for (doc_id, n_bytes, media), (samples, rate) in zip(held, expand_all([m for _, _, m in held])):
            codec, _, _, data = parse_wav(media)
            pcm = resample(samples, rate, to_rate)
            feature = f"codec={codec};rate={to_rate};" + pcm_features(pcm)
            rows.append((doc_id, n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, called[codec], to_rate, pcm.astype("<i2").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    return stored.mapInArrow(digest, DIGEST)
