"""RIFF/WAVE files of linear PCM as columns: probing their heads, decoding to one channel, encoding.

Other containers need a decoder outside the engine; their probe is null, as that
of any file that can't be read.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROBE = "duration double, size long, sample_rate int, channels int, codec_name string, sample_fmt string"


def files(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """(path, length, content) of audio files; a file is one row."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def _chunks(data: bytes) -> dict[bytes, bytes]:
    at, out = 12, {}
    while data[:4] == b"RIFF" and data[8:12] == b"WAVE" and at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        out.setdefault(data[at : at + 4], data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return out


def _format(data: bytes) -> tuple[int, int, bytes] | None:
    """Channels, rate and samples of a file of 16-bit PCM."""
    chunks = _chunks(data)
    head = chunks.get(b"fmt ", b"")
    if len(head) < 16 or b"data" not in chunks:
        return None
    codec, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", head)
    return (channels, rate, chunks[b"data"]) if (codec, bits) == (1, 16) and channels and rate else None


def probe(content: Column) -> Column:
    """What is known of a file from its head; null if it can't be read."""
    import pandas as pd

    @F.pandas_udf(PROBE)
    def of(column):
        rows = []
        for data in column:
            found = _format(bytes(data)) if data is not None else None
            rows.append((None,) * 6 if found is None else (len(found[2]) / (2 * found[0] * found[1]), len(data), found[1], found[0], "pcm_s16le", "s16"))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PROBE.split(", ")])

    made = of(content)
    return F.when(made["duration"].isNotNull(), made)


def decode(content: Column) -> Column:
    """One channel of 32-bit floats, the mean of the file's channels; null if it can't be read."""
    import pandas as pd

    @F.pandas_udf("array<float>")
    def of(column):
        out = []
        for data in column:
            found = _format(bytes(data)) if data is not None else None
            if found is None:
                out.append(None)
                continue
            channels, _, raw = found
            x = np.frombuffer(raw[: len(raw) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels)
            out.append((x.astype(np.float32).mean(axis=1) / np.float32(32768)).tolist())
        return pd.Series(out, dtype=object)

    return of(content)


def encode(signal: Column, rate: int = 16000) -> Column:
    """A file of 16-bit PCM from an array of floats; beyond -1 to 1 they are cut off. Null stays null."""
    import pandas as pd

    @F.pandas_udf("binary")
    def of(column):
        out = []
        for x in column:
            if x is None:
                out.append(None)
                continue
            data = np.rint(np.clip(np.nan_to_num(np.asarray(x, float)), -1, 32767 / 32768) * 32768).astype("<i2").tobytes()
            head = struct.pack("<HHIIHH", 1, 1, rate, 2 * rate, 2, 16)
            body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data
            out.append(b"RIFF" + struct.pack("<I", len(body)) + body)
        return pd.Series(out, dtype=object)

    return of(signal)
