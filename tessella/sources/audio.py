"""PCM audio in and out of WAV bytes, 16-bit and 16 kHz as speech models want it."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 16_000
SCALE = 32767


def read_wav(raw: bytes) -> np.ndarray:
    """Mono samples in [-1, 1] of a RIFF WAV; chunks are walked (even aligned), stereo is averaged."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, None
    while at + 8 <= len(raw) and data is None:
        kind, size = raw[at:at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        body = raw[at + 8:at + 8 + size]
        if kind == b"fmt ":
            form = struct.unpack_from("<HHIIHH", body)
        elif kind == b"data":
            data = body
        at += 8 + size + size % 2
    if form is None or data is None:
        raise ValueError("no format or no data")
    coding, channels, rate, _, _, bits = form
    if coding != 1 or bits != 16:
        raise ValueError("only 16-bit PCM is read")
    if rate != RATE:
        raise ValueError(f"{rate} Hz; {RATE} Hz is wanted")
    if channels not in (1, 2):
        raise ValueError(f"{channels} channels")
    x = np.frombuffer(data[:len(data) // (2 * channels) * 2 * channels], "<i2").astype(np.float32) / SCALE
    return x if channels == 1 else x.reshape(-1, 2).mean(axis=1)


def write_wav(samples, rate: int = RATE) -> bytes:
    """Mono 16-bit WAV of samples, clamped to [-1, 1]; fractions are cut."""
    pcm = np.trunc(np.clip(np.asarray(samples, np.float64), -1, 1) * SCALE).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm


def decode_wav(raw: Column) -> Column:
    """(samples, error) of WAV bytes."""

    @F.pandas_udf("samples array<float>, error string")
    def run(files: pd.Series) -> pd.DataFrame:
        rows = []
        for f in files:
            try:
                rows.append((None if f is None else read_wav(f).tolist(), None))
            except ValueError as e:
                rows.append((None, str(e)))
        return pd.DataFrame({"samples": pd.Series([r[0] for r in rows], dtype=object), "error": pd.Series([r[1] for r in rows], dtype=object)})

    return run(raw)


def pcm_to_wav(samples: Column, rate: int = RATE) -> Column:
    @F.pandas_udf("binary")
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else write_wav(a, rate))

    return run(samples)


def mono(samples: Column, channels: Column) -> Column:
    """Interleaved samples of one or two channels as one: two are averaged."""
    pairs = F.transform(F.sequence(F.lit(0), (F.size(samples) / 2).cast("int") - 1), lambda i: (F.get(samples, i * 2) + F.get(samples, i * 2 + 1)) * 0.5)
    return F.when(channels == 1, samples).when(F.size(samples) >= 2, pairs).otherwise(F.slice(samples, 1, 0))
