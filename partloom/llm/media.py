"""Media columns: texts' bytes as WAV sounds, read back and fingerprinted by pairs of spectral peaks.

A payload becomes mono 8-bit PCM by the wave module. The features come from the bytes read back: short-time Fourier
transforms, the strongest bin of each frequency band where it stands out from the frame, and for each peak its pairs with
the next few, coded as (bin, bin, distance in frames) at the first peak's frame.

Defined results: a null text is empty, an empty text gives 64 zero bytes; texts of any length are read whole, in steps of
bounded memory; repeated rows each get a row; equal texts get equal values; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, FRAME, HOP = 8000, 256, 128
BANDS = ((1, 10), (10, 20), (20, 40), (40, 80), (80, 129))
FAN_OUT, FARTHEST = 3, 63
PAD = 64
_STEP = 4096  # frames at a time
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as r:
        return r.readframes(r.getnframes())


def padded(raw: bytes) -> bytes:
    """raw and zeros, up to a positive multiple of PAD."""
    return raw + bytes(max(PAD, -(-len(raw) // PAD) * PAD) - len(raw))


def frames(samples: int) -> int:
    """How many frames it takes until every sample lies in one; the last is filled up with silence."""
    return 1 + -(-max(0, samples - FRAME) // HOP)


def peaks(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the spectral peaks, in order."""
    samples = np.frombuffer(payload, np.uint8)
    samples = np.r_[samples, np.full((frames(len(samples)) - 1) * HOP + FRAME - len(samples), 128, np.uint8)]
    views = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    times, bins = [], []
    for at in range(0, len(views), _STEP):
        loud = np.abs(np.fft.rfft((views[at : at + _STEP].astype(np.float32) - 128) * _WINDOW, axis=1))
        best = np.stack([loud[:, a:b].argmax(axis=1) + a for a, b in BANDS], axis=1)
        height = np.take_along_axis(loud, best, axis=1)
        t, band = np.nonzero(height > height.mean(axis=1, keepdims=True))
        times.append(t + at)
        bins.append(best[t, band])
    return np.concatenate(times), np.concatenate(bins)


def pairs(times: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and codes of the peak pairs: bits 13-20 the first bin, 6-12 the second less one, 0-5 the distance."""
    t, code = [], []
    for k in range(1, FAN_OUT + 1):
        apart = times[k:] - times[:-k]
        near = apart <= FARTHEST
        t.append(times[:-k][near])
        code.append((bins[:-k][near] << 13) | ((bins[k:][near] - 1) << 6) | apart[near])
    t, code = np.concatenate(t).astype(np.int32), np.concatenate(code).astype(np.int32)
    order = np.lexsort((code, t))
    return t[order], code[order]


def sounds(docs: DataFrame, with_media: bool = False, with_pairs: bool = False) -> DataFrame:
    """A row for every row of docs: sizes and digests of the payload and the stored sound, a feature string, and if asked
    for the sound itself (media) and its time-coded fingerprint (pairs: array of t, code)."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += ", media binary" * with_media + ", pairs array<struct<t:int,code:int>>" * with_pairs

    names = [x.split()[0] for x in schema.split(", ")[:7]] + ["feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(text: str | None) -> tuple[list, bytes, np.ndarray, np.ndarray]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        stored = to_wav(padded(raw))
        back = from_wav(stored)
        found, bins = peaks(back)
        t, code = pairs(found, bins)
        digest = hashlib.blake2b(t.tobytes() + code.tobytes(), digest_size=16).hexdigest()
        return [len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(stored), hashlib.sha256(stored).hexdigest(), f"frames={frames(len(back))};peaks={len(found)};pairs={len(t)};print={digest}"], stored, t, code

    def some(ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        rows = [one(t) for t in texts]
        columns, heads = [ids, *[pa.array([r[0][i] for r in rows], k) for i, k in enumerate(types)]], names.copy()
        if with_media:
            columns.append(pa.array([r[1] for r in rows], pa.binary()))
            heads.append("media")
        if with_pairs:
            ends = np.cumsum([0, *(len(r[2]) for r in rows)]).astype(np.int32)
            both = pa.StructArray.from_arrays([pa.array(np.concatenate([r[i] for r in rows])) for i in (2, 3)], names=["t", "code"])
            columns.append(pa.ListArray.from_arrays(pa.array(ends), both))
            heads.append("pairs")
        return pa.RecordBatch.from_arrays(columns, names=heads)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield some(part.column(0), part.column(1).to_pylist())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
