"""Media columns: WAV bytes, short-time Fourier transforms and spectral-peak pair fingerprints.

A payload is stored as the 8-bit mono samples of a WAV file written by the wave module, read
back by it, and described by landmarks: the strongest bin of each frame's spectrum is paired
with those of the next FANOUT frames; a pair is (time, bin, later bin, distance).

For the transform only, a payload of under one frame is repeated until it fills one, and HOP samples of their
mean stand before and behind the samples (and fill the last frame), so every sample bears on the inner part of a
frame's window, and every payload has several frames.

Cases: a null or empty text is one block of 64 zero bytes; silence (no energy besides the
constant part) has no peaks, so its fingerprint is empty; equal texts give equal values; an empty
table gives no rows; other columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

RATE = 8000
BLOCK = 64
FRAME = 256
HOP = 128
FANOUT = 2
#: Frames transformed at a time, so that memory stays bounded for long payloads.
FRAMES = 8192

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media binary, media_bytes long, media_sha256 string, landmarks array<struct<t:int,f1:int,f2:int,dt:int>>"
)


def payload(text: str | None) -> tuple[bytes, int]:
    """The text's bytes followed by zero bytes up to a positive multiple of 64, and their number."""
    raw = (text or "").encode("utf-8")
    return raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw)), len(raw)


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


_WINDOW = np.hanning(FRAME)


def peaks(samples: bytes) -> np.ndarray:
    """The strongest bin above 0 of each frame's spectrum; 0 where a frame is silent."""
    x = np.frombuffer(samples, np.uint8)
    if 0 < len(x) < FRAME:
        x = np.tile(x, -(-FRAME // len(x)))
    behind = -(-len(x) // HOP) * HOP - len(x) + HOP
    middle = np.uint8(round(float(x.mean()))) if len(x) else np.uint8(0)
    x = np.concatenate([np.full(HOP, middle), x, np.full(behind, middle)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.zeros(len(frames), np.int32)
    for k in range(0, len(frames), FRAMES):
        part = frames[k : k + FRAMES].astype(np.float64) - 128.0
        part -= part.mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(part * _WINDOW, axis=1)[:, 1:])
        best = power.argmax(axis=1)
        loud = power[np.arange(len(best)), best] > 1e-6
        out[k : k + FRAMES] = np.where(loud, best + 1, 0)
    return out


def landmarks(samples: bytes) -> np.ndarray:
    """Rows (t, f1, f2, dt), by t and dt."""
    f = peaks(samples)
    rows = []
    for dt in range(1, FANOUT + 1):
        t = np.nonzero((f[:-dt] > 0) & (f[dt:] > 0))[0] if len(f) > dt else np.zeros(0, np.int64)
        rows.append(np.stack([t, f[t], f[t + dt], np.full(len(t), dt)], axis=1))
    rows = np.concatenate(rows)
    return rows[np.lexsort((rows[:, 3], rows[:, 0]))]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out: dict[str, list] = {k: [] for k in ("n", "pn", "ps", "tail", "media", "mn", "ms")}
        marks = []
        for text in batch.column("text").to_pylist():
            data, n = payload(text)
            media = to_wav(data)
            read = from_wav(media)
            marks.append(landmarks(read))
            for k, v in zip(out, (n, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-BLOCK:]), media, len(media), hashlib.sha256(media).hexdigest()), strict=True):
                out[k].append(v)
        flat = np.concatenate(marks) if marks else np.zeros((0, 4))
        offsets = np.concatenate([[0], np.cumsum([len(m) for m in marks])]).astype(np.int32)
        struct = pa.StructArray.from_arrays([pa.array(flat[:, i].astype(np.int32)) for i in range(4)], ["t", "f1", "f2", "dt"])
        arrays = [batch.column("doc_id").cast(pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["pn"], pa.int64()), pa.array(out["ps"], pa.string()), pa.array(out["tail"], pa.int64()), pa.array(out["media"], pa.binary()), pa.array(out["mn"], pa.int64()), pa.array(out["ms"], pa.string()), pa.ListArray.from_arrays(pa.array(offsets), struct)]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "media_bytes", "media_sha256", "landmarks"])


def media_columns(docs: DataFrame) -> DataFrame:
    """The media columns of every row, with the stored WAV bytes and the landmarks."""
    return docs.select("doc_id", "text").mapInArrow(_rows, SCHEMA)
