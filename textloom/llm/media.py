"""Media columns: texts as 8-bit WAV bytes, and spectral-peak pair fingerprints of them.

`to_wav` stores every payload in a WAV container in a binary column;
`fingerprints` reads such a column back with the wave module, takes short-time
Fourier transforms and pairs spectral peaks. Both are maps without a shuffle.

Defined cases: null text is empty; the empty payload is padded to 64 zero bytes;
equal texts give equal media and fingerprints; a null media value gives null
features; very long media are transformed in blocks of frames, so memory follows
the block and the samples, not the spectrogram.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_batches, batch_of, id_text

PAD = 64
RATE = 8000
FRAME = 256
HOP = 128
#: Frequency bands (bins of the transform) that give one peak each.
BANDS = ((1, 12), (12, 32), (32, 64), (64, 129))
#: A peak must stand this much above its frame's mean magnitude.
PEAK_OVER_MEAN = 2.0
#: A peak is paired with the peaks of as many following frames.
TARGET_FRAMES = 3
BLOCK_FRAMES = 4096


def pad_payload(payload: bytes, pad: int = PAD) -> bytes:
    size = max(pad, -(-len(payload) // pad) * pad)
    return payload.ljust(size, b"\0")


def write_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def stft_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(frame, bin) of every spectral peak in time order, and the number of frames."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128
    frames = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    x = np.concatenate([x, np.zeros((frames - 1) * HOP + FRAME - len(x), np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    taper = np.hanning(FRAME).astype(np.float32)
    at, bins = [], []
    for lo in range(0, frames, BLOCK_FRAMES):
        block = np.fft.rfft(windows[lo : lo + BLOCK_FRAMES] * taper, axis=1)
        power = block.real**2 + block.imag**2
        floor = power[:, 1:].mean(axis=1) * PEAK_OVER_MEAN
        for a, b in BANDS:
            top = power[:, a:b].argmax(axis=1)
            strong = power[np.arange(len(power)), a + top] > floor
            at.append(lo + np.flatnonzero(strong))
            bins.append((a + top)[strong])
    at, bins = np.concatenate(at), np.concatenate(bins)
    order = np.lexsort((bins, at))
    return at[order], bins[order], frames


def pair_fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Time codes and hashes (bin, target bin, frames between) of all peak pairs."""
    at, bins, frames = stft_peaks(samples)
    times, codes = [], []
    first = np.searchsorted(at, np.arange(frames + TARGET_FRAMES + 2))
    for gap in range(1, TARGET_FRAMES + 1):
        lo, hi = first[at + gap], first[at + gap + 1]
        n = hi - lo
        src = np.repeat(np.arange(len(at)), n)
        dst = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        times.append(at[src])
        codes.append((bins[src].astype(np.int32) << 16) | (bins[dst].astype(np.int32) << 4) | gap)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order], frames


def to_wav(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (unpadded), media (WAV bytes) of every text."""
    arrow_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for b in batches:
            raw = [t.encode() for t in b.column("text").to_pylist()]
            yield batch_of({"doc_id": b.column("doc_id"), "n_bytes": [len(r) for r in raw], "media": [write_wav(pad_payload(r)) for r in raw]}, schema)

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def fingerprints(media: DataFrame, keep_pairs: bool = True) -> DataFrame:
    """Reads the media column back: payload and media digests, and the fingerprint.

    `pair_times` and `pair_codes` are the time-coded arrays; `keep_pairs=False`
    leaves them out and keeps only `feature`, their summary.
    """
    extra = [("pair_times", pa.list_(pa.int32())), ("pair_codes", pa.list_(pa.int32()))] if keep_pairs else []
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), *extra])

    def one(doc_id, n_bytes, media):
        if media is None:
            return (doc_id, n_bytes, *[None] * (len(schema) - 2))
        payload = read_wav(media)
        t, c, frames = pair_fingerprint(payload)
        feature = f"frames={frames};pairs={len(t)};crc={zlib.crc32(c.tobytes(), zlib.crc32(t.tobytes())):08x}"
        row = (doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature)
        return (*row, t, c) if keep_pairs else row

    def run(batches):
        for b in batches:
            rows = [one(*r) for r in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media").to_pylist())]
            yield batch_of({f.name: [r[i] for r in rows] for i, f in enumerate(schema)}, schema)

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", pair_times array<int>, pair_codes array<int>" if keep_pairs else "")
    return media.select("doc_id", "n_bytes", F.col("media")).mapInArrow(run, ddl)
