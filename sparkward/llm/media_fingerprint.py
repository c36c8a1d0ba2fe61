"""Media columns: WAV storage, short-time Fourier transforms and spectral-peak pair fingerprints."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, texts

RATE = 8000
#: Payloads are padded to a multiple of UNIT samples; frames have UNIT samples, one every HOP.
UNIT, HOP, PAD = 192, 96, 32
#: A peak is the strongest bin of a band (first bins of the bands) within PEAK_FRAMES frames.
BANDS, PEAK_FRAMES = (1, 5, 10, 20, 40, 68, 97), 8
#: Each peak is paired with the next FAN peaks that lie at most REACH frames later.
FAN, REACH = 3, 63
#: Frames transformed at once; a multiple of PEAK_FRAMES.
BLOCK_FRAMES = 4096

SCHEMA = "doc_id long, n_bytes long, media binary, payload binary, peak_frame array<int>, pair_code array<int>"
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("peak_frame", pa.list_(pa.int32())),
    ("pair_code", pa.list_(pa.int32()))
])


def to_wav(data: bytes, rate: int = RATE) -> bytes:
    """Bytes as the samples of a WAV file, one channel of 8 bits."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(data)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file of one channel of 8 bits."""
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def spectral_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame and frequency bin of the spectral peaks, by frame, then bin."""
    x = np.frombuffer(samples, np.uint8)
    n = max(0, (len(x) - UNIT) // HOP + 1)
    taper = np.hanning(UNIT)
    frames, bins = [], []
    for first in range(0, n, BLOCK_FRAMES):
        m = min(BLOCK_FRAMES, n - first)
        part = x[first * HOP : (first + m - 1) * HOP + UNIT].astype(np.float64) - 128
        power = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(part, UNIT)[::HOP] * taper))
        whole = -(-m // PEAK_FRAMES)
        padded = np.full((whole * PEAK_FRAMES, power.shape[1]), -1.0)
        padded[:m] = power
        boxes = padded.reshape(whole, PEAK_FRAMES, -1)
        for low, high in zip(BANDS[:-1], BANDS[1:], strict=True):
            best = boxes[:, :, low:high].reshape(whole, -1).argmax(axis=1)
            frames.append(first + np.arange(whole) * PEAK_FRAMES + best // (high - low))
            bins.append(low + best % (high - low))
    if not frames:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t, f = np.concatenate(frames), np.concatenate(bins)
    order = np.lexsort((f, t))
    return t[order], f[order]


def peak_pairs(t: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time of the first peak and code (both bins and the distance) of each pair of near peaks."""
    times, codes = [], []
    for step in range(1, FAN + 1):
        gap = t[step:] - t[:-step]
        near = gap <= REACH
        times.append(t[:-step][near])
        codes.append((f[:-step][near] << 14 | f[step:][near] << 7 | gap[near]))
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return time[order], code[order]


def fingerprint_media(docs: DataFrame) -> DataFrame:
    """Stores every text of docs (doc_id, text) as sound and fingerprints what is read back.

    Returns doc_id, n_bytes (of the UTF-8 text), media (the WAV file), payload (its samples as read
    back: the text's bytes with spaces appended to a positive multiple of 192), and the fingerprint
    as time-coded arrays of equal length: peak_frame and pair_code, by time, then code.

    A null text counts as empty and becomes 192 spaces. Repeated rows stay; equal texts have equal
    values. Other columns are ignored; an empty table gives no rows. Long texts are transformed in
    blocks of frames.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(ARROW)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                media = to_wav(text + bytes([PAD]) * (-len(text) % UNIT if text else UNIT))
                payload = from_wav(media)
                time, code = peak_pairs(*spectral_peaks(payload))
                rows.add(doc_id, len(text), media, payload, time.astype(np.int32), code.astype(np.int32), size=2 * len(media))
                if rows.full:
                    yield rows.take()
        yield rows.take()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def media_digests(media: DataFrame) -> DataFrame:
    """Lengths and checksums of the stored media, and the fingerprint: its time-coded arrays, and a digest of them with the number of pairs."""
    pairs = F.concat_ws("|", F.concat_ws(",", F.col("peak_frame").cast("array<string>")), F.concat_ws(",", F.col("pair_code").cast("array<string>")))
    return media.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.size("pair_code").cast("string"), F.lit(":"), F.md5(pairs)).alias("feature"), "peak_frame", "pair_code",
    )
