"""Media columns: WAV payloads and spectral-peak fingerprints.

A document's bytes become 8-bit mono samples of a WAV file (written and read with the wave module). From the samples
that were read back a short-time Fourier transform is taken (Hann window); the strongest local maxima of each frame
are its peaks, and each peak is paired with the next few peaks. A pair (bin, bin, frame distance) is
one 32-bit code and keeps the frame in which it starts: two arrays, times and codes.

Null and empty texts: a payload of 64 zero bytes, no peaks, empty arrays. Equal texts give equal values. Any doc_id,
null included, is carried along; repeated rows give repeated rows; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import map_batches, table

BLOCK = 64


def to_payload(text: str | None) -> tuple[int, bytes]:
    """The text's UTF-8 length, and its bytes filled with 0 up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + bytes(-len(data) % BLOCK if data else BLOCK)


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def fingerprint(samples: bytes, frame: int = 128, hop: int = 64, peaks: int = 2, fan: int = 4, reach: int = 12, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """times, codes of the peak pairs. Spectra are held for block frames at a time."""
    x = np.frombuffer(samples, np.uint8)
    if len(x) < frame:
        x = np.concatenate([x, np.full(frame - len(x), 128, np.uint8)])
    window = np.hanning(frame + 1)[:-1].astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop]
    at, bins = [], []
    for i in range(0, len(frames), block):
        s = (frames[i : i + block].astype(np.float32) - 128) * window
        mag = np.abs(np.fft.rfft(s, axis=1))[:, 1:]
        inner = mag[:, 1:-1]
        inner = np.where((inner > mag[:, :-2]) & (inner >= mag[:, 2:]), inner, 0)
        top = np.sort(np.argpartition(inner, -peaks, axis=1)[:, -peaks:], axis=1)
        t, k = np.nonzero(np.take_along_axis(inner, top, axis=1) > 1e-3)
        at.append(t + i)
        bins.append(top[t, k] + 2)
    t, f = np.concatenate(at), np.concatenate(bins)
    times, codes = [], []
    for k in range(1, fan + 1):
        d = t[k:] - t[:-k]
        keep = d <= reach
        times.append(t[:-k][keep])
        codes.append((f[:-k][keep] << 20 | f[k:][keep] << 8 | d[keep]))
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype(np.int32), codes[order].astype(np.int32)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 8000, keep_media: bool = True, **options) -> DataFrame:
    """Columns id, n_bytes, payload (as read back), media (the WAV file), times, codes; keep_media=False leaves both
    byte columns out and gives payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 alone."""
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, times array<int>, codes array<int>"
    if keep_media:
        schema += ", payload binary, media binary"

    def make():
        def each(ids, texts):
            rows = []
            for i, text in zip(ids, texts, strict=True):
                n, payload = to_payload(text)
                media = to_wav(payload, rate)
                back = from_wav(media)
                times, codes = fingerprint(back, **options)
                row = (i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), times, codes)
                rows.append(row + (back, media) if keep_media else row)
            return list(zip(*rows, strict=True))

        return each

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col)), schema, make)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature: the number of peak pairs, and the SHA-256 of the two arrays' text."""
    out = media_columns(table(spark, sf_dir, "documents"), keep_media=False)
    digest = F.sha2(F.concat_ws("|", F.array_join("times", ","), F.array_join("codes", ",")), 256)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat_ws(":", F.size("codes").cast("string"), digest).alias("feature"))
