"""Media columns: texts as WAV sound, and fingerprints of the sound.

The wave module writes and reads 8-bit mono WAV held in a binary column. A
short-time Fourier transform (Hann windows of WINDOW samples, one every HOP) gives each
frame's strongest frequency in each of some bands; peaks well above the frame's
mean are landmarks. Each landmark is paired with those of the next frames, and
the pairs (frequency, frequency, frames between) stand in an array of longs, each
with the time of its first landmark in the high bits.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A payload is a positive multiple of so many bytes.
UNIT = 192
RATE = 8000
WINDOW, HOP = 256, 192
#: Frequency bins at which bands begin and end.
BANDS = (2, 12, 32, 64, 129)
#: A landmark's magnitude against the mean of its frame.
ABOVE = 2.0
#: Frames that a pair may span.
REACH = 2
#: Frames that are transformed at once.
BLOCK = 4096
#: Bits for frequency, frequency and frames between; time stands above them.
TIME_SHIFT = 20
_HANN = np.hanning(WINDOW).astype(np.float32)


def pad(data: bytes) -> bytes:
    """data with spaces up to a positive multiple of UNIT."""
    return data + b" " * (-len(data) % UNIT or (UNIT if not data else 0))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def landmarks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strongest bin of each frame and band, and whether it is a landmark."""
    x = samples.astype(np.float32) - 128
    frames = -(-len(x) // HOP)
    x = np.concatenate((x, np.zeros(frames * HOP + WINDOW - HOP - len(x), np.float32)))
    bins, clear = np.empty((frames, len(BANDS) - 1), np.int64), np.empty((frames, len(BANDS) - 1), bool)
    view = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    for at in range(0, frames, BLOCK):
        part = view[at : at + BLOCK]
        power = np.abs(np.fft.rfft(part * _HANN, axis=1))
        mean = power[:, BANDS[0] :].mean(1)
        for k, (low, high) in enumerate(zip(BANDS, BANDS[1:])):
            band = power[:, low:high]
            best = band.argmax(1)
            bins[at : at + BLOCK, k] = best + low
            clear[at : at + BLOCK, k] = band[np.arange(len(best)), best] > ABOVE * mean
    return bins, clear


def fingerprints(samples: np.ndarray) -> np.ndarray:
    """Time-coded pairs of landmarks, by time, gap and band."""
    bins, clear = landmarks(samples)
    time = np.arange(len(bins))[:, None]
    out = []
    for gap in range(1, REACH + 1):
        both = clear[:-gap] & clear[gap:]
        code = (time[:-gap] << TIME_SHIFT) | (bins[:-gap] << 12) | (bins[gap:] << 4) | gap
        out.append(code[both])
    return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)


SCHEMA = "n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, n_frames long, fingerprints array<long>"
#: Rows of output that a worker holds at once.
ROWS = 200


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text as a WAV column, with what the stored sound gives back.

    Returns id_col, n_bytes (UTF-8, before padding), media (the WAV file),
    payload_bytes, payload_sha256 and tail_crc32 (of its last 16 bytes), all read
    back from media, n_frames and fingerprints. A null text counts as empty and
    becomes one unit of spaces. Equal texts give equal values; repeated rows get
    a row each; an empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["_id", *(c.split()[0] for c in SCHEMA.split(", "))]
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part, rows = batch.iloc[at : at + ROWS], []
                for key, text in zip(part["_id"], part["_text"], strict=True):
                    data = (text or "").encode()
                    media = to_wav(pad(data))
                    payload = from_wav(media)
                    samples = np.frombuffer(payload, np.uint8)
                    rows.append((key, len(data), media, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), -(-len(samples) // HOP), fingerprints(samples)))
                yield pd.DataFrame(rows, columns=names)

    # As text, so that pandas doesn't turn ids with nulls among them into doubles.
    out = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text")).mapInPandas(run, f"_id string, {SCHEMA}")
    return out.select(F.col("_id").cast(kind).alias(id_col), *[c for c in out.columns if c != "_id"])


def digests(media: DataFrame) -> DataFrame:
    """to_media's rows with the media and fingerprint columns replaced by digests."""
    feature = F.concat_ws(":", F.col("n_frames").cast("string"), F.size("fingerprints").cast("string"), F.lower(F.hex(F.xxhash64("fingerprints"))))
    return media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256), "feature": feature}).drop("media", "fingerprints", "n_frames")
