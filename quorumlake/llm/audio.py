"""Audio features of 8-bit PCM media columns.

Media are mono WAV files of unsigned 8-bit samples. A task reads the samples
back from the stored bytes, resamples them by a polyphase filter (UP/DOWN), cuts
overlapped windows, takes log-mel filterbank energies, and segments by energy
with hysteresis. Each segment gives one tensor of fixed shape (PATCH frames by
MELS bands, averaged in equal parts of time) and its time span in seconds.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 8000
HEADER_BYTES = 44
UP, DOWN, TAPS = 3, 4, 16
WINDOW, HOP, MELS = 256, 128, 16
PATCH = 8
#: Hysteresis over a window's mean square: a segment opens above OPEN times the clip's median and ends below CLOSE times it.
OPEN, CLOSE = 1.05, 0.95
FRAMES_AT_ONCE = 4096


def wav(payload: Column) -> Column:
    """payload's bytes as the samples of a mono 8-bit WAV file; lossless, JVM-side."""

    def little(n: Column) -> Column:
        h = F.lpad(F.hex(n), 8, "0")
        return F.unhex(F.concat(*[F.substring(h, 7 - 2 * k, 2) for k in range(4)]))

    size = F.length(payload)
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return F.concat(F.lit(b"RIFF"), little(size + 36), F.lit(b"WAVE"), F.lit(form), F.lit(b"data"), little(size), payload)


def samples(media: bytes) -> np.ndarray:
    """The samples stored in a WAV file, read by its own header."""
    at = 12
    while media[at : at + 4] != b"data":
        at += 8 + struct.unpack_from("<I", media, at + 4)[0]
    n = struct.unpack_from("<I", media, at + 4)[0]
    return np.frombuffer(media, np.uint8, n, at + 8)


@lru_cache(1)
def _phases() -> np.ndarray:
    """UP sub-filters of TAPS taps each: a windowed sinc with the narrower band's cut-off."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    cut = 1 / max(UP, DOWN)
    h = cut * np.sinc(cut * n) * np.hamming(len(n)) * UP
    return h.reshape(TAPS, UP).T[:, ::-1].astype(np.float32).copy()


def resample(x: np.ndarray) -> np.ndarray:
    """x at UP/DOWN times its rate; each output takes the one phase of the filter that meets samples."""
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x.astype(np.float32), np.zeros(TAPS, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    n = -(-len(x) * UP // DOWN)
    out = np.empty(n, np.float32)
    for first in range(UP):
        start = first * DOWN
        rows = windows[start // UP :: DOWN][: len(range(first, n, UP))]
        out[first::UP] = rows @ _phases()[start % UP]
    return out


@lru_cache(1)
def _filters() -> tuple[np.ndarray, np.ndarray]:
    rate = RATE * UP / DOWN
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)
    edges = 700 * (10 ** (mel / 2595) - 1) * WINDOW / rate
    k = np.arange(WINDOW // 2 + 1)
    bank = np.maximum(0, np.minimum((k[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - k[:, None]) / (edges[2:] - edges[1:-1])))
    return np.hanning(WINDOW).astype(np.float32), bank.astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS log energies, mean square per frame) of overlapped windows; the last is padded."""
    frames = max(1, -(-(len(x) - WINDOW) // HOP) + 1)
    x = np.concatenate([x, np.zeros((frames - 1) * HOP + WINDOW - len(x), np.float32)]) if (frames - 1) * HOP + WINDOW > len(x) else x
    windows = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP][:frames]
    shape, bank = _filters()
    mel, energy = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    for a in range(0, frames, FRAMES_AT_ONCE):
        part = windows[a : a + FRAMES_AT_ONCE]
        spectrum = np.fft.rfft(part * shape)
        mel[a : a + FRAMES_AT_ONCE] = np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ bank + 1e-6)
        energy[a : a + FRAMES_AT_ONCE] = np.einsum("ij,ij->i", part, part) / WINDOW
    return mel, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames that rise above the upper bound and haven't fallen below the lower one; the whole clip if none does."""
    middle = float(np.median(energy))
    state = np.where(energy > OPEN * middle, 1, np.where(energy < CLOSE * middle, -1, 0))
    set_at = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = np.concatenate([[False], (set_at >= 0) & (state[set_at] == 1), [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)) or [(0, len(energy))]


def patches(mel: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """One PATCH x MELS tensor per span: means of equal parts of time."""
    sums = np.concatenate([np.zeros((1, MELS)), np.cumsum(mel, axis=0, dtype=np.float64)])
    bounds = np.array(spans)
    low = bounds[:, :1] + (bounds[:, 1:] - bounds[:, :1]) * np.arange(PATCH) // PATCH
    high = np.maximum(low + 1, bounds[:, :1] + (bounds[:, 1:] - bounds[:, :1]) * np.arange(1, PATCH + 1) // PATCH)
    return ((sums[high] - sums[low]) / (high - low)[:, :, None]).astype(np.float32)


#: What a medium's tensors are stored as: one row per span, with its times and its patch of fixed shape.
TENSORS = pa.schema([("start", pa.float64()), ("end", pa.float64()), ("patch", pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS)))])
_END_OF_STREAM = b"\xff\xff\xff\xff\x00\x00\x00\x00"


def stored_tensors(times: list[tuple[float, float]], parts: np.ndarray) -> bytes:
    """An Arrow stream of TENSORS rows."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(parts.ravel(), pa.float32()), PATCH * MELS)
    bounds = np.array(times).reshape(-1, 2)
    rows = pa.RecordBatch.from_arrays([pa.array(bounds[:, 0]), pa.array(bounds[:, 1]), pa.ExtensionArray.from_storage(TENSORS.field("patch").type, flat)], schema=TENSORS)
    return b"".join([TENSORS.serialize().to_pybytes(), rows.serialize().to_pybytes(), _END_OF_STREAM])


def read_tensors(stored: bytes) -> pa.Table:
    """The spans and fixed-shape tensors that stored_tensors() wrote."""
    return pa.ipc.open_stream(stored).read_all()


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, spans array<struct<start:double,end:double>>, level double, tensors binary"


def audio_features(media: DataFrame, media_col: str = "media") -> DataFrame:
    """The input's columns with FEATURES; the payload's figures come from the stored bytes.

    tensors is an Arrow stream of one fixed-shape tensor per span, level their
    mean. A null medium has null features; equal media have equal ones. Repeated
    rows are kept; input columns named like a feature are replaced. A medium is
    read whole and its windows by FRAMES_AT_ONCE.
    """
    names = [f.split()[0] for f in FEATURES.split(", ")]
    media = media.drop(*names)

    def features(data: bytes) -> tuple:
        x = samples(data)
        payload = x.tobytes()
        mel, energy = log_mel(resample((x.astype(np.float32) - 128) / 128))
        cut = segments(energy)
        step = HOP * DOWN / UP / RATE
        times = [(s * step, e * step) for s, e in cut]
        parts = patches(mel, cut)
        spans = [{"start": s, "end": e} for s, e in times]
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), spans, float(parts.mean(dtype=np.float64)), stored_tensors(times, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(media_col)
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = [features(x.as_py()) if x.is_valid else (None,) * len(names) for x in part.column(at)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())])), pa.float64(), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, zip(*rows, strict=True), kinds)], [*part.schema.names, *names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    return media.mapInArrow(run, f"{own}, {FEATURES}")


def text_payload(text: Column, unit: int = 576) -> Column:
    """UTF-8 bytes of text (null: none), followed by bytes 255 up to a positive multiple of unit."""
    data = F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8")
    size = F.length(data)
    room = F.when(size == 0, unit).otherwise(F.pmod(-size, F.lit(unit)))
    return F.concat(data, F.unhex(F.repeat(F.lit("FF"), room)))
