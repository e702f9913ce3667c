"""Media columns: payloads as 8-bit audio, and features of it as fixed-shape tensors with time spans.

A payload is stored as the samples of a mono 8-bit WAV file. Features: polyphase resampling from 16 kHz to
10 kHz, log-mel energies of overlapped windows, and segments of activity by two thresholds on frame energy
(one to begin, a lower one to end). Log-mel frames come in tensors of a fixed shape, each with its time span;
the last one is padded with zeros. Samples are worked on in bounded pieces, so a long one needs no more memory.

Cases: a null or empty text is one block of padding; equal payloads have equal media and features; silence
has no segment; rows are independent, so repeated ones agree; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from multirun.llm.common import small_batches, stored

RATE, UP, DOWN, TAPS = 16_000, 5, 8, 12
OUT_RATE = RATE * UP // DOWN
FRAME, HOP, MELS = 256, 128, 24
#: Frames in a tensor.
SHAPE = (64, MELS)
#: Decibels above a payload's median frame energy at which a segment begins, and below which it ends.
BEGIN_DB, END_DB = 1.5, 0.5
#: Payload padding of the contract: bytes 255 up to a positive multiple of this.
BLOCK = 576
#: Samples worked on at once; a multiple of DOWN.
PIECE = DOWN << 15


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit PCM file."""
    pad = b"\0" * (len(samples) & 1)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(samples)) + samples + pad
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def samples_of(data: bytes) -> bytes:
    """The samples of such a file, by walking its chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"data":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


@functools.cache
def bank() -> np.ndarray:
    """Coefficients of the UP phases over one block of input: a windowed-sinc low pass at the lower Nyquist rate."""
    width = DOWN + TAPS
    out = np.zeros((width, UP))
    for r in range(UP):
        centre = r * DOWN / UP + TAPS / 2
        t = np.arange(width) - centre
        w = np.where(np.abs(t) <= TAPS / 2, 0.5 + 0.5 * np.cos(2 * np.pi * t / TAPS), 0)
        out[:, r] = np.sinc(t * UP / DOWN) * w
        out[:, r] /= out[:, r].sum()
    return out.astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """UP/DOWN of the rate: every block of DOWN samples gives UP, each phase by its own filter."""
    n = -(-len(x) // DOWN)
    padded = np.zeros(n * DOWN + TAPS + DOWN, np.float32)
    padded[TAPS // 2 : TAPS // 2 + len(x)] = x
    out = np.empty((n, UP), np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(padded, DOWN + TAPS)[: n * DOWN : DOWN]
    for i in range(0, n, 1 << 14):
        np.matmul(windows[i : i + (1 << 14)], bank(), out=out[i : i + (1 << 14)])
    return out.ravel()


@functools.cache
def mel_bank() -> np.ndarray:
    """Triangles equally spaced on the mel scale."""
    top = 2595 * np.log10(1 + OUT_RATE / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    f = np.arange(FRAME // 2 + 1) * OUT_RATE / FRAME
    up, down = (f[:, None] - hz[:-2]) / np.diff(hz)[:-1], (hz[2:] - f[:, None]) / np.diff(hz)[1:]
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_WINDOW = np.hanning(FRAME).astype(np.float32)


@dataclass
class Features:
    #: (frames, MELS) log-mel energies, in hundredths, as stored.
    mel: np.ndarray
    #: Seconds at which segments begin and end.
    segments: list[tuple[float, float]]

    def tensors(self) -> list[tuple[float, float, np.ndarray]]:
        """Time span and fixed-shape tensor of every group of frames."""
        out = []
        for i in range(0, len(self.mel), SHAPE[0]):
            t = np.zeros(SHAPE, np.float32)
            part = self.mel[i : i + SHAPE[0]]
            t[: len(part)] = part / 100
            out.append((i * HOP / OUT_RATE, ((i + len(part) - 1) * HOP + FRAME) / OUT_RATE, t))
        return out


def hysteresis(level: np.ndarray, begin: float, end: float) -> list[tuple[int, int]]:
    """Runs of frames that rise over ``begin`` and last until they fall below ``end``."""
    mark = np.where(level >= begin, 1, np.where(level < end, -1, 0))
    seen = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.concatenate([[False], (seen >= 0) & (mark[seen] == 1), [False]]).astype(np.int8)
    edge = np.diff(on)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def analyse(samples: bytes, rest: bool = False) -> Features:
    """Features of a payload's full frames; with ``rest``, what is left after them is a frame too, filled up with zeros."""
    x = np.frombuffer(samples, np.uint8)
    mels, power, held = [], [], np.zeros(0, np.float32)
    for i in range(0, max(len(x), 1), PIECE):
        # a filter reaches TAPS/2 samples past its block: resample with that margin and cut it off
        lo, hi = max(0, i - 2 * DOWN), min(len(x), i + PIECE + 2 * DOWN)
        part = resample((x[lo:hi].astype(np.float32) - 128) / 128)
        skip, n = (i - lo) // DOWN * UP, -(-(min(len(x), i + PIECE) - i) // DOWN) * UP
        y = np.concatenate([held, part[skip : skip + n]])
        if i + PIECE >= len(x):
            if len(y) < FRAME and not mels:
                y = np.concatenate([y, np.zeros(FRAME - len(y), np.float32)])
            elif rest:
                # a frame before these has all but what is beyond FRAME - HOP
                y = np.concatenate([y, np.zeros((-(len(y) - FRAME)) % HOP, np.float32)])
        k = (len(y) - FRAME) // HOP + 1 if len(y) >= FRAME else 0
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[: k * HOP : HOP] if k else np.zeros((0, FRAME), np.float32)
        for a in range(0, k, 2048):
            s = np.fft.rfft(frames[a : a + 2048] * _WINDOW, axis=1)
            p = (s.real**2 + s.imag**2).astype(np.float32)
            mels.append(np.round(1000 * np.log10(p @ mel_bank() + 1e-6)).astype(np.int16))
            power.append(p.sum(axis=1))
        held = y[k * HOP :]
    mel = np.concatenate(mels) if mels else np.zeros((0, MELS), np.int16)
    level = 10 * np.log10(np.concatenate(power) + 1e-6) if power else np.zeros(0)
    level = np.round(level, 2)
    mid = float(np.median(level)) if len(level) else 0.0
    runs = hysteresis(level, mid + BEGIN_DB, mid + END_DB)
    return Features(mel, [(a * HOP / OUT_RATE, ((z - 1) * HOP + FRAME) / OUT_RATE) for a, z in runs])


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % BLOCK or (0 if raw else BLOCK))


MEDIA = "doc_id bigint, n_bytes bigint, media binary"


def encode(docs: DataFrame) -> DataFrame:
    """Whole texts as audio files: ``doc_id, n_bytes, media``."""
    small_batches(docs.sparkSession)

    def f(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for i in range(0, b.num_rows, 256):
                t = texts.slice(i, 256).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, 256), pa.array([len((x or "").encode()) for x in t], pa.int64()), pa.array([wav(payload_of(x)) for x in t], pa.binary())], names=["doc_id", "n_bytes", "media"]
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(f, MEDIA)


TENSORS = "doc_id bigint, nth int, t_begin double, t_end double, tensor array<float>"


def tensors(media: DataFrame) -> DataFrame:
    """One row per fixed-shape tensor with its time span."""

    def f(batches):
        for b in batches:
            for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, (t0, t1, t) in enumerate(analyse(samples_of(m), rest=True).tensors()):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i], pa.int64()), pa.array([k], pa.int32()), pa.array([t0]), pa.array([t1]), pa.array([t.ravel()], pa.list_(pa.float32()))],
                        names=["doc_id", "nth", "t_begin", "t_end", "tensor"],
                    )

    return media.select("doc_id", "media").mapInArrow(f, TENSORS)


def to_arrow(rows: pa.Table) -> pa.Table:
    """Rows of ``tensors`` with the last column as Arrow's fixed-shape tensor type."""
    flat = rows["tensor"].combine_chunks()
    values = flat.flatten().cast(pa.float32())
    kind = pa.fixed_shape_tensor(pa.float32(), SHAPE)
    fixed = pa.FixedSizeListArray.from_arrays(values, SHAPE[0] * SHAPE[1])
    return rows.set_column(rows.schema.get_field_index("tensor"), "tensor", pa.ExtensionArray.from_storage(kind, fixed))


DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
#: A document's digests and tensors: frames, segments' and tensors' begins and ends in turn, and SHAPE 16-bit hundredths per tensor.
MEASURED = DIGEST.replace("feature string", "frames bigint, segments array<double>, spans array<double>, tensors array<binary>")
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "array<double>": pa.list_(pa.float64()), "array<binary>": pa.list_(pa.binary())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(cols, types, strict=True)], names=list(names))


def measured(media: DataFrame) -> DataFrame:
    """One row per document, with its fixed-shape tensors and their time spans; they cover the whole payload."""

    def f(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                rows = []
                for i, n, m in zip(*(b.column(k).slice(at, 64).to_pylist() for k in range(3)), strict=True):
                    p = samples_of(m)
                    a = analyse(p, rest=True)
                    found = a.tensors()
                    rows.append(
                        (i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), len(a.mel), [x for s in a.segments for x in s],
                         [x for t in found for x in t[:2]], [np.round(t[2] * 100).astype("<i2").tobytes() for t in found])
                    )
                yield _batch(rows, MEASURED)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(f, MEASURED)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns, from measured documents; the feature is what their tensors and spans say."""

    def f(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                rows = []
                for *head, frames, flat, spans, parts in zip(*(b.column(k).slice(at, 64).to_pylist() for k in range(11)), strict=True):
                    mel = np.frombuffer(b"".join(parts), "<i2").reshape(-1, MELS)[:frames]
                    segments = np.asarray(flat, "<f8").reshape(-1, 2)
                    active = sum(z - s for s, z in segments.tolist())
                    feature = (
                        f"frames={len(mel)};tensors={len(spans) // 2};segments={len(segments)};active={active:.3f}"
                        f";mel={hashlib.sha256(mel.tobytes()).hexdigest()[:16]};spans={hashlib.sha256(segments.tobytes()).hexdigest()[:16]}"
                    )
                    rows.append((*head, feature))
                yield _batch(rows, DIGEST)

    return found.select(*(x.split()[0] for x in MEASURED.split(", "))).mapInArrow(f, DIGEST)


def described(media: DataFrame) -> DataFrame:
    """The contract's columns, from stored media."""
    return digest(measured(media))


def media_features(docs: DataFrame) -> DataFrame:
    """Stores the media as a table in the shared folder, and their tensors and spans as another, and describes these."""
    return digest(stored(measured(stored(encode(docs), "media", compression="zstd")), "tensors", compression="zstd"))
