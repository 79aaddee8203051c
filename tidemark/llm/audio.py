"""Operator 8: media columns, audio.

Bytes are stored as 8-bit PCM in a WAV file, read back, resampled by a polyphase filter, and
described by overlapped log-mel filterbanks and by segments that a hysteresis on the frames'
energy finds. Features are stored as fixed-shape Arrow tensors, each with its time span.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import quoted, small_batches, whole

RATE, UP, DOWN = 16_000, 1, 2
FRAME, HOP, FFT, MELS = 200, 80, 256, 40
#: Frames of one stored tensor; the last is filled up with zeros.
TENSOR_FRAMES = 64
#: Frames that are computed at a time.
BLOCK_FRAMES = 4096


def padded(data: bytes, unit: int = 64) -> bytes:
    """data with zero bytes up to a positive multiple of unit."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of 8-bit samples."""
    body = samples + bytes(len(samples) % 2)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + body


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a mono 8-bit WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache
def low_pass(up: int, down: int, half: int = 8) -> np.ndarray:
    """A windowed-sinc filter for both rates, a multiple of `up` long."""
    most = max(up, down)
    n = -(-(2 * half * most) // up) * up
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / most) * np.hamming(n)
    return (h * up / h.sum()).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Rate times up / down; each output sample costs one phase of the filter."""
    if up == down:
        return x
    h = low_pass(up, down)
    taps = len(h) // up
    n = -(-len(x) * up // down)
    y = np.empty(n, np.float32)
    around = np.concatenate((np.zeros(taps, np.float32), x, np.zeros(taps + down, np.float32)))
    lag = taps // 2
    windows = np.lib.stride_tricks.sliding_window_view(around, taps)
    for r in range(min(up, n)):
        first, phase = divmod(r * down, up)
        many = -(-(n - r) // up)
        y[r::up] = windows[first + lag + 1 :: down][:many] @ h[phase::up][::-1]
    return y


@lru_cache
def mel_bank(rate: int) -> np.ndarray:
    """Triangles over the FFT's bins, spaced evenly in mel."""
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 1400), MELS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * rate / FFT
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid))).T.astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) of log10 energies, and each frame's energy in dB; one frame at least."""
    if len(x) < FRAME:
        x = np.concatenate((x, np.zeros(FRAME - len(x), np.float32)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    mels, energy = np.empty((len(frames), MELS), np.float32), np.empty(len(frames), np.float32)
    for a in range(0, len(frames), BLOCK_FRAMES):
        block = frames[a : a + BLOCK_FRAMES] * window
        spectrum = np.fft.rfft(block, FFT)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels[a : a + BLOCK_FRAMES] = np.log10(np.maximum(power @ mel_bank(rate), 1e-10))
        energy[a : a + BLOCK_FRAMES] = 10 * np.log10(np.maximum(np.einsum("ij,ij->i", block, block) / FRAME, 1e-10))
    return mels, energy


def segments(energy: np.ndarray, rise: float = 0.5, fall: float = -0.5) -> list[tuple[int, int]]:
    """Frames [start, end) that begin above mean + rise x deviation and last until below mean + fall x deviation."""
    mean, deviation = float(energy.mean()), float(energy.std())
    if deviation < 1e-3:
        return []
    mark = np.where(energy > mean + rise * deviation, 1, np.where(energy < mean + fall * deviation, 0, -1))
    known = np.where(mark >= 0, np.arange(len(mark)), -1)
    np.maximum.accumulate(known, out=known)
    on = np.where(known >= 0, mark[known], 0)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], on, [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def tensor_table(mels: np.ndarray, energy: np.ndarray, rate: int) -> pa.Table:
    """Rows of a fixed-shape tensor with its time span in ms, and the segments that begin in it."""
    n = -(-len(mels) // TENSOR_FRAMES)
    whole_ = np.zeros((n * TENSOR_FRAMES, MELS), np.float32)
    whole_[: len(mels)] = mels
    kind = pa.fixed_shape_tensor(pa.float32(), [TENSOR_FRAMES, MELS])
    tensors = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(whole_.reshape(-1)), TENSOR_FRAMES * MELS))
    ms = lambda frame: frame * HOP * 1000 // rate
    starts = [ms(i * TENSOR_FRAMES) for i in range(n)]
    ends = [ms(min(len(mels), (i + 1) * TENSOR_FRAMES) - 1) + FRAME * 1000 // rate for i in range(n)]
    spans: list[list[dict]] = [[] for _ in range(n)]
    for a, b in segments(energy):
        spans[a // TENSOR_FRAMES].append({"start_ms": ms(a), "end_ms": ms(b)})
    return pa.table({"log_mel": tensors, "start_ms": pa.array(starts, pa.int64()), "end_ms": pa.array(ends, pa.int64()), "segments": pa.array(spans, pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())])))})


def audio_features(media: bytes) -> pa.Table:
    """The feature table of a stored file."""
    samples, rate = from_wav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    return tensor_table(*log_mel(resample(x, UP, DOWN), rate * UP // DOWN), rate * UP // DOWN)


def as_ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def described(table: pa.Table) -> str:
    """A short text of a feature table."""
    tensors = table.column("log_mel").combine_chunks()
    values = tensors.storage.flatten().to_numpy()
    spans = [s for row in table.column("segments").to_pylist() for s in row]
    listed = ",".join(f"{s['start_ms']}-{s['end_ms']}" for s in spans)
    return f"tensors={len(table)};shape={TENSOR_FRAMES}x{MELS};mean={values.mean(dtype=np.float64):.3f};max={values.max():.3f};segments={len(spans)};spans={zlib.crc32(listed.encode()):08x};end_ms={table.column('end_ms')[-1].as_py()}"


def _mapped(df: DataFrame, id_col: str, text_col: str, schema: str, row) -> DataFrame:
    """row(bytes) for each text's bytes, behind its id."""
    names = ["_id"] + [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, max(1, batch.num_rows), 512):  # features of few rows at a time
                part = batch.slice(a, 512)
                rows = [row(data.as_py()) for data in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(quoted(id_col).alias("_id"), whole(quoted(text_col)).cast("binary").alias("_data"))
    return texts.mapInArrow(run, f"_id {kind}, {schema}").toDF(id_col, *names[1:])


def audio_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, media (a WAV file of the padded bytes) and features (an Arrow stream of tensor_table)."""

    def row(data: bytes) -> tuple:
        media = to_wav(padded(data))
        return media, as_ipc(audio_features(media))

    return _mapped(df, id_col, text_col, "media binary, features binary", row)


def audio_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each whole text's bytes as audio, reads them back and describes both.

    One row for each row of df: id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of
    the samples as read back), media_bytes, media_sha256, feature. Null counts as empty: one
    unit of 64 zero bytes. Texts are worked on whole and one by one, so equal texts give equal
    values and a worker holds about 20 times the bytes of its longest text;
    an empty table gives an empty table; other columns don't matter.
    """

    def row(data: bytes) -> tuple:
        media = to_wav(padded(data))
        table = pa.ipc.open_stream(as_ipc(audio_features(media))).read_all()
        back, _ = from_wav(media)
        return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), described(table)

    return _mapped(df, id_col, text_col, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", row)
