"""Audio columns: polyphase resampling, overlapped log-mel filterbanks and hysteresis energy segmentation.

Media are stored as WAV files (8-bit unsigned mono) in a Parquet column of the shared folder and read back from there.
Features of a file are fixed-shape Arrow tensors: blocks of BLOCK_FRAMES x MELS half floats with their time spans, as one
Arrow IPC stream a row, so a reader maps them without copies. They are stored with the spans of the segments in the shared
folder too, and results come from what is read back. A file is computed alone, in blocks of bounded size, so equal files
give equal bytes whatever stands beside them.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator
from math import gcd

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinweave.llm._common import make_importable, materialise, text_or_empty

SOURCE_RATE, RATE = 24_000, 16_000
UNIT, HEADER = 192, 44
FRAME, HOP, FFT, MELS, BLOCK_FRAMES = 400, 160, 512, 40, 16
HALF_TAPS = 8
#: Decibels above and below a file's mean frame energy at which a segment opens and closes.
OPEN_DB, CLOSE_DB = 0.5, -0.5
CHUNK_FRAMES = 4096


def wav_bytes(samples: bytes, rate: int = SOURCE_RATE) -> bytes:
    """A WAV file of 8-bit unsigned mono samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def wav_samples(media: bytes) -> tuple[int, bytes]:
    """Sample rate and samples of a WAV file as ``wav_bytes`` writes it."""
    rate, size = struct.unpack_from("<I", media, 24)[0], struct.unpack_from("<I", media, 40)[0]
    return rate, bytes(media[HEADER : HEADER + size])


@functools.cache
def _filters(up: int, down: int):
    """Phases x taps of a Hann-windowed sinc low-pass at the narrower of both bands."""
    import numpy as np

    taps = 2 * HALF_TAPS
    t = (np.arange(taps * up) - (taps * up - 1) / 2) / up
    cut = min(1.0, up / down)
    h = cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * t / HALF_TAPS))
    phases = h.reshape(taps, up).T
    return (phases / phases.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(x, source: int = SOURCE_RATE, target: int = RATE):
    """Polyphase resampling: each output phase is one short filter over every ``down``-th input."""
    import numpy as np

    g = gcd(source, target)
    up, down = target // g, source // g
    if up == down:
        return x
    phases = _filters(up, down)
    taps = phases.shape[1]
    n_out = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps // 2, np.float32), x, np.zeros(taps + down, np.float32)])
    y = np.zeros(n_out, np.float32)
    for m in range(min(up, n_out)):
        first, phase = divmod(m * down, up)
        count = len(range(m, n_out, up))
        part = np.zeros(count, np.float32)
        for k in range(taps):
            part += phases[phase, taps - 1 - k] * padded[first + k : first + k + down * (count - 1) + 1 : down]
        y[m::up] = part
    return y


@functools.cache
def _mel_weights():
    import numpy as np

    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(20.0), mel(RATE / 2), MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FFT, 1 / RATE)
    rise = (bins[:, None] - points[:-2]) / (points[1:-1] - points[:-2])
    fall = (points[2:] - bins[:, None]) / (points[2:] - points[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32), np.hanning(FRAME).astype(np.float32)


def log_mel(y):
    """Frames x MELS log energies and the frames' energies in decibels; the last frame is padded, so no sample is lost."""
    import numpy as np

    weights, window = _mel_weights()
    frames = max(1, -(-(len(y) - FRAME) // HOP) + 1)
    padded = np.concatenate([y, np.zeros((frames - 1) * HOP + FRAME - len(y), np.float32)]) if (frames - 1) * HOP + FRAME > len(y) else y
    framed = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP][:frames]
    out, energy = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    for at in range(0, frames, CHUNK_FRAMES):
        power = np.abs(np.fft.rfft(framed[at : at + CHUNK_FRAMES] * window, FFT)).astype(np.float32) ** 2
        out[at : at + CHUNK_FRAMES] = np.log(power @ weights + 1e-6)
        energy[at : at + CHUNK_FRAMES] = 10 * np.log10(power.sum(axis=1) + 1e-6)
    return out, energy


def segments(energy) -> list[tuple[float, float]]:
    """Spans in seconds: opened where energy passes the upper threshold, closed where it falls below the lower one."""
    import numpy as np

    mean = float(energy.mean())
    state = np.where(energy > mean + OPEN_DB, 1, np.where(energy < mean + CLOSE_DB, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    active = np.where(known >= 0, state[np.maximum(known, 0)], 0)
    edges = np.diff(np.concatenate([[0], active, [0]]))
    return [(float(a * HOP / RATE), float(b * HOP / RATE)) for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True)]


TENSOR = pa.fixed_shape_tensor(pa.float16(), [BLOCK_FRAMES, MELS])
TENSOR_SCHEMA = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("log_mel", TENSOR)])


def tensor_stream(mels) -> bytes:
    """Arrow IPC stream of fixed-shape blocks with their spans; the last block is padded with the lowest log energy."""
    import numpy as np

    frames = len(mels)
    blocks = -(-frames // BLOCK_FRAMES)
    data = np.full((blocks * BLOCK_FRAMES, MELS), np.log(np.float32(1e-6)), np.float16)
    data[:frames] = mels
    storage = pa.FixedSizeListArray.from_arrays(pa.array(data.reshape(-1)), BLOCK_FRAMES * MELS)
    starts = np.arange(blocks) * (BLOCK_FRAMES * HOP / RATE)
    ends = (np.minimum((np.arange(blocks) + 1) * BLOCK_FRAMES, frames) - 1) * (HOP / RATE) + FRAME / RATE
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TENSOR_SCHEMA) as out:
        out.write_batch(pa.record_batch([pa.array(starts), pa.array(ends), pa.ExtensionArray.from_storage(TENSOR, storage)], schema=TENSOR_SCHEMA))
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from twinweave.llm.token_store import pieces_of

    for batch in batches:
        for rows in pieces_of(batch):
            sizes, media = [], []
            for text in rows.column(1):
                data = text.as_py().encode()
                sizes.append(len(data))
                media.append(wav_bytes(data + b" " * (-len(data) % UNIT if data else UNIT)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


FEATURES = "n_frames long, spans array<struct<start_s:double,end_s:double>>, tensors binary"


def _features(at: int, keep_media: bool):
    """Batches of rows with media in column ``at`` to the same rows with the features behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from twinweave.llm.token_store import pieces_of

        span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        for batch in batches:
            for rows in pieces_of(batch, column=at):
                frames, spans, tensors = [], [], []
                for media in rows.column(at):
                    rate, samples = wav_samples(media.as_buffer().to_pybytes())
                    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
                    mels, energy = log_mel(resample(x, rate))
                    frames.append(len(mels))
                    spans.append([{"start_s": a, "end_s": b} for a, b in segments(energy)])
                    tensors.append(tensor_stream(mels))
                kept = [i for i in range(rows.num_columns) if keep_media or i != at]
                arrays = [*[rows.column(i) for i in kept], pa.array(frames, pa.int64()), pa.array(spans, span), pa.array(tensors, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [*[rows.schema.names[i] for i in kept], "n_frames", "spans", "tensors"])

    return run


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: texts as WAV files, written to the shared folder and read from there."""
    make_importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return materialise(rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary"), "media")


def payload(media: Column) -> Column:
    """The samples of a stored file: what follows the header of 44 bytes."""
    return F.substring(media, HEADER + 1, 2**31 - 1)


def audio_features(media: DataFrame, keep_media: bool = True) -> DataFrame:
    """The rows of ``media`` with n_frames, spans and tensors of each stored file, read back from the shared folder.

    Without ``keep_media`` the files are not stored a second time. Null and empty texts are one unit of spaces. Very long
    files are framed in chunks. Repeated rows and ids are rows of their own, null ids stay null, an empty table gives an
    empty table; columns of ``media`` must not be called n_frames, spans or tensors.
    """
    make_importable(media.sparkSession)
    kept = T.StructType([f for f in media.schema if keep_media or f.name != "media"])
    schema = T.StructType([*kept, *T._parse_datatype_string(FEATURES)])
    return materialise(media.mapInArrow(_features(media.columns.index("media"), keep_media), schema), "audio-features")
