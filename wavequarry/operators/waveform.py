"""Blocks, resampling, downmix tables and transcoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavequarry.sources import codecs

# ITU-R BS.775 gains (left, right) by speaker bit; low frequency is left out.
SIDE = 0.7071067811865476
STEREO_GAINS = {0: (1.0, 0.0), 1: (0.0, 1.0), 2: (SIDE, SIDE), 3: (0.0, 0.0), 4: (SIDE, 0.0), 5: (0.0, SIDE), 6: (1.0, 0.0), 7: (0.0, 1.0), 8: (0.5, 0.5), 9: (SIDE, 0.0), 10: (0.0, SIDE)}


def gains(mask: int) -> list[list[float]]:
    """Rows of left and right gains of the speakers of a mask."""
    bits = [b for b in range(18) if mask >> b & 1]
    return [[STEREO_GAINS.get(b, (0.5, 0.5))[side] for b in bits] for side in (0, 1)]


def gain_column(mask: int) -> Column:
    return F.array(*[F.array(*map(F.lit, row)) for row in gains(mask)])


def frame_blocks(frames: DataFrame, size: int, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Frames gathered in ordinal blocks: (keys, block, first_frame, frames)."""
    block = F.floor(F.col("frame_idx") / size).alias("block")
    grouped = frames.groupBy(*keys, block).agg(F.array_sort(F.collect_list(F.struct("frame_idx", "samples"))).alias("f"))
    return grouped.select(*keys, "block", (F.col("block") * size).alias("first_frame"), F.col("f.samples").alias("frames"))


def resample_block(block: np.ndarray, source: int, target: int) -> np.ndarray:
    """(n, channels) frames at another rate: the spectrum is cut or filled up."""
    n = len(block)
    m = max(1, round(n * target / source))
    if m == n or not n:
        return block
    spectrum = np.fft.rfft(block, axis=0)
    keep = min(n, m) // 2 + 1
    out = np.zeros((m // 2 + 1, block.shape[1]), complex)
    out[: min(keep, len(out))] = spectrum[: min(keep, len(out))]
    return np.fft.irfft(out, m, axis=0) * (m / n)


def next_fft_size(source: int, target: int) -> int:
    return 1 << (max(source, target) - 1).bit_length()


def resample(frames: DataFrame, source: int, target: int, key: str = "path") -> DataFrame:
    """Frames at ``target`` Hz: independent blocks, all in parallel.

    Columns (key, frame_idx, samples); samples come back as doubles.
    """
    size = max(1, next_fft_size(source, target) * source // max(source, target))
    produced = max(1, round(size * target / source))
    blocks = frame_blocks(frames.select(key, "frame_idx", "samples"), size, (key,))
    kind = frames.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k, b, rows in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                out = resample_block(np.array(rows, np.float64), source, target)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k.as_py()] * len(out), k.type), pa.array(range(b * produced, b * produced + len(out)), pa.int64()), pa.array(out.tolist(), pa.list_(pa.float64()))],
                    [key, "frame_idx", "samples"],
                )

    return blocks.select(key, "block", "frames").mapInArrow(run, f"{key} {kind}, frame_idx long, samples array<double>")


def encode_frames(frames: DataFrame, codec: str, rate: int, source: str = "f32", key: str = "path", **options) -> DataFrame:
    """(key, content, n_frames): one whole file of each key's frames in order."""
    kind = frames.schema[key].dataType.simpleString()

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame_idx")
        x = np.array(table.column("samples").to_pylist(), np.float64 if source[0] == "f" else np.int64)
        content = codecs.encode_file(x, source, codec, rate, **options)
        return pa.table([table.column(key).slice(0, 1), pa.array([content], pa.binary()), pa.array([len(x)], pa.int64())], names=[key, "content", "n_frames"])

    return frames.select(key, "frame_idx", "samples").groupBy(key).applyInArrow(build, f"{key} {kind}, content binary, n_frames long")


#: Frames of one record batch, and bytes of whole files held before they are sent on.
BATCH_FRAMES, BATCH_BYTES = 1 << 16, 4 << 20


def _decode(data: bytes, sample_type: str) -> np.ndarray:
    """(frames, channels) of a whole file."""
    from wavequarry.sources import riff

    h = riff.from_bytes(data, metadata=False)
    return codecs.decode(riff.sample_kind(h.fmt), data[h.data.offset : h.data.offset + h.data.size], h.fmt, sample_type)


def decode_contents(contents: DataFrame, sample_type: str = "f32", key: str = "path") -> DataFrame:
    """(key, frame_idx, samples) of whole files in a ``content`` column; a null file has no frames."""
    from wavequarry.functions.samples import SPARK_TYPES

    kind = contents.schema[key].dataType.simpleString()
    value = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}[SPARK_TYPES[sample_type]]

    def send(keys: pa.Array, rows: list[int], parts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        sizes = [len(x) for _, x in parts]
        places = np.concatenate([np.arange(first, first + len(x)) for first, x in parts])
        offsets = np.concatenate([[0], np.cumsum(np.repeat([x.shape[1] for _, x in parts], sizes))])
        flat = pa.array(np.concatenate([x.reshape(-1) for _, x in parts])).cast(value)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(rows, sizes))), pa.array(places, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], [key, "frame_idx", "samples"])

    def run(batches):
        for batch in batches:
            rows, parts, held = [], [], 0
            for k, raw in enumerate(batch.column(1)):
                x = _decode(raw.as_py(), sample_type) if raw.is_valid else np.zeros((0, 1))
                for cut in range(0, len(x), BATCH_FRAMES):
                    part = x[cut : cut + BATCH_FRAMES]
                    rows.append(k)
                    parts.append((cut, part))
                    held += len(part)
                    if held >= BATCH_FRAMES:
                        yield send(batch.column(0), rows, parts)
                        rows, parts, held = [], [], 0
            if held:
                yield send(batch.column(0), rows, parts)

    return contents.select(key, "content").mapInArrow(run, f"{key} {kind}, frame_idx long, samples array<{SPARK_TYPES[sample_type]}>")


def transcode(contents: DataFrame, codec: str, source_rate: int, target_rate: int, key: str = "path") -> DataFrame:
    """(key, content, n_frames): files decoded, resampled block by block and encoded again, each where it is; a null file stays null."""
    kind = contents.schema[key].dataType.simpleString()
    size = max(1, next_fft_size(source_rate, target_rate) * source_rate // max(source_rate, target_rate))
    source = "f64" if source_rate != target_rate else "f32"

    def send(keys: pa.Array, rows: list[int], files: list[bytes | None], counts: list[int | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), pa.array(files, pa.binary()), pa.array(counts, pa.int64())], [key, "content", "n_frames"])

    def run(batches):
        for batch in batches:
            rows, files, counts, held = [], [], [], 0
            for k, raw in enumerate(batch.column(1)):
                content, n = None, None
                if raw.is_valid:
                    x = _decode(raw.as_py(), "f32")
                    if source_rate != target_rate and len(x):
                        x = np.concatenate([resample_block(x[at : at + size].astype(np.float64), source_rate, target_rate) for at in range(0, len(x), size)])
                    content, n = codecs.encode_file(x, source, codec, target_rate), len(x)
                rows.append(k)
                files.append(content)
                counts.append(n)
                held += len(content or b"")
                if held >= BATCH_BYTES or len(rows) >= 1 << 10:
                    yield send(batch.column(0), rows, files, counts)
                    rows, files, counts, held = [], [], [], 0
            if rows:
                yield send(batch.column(0), rows, files, counts)

    return contents.select(key, "content").mapInArrow(run, f"{key} {kind}, content binary, n_frames long")


def coding_noise(files: DataFrame, block: int = 0) -> DataFrame:
    """(signal, noise): sums of squares of some files' samples, and of what coding has changed of them.

    Columns: ``samples``, one channel as floats, and ``content``, the file made
    of them.  Of each ``block`` decoded frames the first is no sample and left
    out.  A sample that is null, or has no frame, does not count.
    """

    def run(batches):
        for batch in batches:
            signal, noise, n = 0.0, 0.0, 0
            for told, raw in zip(batch.column(0), batch.column(1), strict=True):
                if not (told.is_valid and raw.is_valid):
                    continue
                back = _decode(raw.as_py(), "f32")[:, 0]
                if block:
                    back = np.delete(back, np.s_[::block])
                x = told.values.slice(0, len(back))
                there = x.is_valid().to_numpy(zero_copy_only=False)
                x = x.to_numpy(zero_copy_only=False).astype(np.float64)
                back = back[: len(x)].astype(np.float64)[there]
                x = x[there]
                signal, noise, n = signal + float(x @ x), noise + float(np.sum((x - back) ** 2)), n + len(x)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([signal]), pa.array([noise])], ["signal", "noise"])

    return files.select("samples", "content").mapInArrow(run, "signal double, noise double")
