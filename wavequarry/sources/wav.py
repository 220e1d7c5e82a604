"""The ``wav`` data source.

``spark.read.format("wav").option("view", v).load(path)`` reads files at one
of the grains ``files chunks blocks frames mono stereo cues plst adtl info
junk id3 hash``.  Filters on
``path``, ``frame_idx`` and ``block_idx`` are pushed into the reader, which
then reads only the byte ranges they leave.  Large files are split by size at
planning; headers are read in the tasks.  A file that cannot be read is a row
of the ``files`` view with its ``error``; other views go on without it, and
mode ``FAILFAST`` stops.

``df.write.format("wav")`` writes rows of (path, content): files are written
to a folder of the job and moved at its end, so that failed and retried tasks
leave nothing; ``overwrite`` then replaces what was there.
"""

from __future__ import annotations

import fnmatch
import hashlib
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from wavequarry.functions.samples import SPARK_TYPES

from . import codecs, flac, riff

SPLIT_BYTES = 64 << 20
BLOCK_FRAMES = 4096
#: Frames of a record batch, about, and rows or bytes of one at other grains.
BATCH_FRAMES, BATCH_ROWS, BATCH_BYTES = 1 << 16, 1 << 10, 4 << 20
#: Files that a thread of a commit moves or deletes in turn: threads that take them one by one wait for each other.
COMMIT_FILES = 512
_LOOPS = "array<struct<identifier:bigint,type:bigint,start:bigint,end:bigint,fraction:bigint,play_count:bigint>>"
VIEWS = {
    "files": (
        "path string, container string, file_length bigint, spec struct<channels:int,channel_mask:bigint,sample_rate:bigint,bits_per_sample:int,sample_format:string>, "
        "fmt struct<format_tag:int,channels:int,sample_rate:bigint,byte_rate:bigint,block_align:int,bits_per_sample:int,ext_len:int,ext_kind:string>, "
        "fact bigint, data_offset bigint, data_length bigint, total_frames bigint, slnt bigint, "
        "bext struct<description:string,originator:string,originator_ref:string,origination_date:string,origination_time:string,time_ref:decimal(20,0),version:int,umid:binary>, "
        "inst struct<base_note:smallint,detune:smallint,gain:smallint,low_note:smallint,high_note:smallint,low_velocity:smallint,high_velocity:smallint>, "
        "acid struct<flags:bigint,root_node:int,num_beats:bigint,meter_denominator:int,meter_numerator:int,tempo:float>, trkn struct<track_no:int,total_tracks:int>, "
        f"smpl struct<manufacturer:bigint,product:bigint,sample_period:bigint,midi_unity_note:bigint,midi_pitch_fraction:bigint,smpte_format:bigint,smpte_offset:bigint,sampler_data:bigint,loops:{_LOOPS}>, "
        "axml string, ixml string, id3 binary, info map<string,string>, corrupt_chunks array<string>, fmt_ext map<string,bigint>, error string"
    ),
    "chunks": "path string, ordinal int, flag string, offset bigint, size bigint, payload binary",
    "blocks": "path string, block_idx bigint, first_frame bigint, n_frames int, payload binary",
    "cues": "path string, ordinal int, cue_point_id bigint, position bigint, data_chunk_id string, chunk_start bigint, block_start bigint, offset bigint",
    "plst": "path string, ordinal int, cue_point_id bigint, num_samples bigint, repeats bigint",
    "adtl": "path string, ordinal int, kind string, cue_point_id bigint, data string, sample_length bigint, purpose_id string, country int, language int, dialect int, code_page int, media_type bigint, file_data binary",
    "info": "path string, key string, value string",
    "junk": "path string, ordinal int, size bigint, payload binary",
    "id3": "path string, ordinal int, frame string, value string",
    "hash": "path string, offset bigint, length bigint, sha256 string",
}
#: Views at the grain of a frame.
FRAME_VIEWS = ("frames", "mono", "stereo")
ARROW_TYPES = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "decimal(20,0)": pa.decimal128(20, 0), "float": pa.float32(), "double": pa.float64()}


def _frames_schema(sample_type: str, view: str = "frames") -> str:
    kind = SPARK_TYPES[sample_type]
    return f"path string, frame_idx bigint, {({'frames': f'samples array<{kind}>', 'mono': f'sample {kind}', 'stereo': f'l {kind}, r {kind}'})[view]}"


def mono(x: np.ndarray, target: str) -> np.ndarray:
    """(frames,) mean of all channels; integers lose the fraction."""
    if x.shape[1] == 1:
        return x[:, 0]
    mean = x.astype(np.float64).mean(axis=1)
    return mean.astype(x.dtype) if target[0] == "f" else np.trunc(mean).astype(np.int64)


def stereo(x: np.ndarray, target: str, mask: int = 0) -> np.ndarray:
    """(frames, 2): mono twice, stereo as it is, more channels mixed down by the mask's speakers."""
    if x.shape[1] == 1:
        return np.repeat(x, 2, axis=1)
    if x.shape[1] == 2:
        return x
    from wavequarry.functions.spec import DEFAULT_MASKS
    from wavequarry.operators.waveform import gains

    weights = np.array(gains(mask or DEFAULT_MASKS[x.shape[1]]))
    if weights.shape[1] != x.shape[1]:
        raise ValueError("the channel mask does not fit the channels")
    mixed = x.astype(np.float64) @ weights.T
    if target[0] == "f":
        return mixed.astype(x.dtype)
    low, high = codecs._range(target)
    return np.clip(np.trunc(mixed), low, high).astype(np.int64)


def _samples(x: np.ndarray, target: str) -> pa.Array:
    kind = ARROW_TYPES[SPARK_TYPES[target]]
    return pa.array(x.tolist(), kind) if target == "u64" else pa.array(np.ascontiguousarray(x), pa.from_numpy_dtype(x.dtype)).cast(kind)


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    if pa.types.is_map(kind):
        values = [None if v is None else list(v.items()) for v in values]
    return pa.array(values, kind)


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def list_files(path: str, pattern: str = "*.wav") -> list[tuple[str, int]]:
    fs, local = _filesystem(path)
    info = fs.get_file_info(local)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = fs.get_file_info(pafs.FileSelector(local, recursive=True))
    prefix = path.rstrip("/")
    return sorted((prefix + f.path[len(local.rstrip("/")) :], f.size) for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and not f.base_name.startswith((".", "_")))


@dataclass
class WavSplit(InputPartition):
    files: list[tuple[str, int]]
    part: int = 0
    parts: int = 1


class WavReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema
        self.view = options.get("view", "frames")
        self.paths: set[str] | None = None
        self.least, self.past = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        grain = "frame_idx" if self.view in FRAME_VIEWS else "block_idx" if self.view == "blocks" else None
        for f in filters:
            name = getattr(f, "attribute", ())
            value = getattr(f, "value", None)
            if isinstance(f, EqualTo) and name == ("path",):
                self.paths = {value} if self.paths is None else self.paths & {value}
            elif name == (grain,) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.least = max(self.least, value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.past = min(self.past, value + (not isinstance(f, LessThan)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        limit = int(self.options.get("splitbytes", SPLIT_BYTES))
        out, held, size = [], [], 0
        for path, n in list_files(self.options["path"], self.options.get("pattern", "*.wav")):
            if self.paths is not None and path not in self.paths:
                continue
            if n > limit and self.view in (*FRAME_VIEWS, "blocks"):
                parts = -(-n // limit)
                out += [WavSplit([(path, n)], k, parts) for k in range(parts)]
                continue
            held, size = [*held, (path, n)], size + n
            if size >= limit or len(held) >= 1000:
                out.append(WavSplit(held))
                held, size = [], 0
        return out + [WavSplit(held)] if held or not out else out

    def read(self, partition: WavSplit) -> Iterator[pa.RecordBatch]:
        rows = self._rows(partition)
        return self._batches(rows) if self.view in FRAME_VIEWS else self._row_batches(rows)

    def _row_batches(self, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        """Rows by column, which takes Arrow less than Spark's conversion of each value."""
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        held, size = [], 0

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([_column(values, field.type) for values, field in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        for row in rows:
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, bytes | str))
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield send()
                held, size = [], 0
        if held:
            yield send()

    def _batches(self, parts: Iterator[tuple[str, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Parts of small files put together, as each batch costs more than their frames do."""
        held, n = [], 0
        for part in parts:
            held.append(part)
            n += len(part[2])
            if n >= BATCH_FRAMES:
                yield self._batch(held)
                held, n = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, parts: list[tuple[str, int, np.ndarray]]) -> pa.RecordBatch:
        target, sizes = self.options.get("sampletype", "f32"), [len(x) for *_, x in parts]
        places = np.arange(sum(sizes)) + np.repeat(np.array([first for _, first, _ in parts]) - np.cumsum([0, *sizes[:-1]]), sizes)
        paths = pa.array([path for path, *_ in parts], pa.string()).take(pa.array(np.repeat(np.arange(len(parts)), sizes)))
        if self.view == "frames":
            offsets = np.concatenate([[0], np.cumsum(np.repeat([x.shape[1] for *_, x in parts], sizes))])
            values = _samples(np.concatenate([x.reshape(-1) for *_, x in parts]), target)
            columns = {"samples": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)}
        else:
            both = np.concatenate([x for *_, x in parts])
            columns = {name: _samples(both[:, k], target) for k, name in enumerate(["sample"] if self.view == "mono" else ["l", "r"])}
        return pa.RecordBatch.from_pydict({"path": paths, "frame_idx": pa.array(places, pa.int64()), **columns})

    def _rows(self, partition: WavSplit) -> Iterator[tuple]:
        mode = self.options.get("mode", "PERMISSIVE").upper()
        for path, length in partition.files:
            fs, local = _filesystem(path)
            with fs.open_input_file(local) as handle:

                def fetch(at: int, n: int, handle=handle) -> bytes:
                    handle.seek(at)
                    return handle.read(n)

                try:
                    header = riff.read_header(fetch, length, self.view not in (*FRAME_VIEWS, "blocks", "chunks", "hash"), self.options.get("codepage"), mode)
                except riff.WavError as error:
                    if mode == "FAILFAST":
                        raise
                    if self.view == "files":
                        yield (path, None, length, *[None] * (len(self.schema) - 4), str(error))
                    continue
                yield from getattr(self, f"_{self.view}")(path, length, header, fetch, partition)

    def _files(self, path, length, h, fetch, split):
        f, m = h.fmt, h.meta
        kind = riff.sample_kind(f)
        form = "Float" if kind[0] == "f" and kind != "flac" else "UInt" if kind == "u8" else "Int" if kind[0] == "i" and kind != "ima" else "Unknown"
        spec = (f["channels"], f["channel_mask"], f["sample_rate"], f["bits_per_sample"], form)
        fmt = tuple(f[k] for k in ("format_tag", "channels", "sample_rate", "byte_rate", "block_align", "bits_per_sample", "ext_len", "ext_kind"))

        def struct_of(name: str):
            return tuple(m[name].values()) if name in m else None

        bext = m.get("bext")
        if bext:
            from decimal import Decimal

            bext = (*list(bext.values())[:5], Decimal(bext["time_ref"]), bext["version"], bext["umid"])
        smpl = m.get("smpl")
        if smpl:
            smpl = (*[v for k, v in smpl.items() if k != "loops"], [tuple(x.values()) for x in smpl["loops"]])
        total = flac.stream_info(fetch(h.data.offset, min(42, h.data.size)))["frames"] if kind == "flac" else codecs.total_frames(kind, f, h.data.size)
        yield (path, h.container, length, spec, fmt, h.fact, h.data.offset, h.data.size, total, m.get("slnt"), bext, struct_of("inst"), struct_of("acid"), struct_of("trkn"), smpl, m.get("axml"), m.get("ixml"), m.get("id3"), m["info"], h.corrupt, f["ext_values"] or None, None)

    def _chunks(self, path, length, h, fetch, split):
        for k, c in enumerate(h.chunks):
            yield path, k, c.flag.decode("latin-1"), c.offset, c.size, None if c.flag == b"data" else fetch(c.offset, c.size)

    def _cues(self, path, length, h, fetch, split):
        for k, c in enumerate(h.meta.get("cues", [])):
            yield path, k, *c.values()

    def _plst(self, path, length, h, fetch, split):
        for k, c in enumerate(h.meta.get("plst", [])):
            yield path, k, *c.values()

    def _adtl(self, path, length, h, fetch, split):
        for k, c in enumerate(h.meta["adtl"]):
            yield path, k, *c.values()

    def _info(self, path, length, h, fetch, split):
        for k, v in sorted(h.meta["info"].items()):
            yield path, k, v

    def _junk(self, path, length, h, fetch, split):
        for k, body in enumerate(h.meta["junk"]):
            yield path, k, len(body), body

    def _id3(self, path, length, h, fetch, split):
        for k, (frame, value) in enumerate(riff.id3_frames(h.meta.get("id3") or b"")):
            yield path, k, frame, value

    def _hash(self, path, length, h, fetch, split):
        """The hash of the data chunk's bytes from ``hashfrom``, ``hashlen`` of them or all."""
        at = min(max(0, int(self.options.get("hashfrom", 0))), h.data.size)
        n = min(int(self.options.get("hashlen", h.data.size)), h.data.size - at)
        sha = hashlib.sha256()
        for begin in range(0, n, 1 << 20):
            sha.update(fetch(h.data.offset + at + begin, min(1 << 20, n - begin)))
        yield path, at, n, sha.hexdigest()

    def _spans(self, h: riff.Header, split: WavSplit) -> Iterator[tuple[int, int, int, int]]:
        """(block, first frame, byte offset, bytes) of this split's blocks."""
        kind = riff.sample_kind(h.fmt)
        size, n = codecs.block_bytes_and_frames(kind, h.fmt)
        if not size:  # only the whole file decodes
            if split.part == 0:
                yield 0, 0, h.data.offset, h.data.size
            return
        step = BLOCK_FRAMES if n == 1 else 1
        blocks = -(-h.data.size // (size * step))
        for b in range(blocks * split.part // split.parts, blocks * (split.part + 1) // split.parts):
            at = b * size * step
            yield b, b * n * step, h.data.offset + at, min(size * step, h.data.size - at)

    def _blocks(self, path, length, h, fetch, split):
        kind = riff.sample_kind(h.fmt)
        for b, first, at, n in self._spans(h, split):
            if self.least <= b < self.past:
                payload = fetch(at, n)
                yield path, b, first, flac.stream_info(payload)["frames"] if kind == "flac" else codecs.total_frames(kind, h.fmt, n), payload

    def _frames(self, path, length, h, fetch, split):
        """(path, first frame, values by frame) of parts of up to ``BATCH_FRAMES`` frames."""
        target, kind = self.options.get("sampletype", "f32"), riff.sample_kind(h.fmt)
        _, per_block = codecs.block_bytes_and_frames(kind, h.fmt)
        for _, first, at, n in self._spans(h, split):
            held = BLOCK_FRAMES if per_block == 1 else per_block
            if first >= self.past or (held and first + held <= self.least):
                continue
            # what stands behind the last frame asked for is neither read nor decoded
            few = codecs.leading_bytes(kind, h.fmt, self.past - first)
            x = codecs.decode(kind, fetch(at, n if few is None else min(n, few)), h.fmt, target)
            begin, end = max(0, self.least - first), min(len(x), self.past - first)
            for cut in range(begin, end, BATCH_FRAMES):
                part = x[cut : min(end, cut + BATCH_FRAMES)]
                if self.view == "mono":
                    part = mono(part, target).reshape(-1, 1)
                elif self.view == "stereo":
                    part = stereo(part, target, h.fmt["channel_mask"])
                yield path, first + cut, part

    _mono = _stereo = _frames


def _in_turn(pool: ThreadPoolExecutor, act: Callable, items: list) -> None:
    """``act`` on every item, each thread on a run of them."""

    def run(begin: int) -> None:
        for item in items[begin : begin + COMMIT_FILES]:
            act(item)

    list(pool.map(run, range(0, len(items), COMMIT_FILES)))


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class WavWriter(DataSourceWriter):
    """Rows of (path, content); paths are relative to the target folder."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        self.job = f".job-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        fs, local = _filesystem(self.folder)
        base = local.rstrip("/")
        fs.create_dir(f"{base}/{self.job}", recursive=True)
        moves = []
        for row in rows:
            part = f"{base}/{self.job}/{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as out:
                out.write(bytes(row["content"]))
            moves.append((part, f"{base}/{row['path']}"))
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        fs, local = _filesystem(self.folder)
        moves = [m for x in messages if x for m in x.moves]
        with ThreadPoolExecutor(16) as pool:
            if self.overwrite and fs.get_file_info(local).type == pafs.FileType.Directory:
                found = fs.get_file_info(pafs.FileSelector(local, recursive=True))
                _in_turn(pool, fs.delete_file, [f.path for f in found if f.type == pafs.FileType.File and f"/{self.job}/" not in f.path])
            for folder in sorted({target.rpartition("/")[0] for _, target in moves}):
                fs.create_dir(folder, recursive=True)
            _in_turn(pool, lambda m: fs.move(*m), moves)
        self._clear(fs, local)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_filesystem(self.folder))

    def _clear(self, fs: pafs.FileSystem, local: str) -> None:
        """Remove the job's folder, with what failed and retried tasks have left in it."""
        folder = f"{local.rstrip('/')}/{self.job}"
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)


class WavDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        view = self.options.get("view", "frames")
        return _frames_schema(self.options.get("sampletype", "f32"), view) if view in FRAME_VIEWS else VIEWS[view]

    def reader(self, schema: StructType) -> DataSourceReader:
        return WavReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WavWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("wav")`` known to a session and turn filter pushdown on."""
    spark.dataSource.register(WavDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _plain(value):
    """A struct, map or list of a column as dictionaries and lists, nulls left out."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return dict(value) if value and isinstance(value[0], tuple) else [_plain(v) for v in value]
    return int(value) if type(value).__name__ == "Decimal" else value


def content_column(samples, channels: int, source: str, codec: str, rate: int, meta=None, **options):
    """BINARY column: a whole file of interleaved samples of type ``source``.

    ``meta``: metadata chunks of all files (a dictionary in the form of
    ``riff.Header.meta``), or of each file (a column of structs in that form).
    A null waveform gives null.
    """
    from pyspark.sql import Column
    from pyspark.sql import functions as F
    from pyspark.sql.functions import arrow_udf

    each = isinstance(meta, Column)
    same = None if each else meta

    @arrow_udf("binary")
    def build(values: pa.Array, metas: pa.Array) -> pa.Array:
        out = []
        for v, m in zip(values, metas, strict=True):
            if not v.is_valid:
                out.append(None)
                continue
            flat = np.asarray(v.values).astype(np.float64 if source[0] == "f" else np.int64)
            own = _plain(m.as_py()) if each else same
            out.append(codecs.encode_file(flat[: len(flat) // channels * channels].reshape(-1, channels), source, codec, rate, meta=own, **options))
        return pa.array(out, pa.binary())

    return build(samples, meta if each else F.lit(None).cast("int"))


def widen(samples: np.ndarray, channels: int) -> np.ndarray:
    """Frames of ``channels`` equal samples from one sample each: mono written to all channels."""
    return np.repeat(np.asarray(samples).reshape(-1, 1), channels, axis=1)
