"""Media columns: MPEG audio frames, tags, tables, checksums and seek offsets.

``parse_mpeg`` reads a whole stream: ID3v2 and ID3v1 tags, frame headers of
every version and layer, resynchronising after bytes that are no frame, the
variable-bitrate tables of the first frame with the encoder's delay and
padding, and the CRC-16 of protected frames of all layers; free format is not
read.  ``carry`` stores arbitrary bytes losslessly as such a stream:
frames of constant size whose side information declares silence, the payload
standing in the ancillary bytes behind it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import full_text, materialize

UNIT = 576

# Fixed values of the MPEG audio header: kbit/s by (version 1?, layer) and index, Hz by version.
BITRATES = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1) ^ (0x8005 if value & 0x8000 else 0)
        out.append(value & 0xFFFF)
    return out


_CRC = _crc_table()


def crc16(data: bytes, value: int = 0xFFFF) -> int:
    """The frame checksum: polynomial 0x8005, most significant bit first."""
    for byte in data:
        value = (value << 8 & 0xFFFF) ^ _CRC[value >> 8 ^ byte]
    return value


def crc16_bits(raw: bytes, bits: int, value: int = 0xFFFF) -> int:
    """The frame checksum of the first ``bits`` bits."""
    value = crc16(raw[: bits // 8], value)
    for i in range(bits // 8 * 8, bits):
        value = (value << 1 ^ (0x8005 if (value >> 15) ^ (raw[i // 8] >> (7 - i % 8) & 1) else 0)) & 0xFFFF
    return value


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    bitrate: int
    rate: int
    padding: int
    channels: int
    size: int
    samples: int
    #: Subbands below this one have an allocation for each channel (joint stereo of Layers I and II).
    bound: int = 32

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.channels == 1 else 32) if self.version == 3 else (9 if self.channels == 1 else 17)

    @property
    def kind(self) -> tuple[int, int, int]:
        """What holds for all frames of a stream."""
        return self.version, self.layer, self.rate


_HEADERS: dict[bytes, Header | None] = {}


def read_header(raw: bytes) -> Header | None:
    """The header in four bytes; None where they are none, or of free format."""
    if raw in _HEADERS:
        return _HEADERS[raw]
    found = None
    if len(raw) == 4 and raw[0] == 0xFF and raw[1] & 0xE0 == 0xE0:
        version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
        bits, rate = raw[2] >> 4, raw[2] >> 2 & 3
        if version != 1 and layer != 4 and 0 < bits < 15 and rate != 3:
            kbps, hz, pad = BITRATES[version == 3, layer][bits], RATES[version][rate], raw[2] >> 1 & 1
            samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
            size = (12_000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
            found = Header(version, layer, not raw[1] & 1, kbps, hz, pad, 1 if raw[3] >> 6 == 3 else 2, size, samples, 4 * (raw[3] >> 4 & 3) + 4 if raw[3] >> 6 == 1 else 32)
    if len(_HEADERS) > 10_000:
        _HEADERS.clear()
    _HEADERS[raw] = found
    return found


# Fixed values of Layer II: bits of a subband's allocation, by table.
ALLOCATION = {"a": [4] * 11 + [3] * 12 + [2] * 4, "b": [4] * 11 + [3] * 12 + [2] * 7, "c": [4] * 2 + [3] * 6, "d": [4] * 2 + [3] * 10, "low": [4] * 4 + [3] * 7 + [2] * 19}


def _allocation(header: Header) -> list[int]:
    if header.version != 3:
        return ALLOCATION["low"]
    each = header.bitrate // header.channels
    if 56 <= each <= 80 or (header.rate == 48000 and each > 80):
        return ALLOCATION["a"]
    if each > 80:
        return ALLOCATION["b"]
    return ALLOCATION["d" if header.rate == 32000 else "c"]


def protected_bits(body: bytes, header: Header) -> int:
    """Bits behind the checksum that it covers: side information, allocations, or those and their scale factor selectors."""
    if header.layer == 3:
        return 8 * header.side
    bound = min(header.bound, 32) if header.channels == 2 else 32
    if header.layer == 1:
        return 4 * (32 * header.channels if bound == 32 else 32 + bound)
    at, selectors, whole = 0, 0, int.from_bytes(body[:64].ljust(64, b"\0"), "big")
    for band, width in enumerate(_allocation(header)):
        for _ in range(header.channels if band < bound else 1):
            at += width
            if whole >> (512 - at) & ((1 << width) - 1):
                selectors += 2 if band < bound else 2 * header.channels
    return at + selectors


def is_protected_right(frame: bytes, header: Header) -> bool:
    """Whether the checksum of a protected frame is right."""
    body = frame[6:]
    return crc16_bits(body, min(protected_bits(body, header), 8 * len(body)), crc16(frame[2:4])) == int.from_bytes(frame[4:6], "big")


@dataclass
class Stream:
    """What a stream holds; ``offsets`` has the place of each audio frame."""

    tags: dict[str, bytes] = field(default_factory=dict)
    table: dict[str, int] = field(default_factory=dict)
    header: Header | None = None
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    samples: int = 0
    bitrates: set[int] = field(default_factory=set)
    checked: int = 0
    wrong: int = 0
    skipped: int = 0

    @property
    def seconds(self) -> float:
        """The exact duration: all samples but the encoder's delay and padding."""
        return max(0, self.samples - self.table.get("delay", 0) - self.table.get("padding", 0)) / self.header.rate if self.header else 0.0

    def seek(self, second: float) -> int:
        """The offset of the frame that plays at ``second``."""
        k = int(second * self.header.rate) // self.header.samples
        return self.offsets[min(max(k, 0), len(self.offsets) - 1)]


def _id3v2(raw: bytes, at: int, tags: dict[str, bytes]) -> int:
    """Bytes of the tag at ``at``; its frames go to ``tags``."""
    if raw[at : at + 3] != b"ID3" or len(raw) < at + 10 or max(raw[at + 6 : at + 10]) > 127:
        return 0
    size = sum(b << s for b, s in zip(raw[at + 6 : at + 10], (21, 14, 7, 0), strict=True))
    end, p, whole = min(len(raw), at + 10 + size), at + 10, raw[at + 3] >= 4
    while p + 10 <= end and raw[p] and raw[at + 3] >= 3:
        b = raw[p + 4 : p + 8]
        n = sum(x << s for x, s in zip(b, (21, 14, 7, 0), strict=True)) if whole else int.from_bytes(b, "big")
        tags.setdefault(raw[p : p + 4].decode("latin-1"), raw[p + 10 : min(end, p + 10 + n)])
        p += 10 + n
    return 10 + size + (10 if raw[at + 5] & 0x10 else 0)


def _vbr_table(frame: bytes, header: Header) -> dict[str, int]:
    """The Xing, Info or VBRI table in a frame, if there is one."""
    at = 4 + header.side
    for at in (at, at + 2):
        if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
            flags, p, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"found": 1}
            for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit:
                    out[name] = zlib.crc32(frame[p : p + n]) if name == "toc" else int.from_bytes(frame[p : p + n], "big")
                    p += n
            if len(frame) >= p + 24 and frame[p : p + 4] in (b"LAME", b"Lavf", b"Lavc"):
                both = int.from_bytes(frame[p + 21 : p + 24], "big")
                out["delay"], out["padding"] = both >> 12, both & 0xFFF
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        return {"found": 1, "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big")}
    return {}


def parse_mpeg(raw: bytes) -> Stream:
    """Everything about a stream; any bytes will do, frames or not.

    A frame counts if its header is followed by the next frame's header of
    the same kind, by a tag, or by the end of the stream.  "TAG" 128 bytes
    before the end is no ID3v1 tag where a frame in sync runs through it to
    exactly the end.
    """
    out = Stream()
    at, end = 0, len(raw)
    while (n := _id3v2(raw, at, out.tags)) and at + n <= end:
        at += n
    start, whole = at, end
    if end >= at + 128 and raw[end - 128 : end - 125] == b"TAG":
        end -= 128
    synced, verdicts = False, {}
    while at + 4 <= end:
        header = read_header(raw[at : at + 4])
        if end < whole and header is not None and at + header.size == whole and (synced or at == start) and (out.header is None or header.kind == out.header.kind):
            end = whole
        ok = header is not None and at + header.size <= end and (out.header is None or header.kind == out.header.kind)
        if ok and not synced and at + header.size < end:
            after = read_header(raw[at + header.size : at + header.size + 4])
            ok = after is not None and after.kind == header.kind
        if not ok:
            jump = raw.find(b"\xff", at + 1, end)
            jump = end if jump < 0 else jump
            out.skipped, at, synced = out.skipped + jump - at, jump, False
            continue
        first, synced = out.header is None, True
        if first:
            out.header = header
            out.table = _vbr_table(raw[at : at + header.size], header)
        if header.protected:
            # equal checked parts have equal verdicts; they are no longer than this
            body = raw[at : at + min(header.size, 6 + (header.side if header.layer == 3 else 64))]
            if body not in verdicts:
                verdicts[body] = is_protected_right(body, header)
                if len(verdicts) > 10_000:
                    verdicts = {body: verdicts[body]}
            out.checked += 1
            out.wrong += not verdicts[body]
        if not (first and out.table):
            out.offsets.append(at)
            out.sizes.append(header.size)
            out.samples += header.samples
            out.bitrates.add(header.bitrate)
        at += header.size
    if end < whole:
        out.tags.setdefault("TAG", raw[end:])
    out.skipped += max(0, end - at)
    return out


# Version 2, Layer III, 16 kHz, mono, 144 kbit/s with checksum: 576 samples and 648 bytes a frame.
_FRAME_HEAD = bytes([0xFF, 0xF2, 0xD8, 0xC0])
_FRAME = read_header(_FRAME_HEAD)
_LEAD = _FRAME_HEAD + crc16(_FRAME_HEAD[2:] + bytes(_FRAME.side)).to_bytes(2, "big") + bytes(_FRAME.side)


def pad_payload(data: bytes, unit: int = UNIT) -> bytes:
    """``data`` with bytes 255 behind it, up to a positive multiple of ``unit``."""
    return data + b"\xff" * (max(1, -(-len(data) // unit)) * unit - len(data))


def _tag_frame(name: bytes, body: bytes) -> bytes:
    return name + struct.pack(">IH", len(body), 0) + body


def carry(data: bytes) -> bytes:
    """A stream that holds ``data``, padded, with its length and CRC-32 in the tag."""
    payload = pad_payload(data)
    n = len(payload) // UNIT
    audio = np.zeros((n, _FRAME.size), np.uint8)
    audio[:, : len(_LEAD)] = np.frombuffer(_LEAD, np.uint8)
    audio[:, len(_LEAD) : len(_LEAD) + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    table = _LEAD + b"Info" + struct.pack(">III", 7, n, (n + 1) * _FRAME.size) + bytes(256 * k // 100 for k in range(100))
    private = _tag_frame(b"PRIV", b"payload\0" + struct.pack(">QI", len(data), zlib.crc32(payload)))
    tag = b"ID3\x03\0\0" + bytes(len(private) >> s & 127 for s in (21, 14, 7, 0)) + private
    return tag + table.ljust(_FRAME.size, b"\0") + audio.tobytes()


def uncarry(raw: bytes, stream: Stream | None = None) -> tuple[int, bytes]:
    """(unpadded length, padded payload) read from a stream made by ``carry``."""
    stream = stream or parse_mpeg(raw)
    length, crc = struct.unpack(">QI", stream.tags["PRIV"][8:20])
    starts, n = stream.offsets, len(stream.offsets)
    if n and starts[-1] - starts[0] == (n - 1) * _FRAME.size:
        frames = np.frombuffer(raw, np.uint8, n * _FRAME.size, starts[0]).reshape(n, _FRAME.size)
        payload = frames[:, len(_LEAD) : len(_LEAD) + UNIT].tobytes()
    else:
        payload = b"".join(raw[p + len(_LEAD) : p + len(_LEAD) + UNIT] for p in starts)
    if zlib.crc32(payload) != crc or len(payload) < length:
        raise ValueError("the payload of a stream is damaged")
    return length, payload


def describe(stream: Stream) -> str:
    """The features of a stream as one line."""
    h = stream.header
    if h is None:
        return f"none;skipped={stream.skipped}"
    seeks = zlib.crc32(np.array(stream.offsets, "<u8").tobytes())
    table = "+".join(f"{k}:{v}" for k, v in sorted(stream.table.items()))
    return (
        f"mpeg{VERSIONS[h.version]}-layer{h.layer};rate={h.rate};channels={h.channels};kbps={min(stream.bitrates, default=0)}-{max(stream.bitrates, default=0)};"
        f"frames={len(stream.offsets)};samples={stream.samples};seconds={stream.seconds:.6f};checked={stream.checked};wrong={stream.wrong};"
        f"skipped={stream.skipped};table={table};seeks={seeks:08x}"
    )


def media_features(media: Column) -> Column:
    """struct of an MPEG column: feature line, seconds, frame offsets, checksum counts. Null stays null."""

    @arrow_udf("struct<feature string, seconds double, offsets array<long>, checked long, wrong long>")
    def run(values: pa.Array) -> pa.Array:
        rows = []
        for v in values:
            if not v.is_valid:
                rows.append(None)
                continue
            s = parse_mpeg(v.as_py())
            rows.append({"feature": describe(s), "seconds": s.seconds, "offsets": s.offsets, "checked": s.checked, "wrong": s.wrong})
        return pa.array(rows, pa.struct([("feature", pa.string()), ("seconds", pa.float64()), ("offsets", pa.list_(pa.int64())), ("checked", pa.int64()), ("wrong", pa.int64())]))

    return run(media)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, media, seconds, offsets: every text's bytes as a stored stream, its exact duration and frame seek offsets.

    Null counts as empty: one unit of padding.  Equal texts have equal
    streams; every row is stored, an empty table gives no rows.  A text is one
    binary value, so it must stay under about 1.9 GB.  Columns read: doc_id,
    text; others of any name are ignored.
    """
    kinds = pa.struct([("media", pa.binary()), ("seconds", pa.float64()), ("offsets", pa.list_(pa.int64()))])

    @arrow_udf("struct<media binary, seconds double, offsets array<long>>")
    def write(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            raw = carry(t.as_buffer().to_pybytes())
            stream = parse_mpeg(raw)
            rows.append({"media": raw, "seconds": stream.seconds, "offsets": stream.offsets})
        return pa.array(rows, kinds)

    return materialize(docs.select("doc_id", write(full_text()).alias("m")).select("doc_id", "m.*"), "media")


def read_back(media: DataFrame) -> DataFrame:
    """The digests and features of stored streams; equal texts have equal values."""
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [k.split()[0] for k in kinds.split(", ")]
        types = [pa.string() if k.endswith("string") else pa.int64() for k in kinds.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = value.as_py()
                stream = parse_mpeg(raw)
                length, payload = uncarry(raw, stream)
                rows.append((doc_id, length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), describe(stream)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, kinds)
