"""RIFF and RF64 containers: chunk walk, metadata chunks, and writing.

A ``View`` reads byte ranges, so that a walk over a large file touches only
chunk headers and the metadata it is asked for.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

GUID_PCM = uuid.UUID("00000001-0000-0010-8000-00aa00389b71").bytes_le
GUID_FLOAT = uuid.UUID("00000003-0000-0010-8000-00aa00389b71").bytes_le
RESERVED_JUNK = 28


# What stands in the extension of a format, by tag.
EXTENSION_KINDS = {2: "adpcm-ms", 0x11: "adpcm-ima", 0x55: "mp3", 0x566F: "vorbis", 0x674F: "oggvorbis", 0x6751: "oggvorbis", 0x676F: "oggvorbis", 0x6771: "oggvorbis", 0x6750: "oggvorbis-header", 0x6770: "oggvorbis-header", 0xFFFE: "extensible"}
EXTENSIONS = {
    2: ("<HH", ("samples_per_block", "num_coefficients")), 0x11: ("<H", ("samples_per_block",)), 0x55: ("<HIHHH", ("id", "flags", "block_size", "frames_per_block", "codec_delay")),
    **dict.fromkeys((0x674F, 0x6750, 0x6751, 0x676F, 0x6770, 0x6771), ("<II", ("codec_version", "vorbis_version"))), 0xFFFE: ("<HI", ("valid_bits_per_sample", "channel_mask")),
}


class WavError(ValueError):
    """A container that cannot be read."""


@dataclass
class Chunk:
    flag: bytes
    offset: int
    size: int


@dataclass
class Header:
    container: str
    chunks: list[Chunk]
    fmt: dict
    data: Chunk
    fact: int | None
    meta: dict = field(default_factory=dict)
    corrupt: list[str] = field(default_factory=list)

    @property
    def block_align(self) -> int:
        return max(1, self.fmt["block_align"])


def _text(raw: bytes, code_page: str | None = None) -> str:
    """Fixed or zero-terminated text: UTF-8, then the code page, then Latin-1."""
    raw = raw.split(b"\0", 1)[0]
    for codec in ("utf-8", code_page, "latin-1"):
        if codec:
            try:
                return raw.decode(codec)
            except (UnicodeDecodeError, LookupError):
                continue
    return ""


def parse_fmt(raw: bytes) -> dict:
    if len(raw) < 16:
        raise WavError("the fmt chunk is too short")
    tag, channels, rate, byte_rate, align, bits = struct.unpack_from("<HHIIHH", raw)
    out = {"format_tag": tag, "channels": channels, "sample_rate": rate, "byte_rate": byte_rate, "block_align": align, "bits_per_sample": bits, "ext_len": 0, "ext_kind": None, "guid": None, "channel_mask": 0, "ext": b"", "ext_values": {}, "coefficients": None}
    if len(raw) >= 18:
        out["ext_len"] = struct.unpack_from("<H", raw, 16)[0]
        ext = out["ext"] = raw[18 : 18 + out["ext_len"]]
        if len(ext) < out["ext_len"]:
            raise WavError("the fmt extension is too short")
        out["ext_kind"] = EXTENSION_KINDS.get(tag) if ext else None
        if ext and tag in EXTENSIONS:
            layout, names = EXTENSIONS[tag]
            if len(ext) < struct.calcsize(layout):
                raise WavError(f"the extension of {out['ext_kind']} is too short")
            out["ext_values"] = dict(zip(names, struct.unpack_from(layout, ext), strict=True))
        if tag == 2 and ext:
            n = min(out["ext_values"]["num_coefficients"], (len(ext) - 4) // 4)
            out["coefficients"] = [struct.unpack_from("<hh", ext, 4 + 4 * k) for k in range(n)]
        if tag == 0xFFFE and len(ext) >= 22:
            out["channel_mask"] = out["ext_values"]["channel_mask"]
            out["guid"] = ext[6:22]
    return out


def sample_kind(fmt: dict) -> str:
    """The storable sample type of a PCM format, or the codec's name."""
    tag, bits, guid = fmt["format_tag"], fmt["bits_per_sample"], fmt["guid"]
    if tag == 0xFFFE:
        if guid not in (None, GUID_PCM, GUID_FLOAT):
            raise WavError(f"no decoder for GUID {guid.hex()}")
        tag = 3 if guid == GUID_FLOAT else 1
    names = {(1, 8): "u8", (1, 16): "i16", (1, 24): "i24", (1, 32): "i32", (1, 64): "i64", (3, 32): "f32", (3, 64): "f64"}
    if tag in (1, 3):
        if (tag, bits) not in names:
            raise WavError(f"no PCM of {bits} bits with tag {tag}")
        return names[tag, bits]
    codecs = {2: "ms", 6: "alaw", 7: "mulaw", 0x11: "ima", 0x67: "ima", 0x20: "yamaha", 0x55: "mp3", 0x704F: "opus", 0xF1AC: "flac"}
    if tag in codecs:
        return codecs[tag]
    return "vorbis" if tag in (0x566F, 0x674F, 0x6750, 0x6751, 0x676F, 0x6770, 0x6771) else "unknown"


def _bext(raw: bytes, page: str | None) -> dict:
    if len(raw) < 602:
        raise WavError("bext")
    out = {n: _text(raw[a:b], page) for n, a, b in (("description", 0, 256), ("originator", 256, 288), ("originator_ref", 288, 320), ("origination_date", 320, 330), ("origination_time", 330, 338))}
    return out | {"time_ref": struct.unpack_from("<Q", raw, 338)[0], "version": struct.unpack_from("<H", raw, 346)[0], "umid": raw[348:412]}


def _smpl(raw: bytes, page: str | None) -> dict:
    names = ["manufacturer", "product", "sample_period", "midi_unity_note", "midi_pitch_fraction", "smpte_format", "smpte_offset"]
    values = struct.unpack_from("<9I", raw)
    keys = ["identifier", "type", "start", "end", "fraction", "play_count"]
    loops = [dict(zip(keys, struct.unpack_from("<6I", raw, 36 + 24 * k), strict=True)) for k in range(values[7])]
    return dict(zip(names, values, strict=False)) | {"sampler_data": values[8], "loops": loops}


def _inst(raw: bytes, page: str | None) -> dict:
    return dict(zip(["base_note", "detune", "gain", "low_note", "high_note", "low_velocity", "high_velocity"], struct.unpack_from("<7B", raw), strict=True))


def _acid(raw: bytes, page: str | None) -> dict:
    flags, root, _, _, beats, den, num, tempo = struct.unpack_from("<IHHfIHHf", raw)
    return {"flags": flags, "root_node": root, "num_beats": beats, "meter_denominator": den, "meter_numerator": num, "tempo": tempo}


def _trkn(raw: bytes, page: str | None) -> dict:
    return dict(zip(["track_no", "total_tracks"], struct.unpack_from("<HH", raw), strict=True))


def _cue(raw: bytes, page: str | None) -> list[dict]:
    out = []
    for k in range(struct.unpack_from("<I", raw)[0]):
        i, position, flag, start, block, offset = struct.unpack_from("<II4sIII", raw, 4 + 24 * k)
        out.append({"cue_point_id": i, "position": position, "data_chunk_id": flag.decode("latin-1"), "chunk_start": start, "block_start": block, "offset": offset})
    return out


def _plst(raw: bytes, page: str | None) -> list[dict]:
    return [dict(zip(["cue_point_id", "num_samples", "repeats"], struct.unpack_from("<III", raw, 4 + 12 * k), strict=True)) for k in range(struct.unpack_from("<I", raw)[0])]


def sub_chunks(raw: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    while at + 8 <= len(raw):
        flag, size = struct.unpack_from("<4sI", raw, at)
        out.append((flag, raw[at + 8 : at + 8 + size]))
        at += 8 + size + (size & 1)
    return out


def info_map(raw: bytes, page: str | None = None) -> dict[str, str]:
    """INFO entries; a lower-case key also fills its upper-case form where that is absent."""
    out = {flag.decode("latin-1"): _text(body, page) for flag, body in sub_chunks(raw)}
    return {k.upper(): v for k, v in out.items() if k.upper() not in out} | out


def adtl_rows(raw: bytes, page: str | None = None) -> list[dict]:
    """All labl, note, ltxt and file entries in order."""
    out = []
    for flag, body in sub_chunks(raw):
        row = dict.fromkeys(["kind", "cue_point_id", "data", "sample_length", "purpose_id", "country", "language", "dialect", "code_page", "media_type", "file_data"])
        row |= {"kind": flag.decode("latin-1"), "cue_point_id": struct.unpack_from("<I", body)[0]}
        if flag in (b"labl", b"note"):
            row["data"] = _text(body[4:], page)
        elif flag == b"ltxt":
            row["sample_length"], purpose, row["country"], row["language"], row["dialect"], row["code_page"] = struct.unpack_from("<I4sHHHH", body, 4)
            row |= {"purpose_id": _text(purpose), "data": _text(body[20:], f"cp{row['code_page']}" if row["code_page"] else page)}
        elif flag == b"file":
            row |= {"media_type": struct.unpack_from("<I", body, 4)[0], "file_data": body[8:]}
        else:
            raise WavError(f"unexpected {row['kind']} in adtl")
        out.append(row)
    return out


def id3_frames(raw: bytes) -> list[tuple[str, str]]:
    """(frame, text) of the text frames of an ID3v2.3 or 2.4 tag, in order."""
    if raw[:3] != b"ID3" or len(raw) < 10 or raw[3] not in (3, 4):
        return []
    whole = lambda b: sum((x & 127) << s for x, s in zip(b, (21, 14, 7, 0), strict=True))
    out, at, end = [], 10, min(len(raw), 10 + whole(raw[6:10]))
    if raw[5] & 0x40:  # an extended header
        at += whole(raw[10:14]) if raw[3] == 4 else 4 + int.from_bytes(raw[10:14], "big")
    while at + 10 <= end and raw[at]:
        n = whole(raw[at + 4 : at + 8]) if raw[3] == 4 else int.from_bytes(raw[at + 4 : at + 8], "big")
        body = raw[at + 10 : min(end, at + 10 + n)]
        if raw[at : at + 1] == b"T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace")
            out.append((raw[at : at + 4].decode("latin-1"), text.rstrip("\0")))
        at += 10 + n
    return out


def id3_bytes(frames: list[tuple[str, str]]) -> bytes:
    """An ID3v2.4 tag of text frames in UTF-8."""

    def whole(n: int) -> bytes:
        return bytes(n >> s & 127 for s in (21, 14, 7, 0))

    body = b"".join(name.encode() + whole(1 + len(text.encode())) + b"\0\0\3" + text.encode() for name, text in frames)
    return b"ID3\4\0\0" + whole(len(body)) + body


_PARSERS: dict[bytes, tuple[str, Callable]] = {
    b"bext": ("bext", _bext), b"smpl": ("smpl", _smpl), b"inst": ("inst", _inst), b"INST": ("inst", _inst), b"acid": ("acid", _acid),
    b"Trkn": ("trkn", _trkn), b"cue ": ("cues", _cue), b"plst": ("plst", _plst), b"slnt": ("slnt", lambda raw, page: struct.unpack_from("<I", raw)[0]),
    b"axml": ("axml", lambda raw, page: _text(raw)), b"ixml": ("ixml", lambda raw, page: _text(raw)), b"iXML": ("ixml", lambda raw, page: _text(raw)), b"id3 ": ("id3", lambda raw, page: raw),
}


def read_header(read: Callable[[int, int], bytes], length: int, metadata: bool = True, code_page: str | None = None, mode: str = "PERMISSIVE") -> Header:
    """Walk the chunks of a file of ``length`` bytes; ``read(offset, size)`` gives its bytes.

    Unknown chunks are kept in the list and otherwise ignored.  The first of
    repeated metadata chunks wins; fmt and data may not repeat.  A metadata
    chunk that cannot be read is listed as corrupt, or fatal in FAILFAST mode.
    """
    top = read(0, 12)
    if len(top) < 12 or top[:4] not in (b"RIFF", b"RF64") or top[8:] != b"WAVE":
        raise WavError("not a WAV file")
    container = top[:4].decode()
    chunks, fmt, data, fact, ds64 = [], None, None, None, None
    meta: dict = {"info": {}, "adtl": [], "junk": []}
    corrupt: list[str] = []
    at = 12
    # what stands behind the container's own length is not part of it; 0 and -1 are lengths not known
    end = 8 + int.from_bytes(top[4:8], "little")
    end = length if container == "RF64" or end - 8 in (0, 0xFFFFFFFF) else min(end, length)
    while at + 8 <= end:
        flag, size = struct.unpack("<4sI", read(at, 8))
        body = at + 8
        if flag == b"data" and container == "RF64" and ds64:
            size = ds64[1]
        chunk = Chunk(flag, body, min(size, length - body))
        chunks.append(chunk)
        if flag == b"ds64":
            if ds64 or size < 28:
                raise WavError("ds64 is repeated or too short")
            ds64 = struct.unpack("<QQ", read(body, 16))
            if container == "RF64" and ds64[0]:
                end = min(length, 8 + ds64[0])
        elif flag == b"fmt ":
            if fmt is not None:
                raise WavError("fmt is repeated")
            fmt = parse_fmt(read(body, chunk.size))
        elif flag == b"data":
            if data is not None:
                raise WavError("data is repeated")
            data = chunk
        elif flag == b"fact":
            raw = read(body, chunk.size)
            fact = int.from_bytes(raw, "little") if len(raw) in (4, 8) else 0
        elif metadata:
            try:
                if flag in _PARSERS:
                    name, parse = _PARSERS[flag]
                    if name not in meta:
                        meta[name] = parse(read(body, chunk.size), code_page)
                elif flag == b"LIST":
                    raw = read(body, chunk.size)
                    if raw[:4] == b"INFO":
                        meta["info"] = info_map(raw[4:], code_page) | meta["info"]
                    elif raw[:4] == b"adtl":
                        meta["adtl"] += adtl_rows(raw[4:], code_page)
                elif flag == b"JUNK":
                    raw = read(body, chunk.size)
                    if raw not in meta["junk"] and raw != bytes(RESERVED_JUNK):
                        meta["junk"].append(raw)
            except (struct.error, WavError, IndexError) as error:
                if mode == "FAILFAST":
                    raise WavError(f"chunk {flag!r}: {error}") from error
                corrupt.append(flag.decode("latin-1"))
        at = body + size + (size & 1)
    if container == "RF64" and ds64 is None:
        raise WavError("RF64 without ds64")
    if fmt is None:
        raise WavError("no fmt chunk")
    if data is None:
        raise WavError("no data chunk")
    return Header(container, chunks, fmt, data, fact, meta, corrupt)


def from_bytes(raw: bytes, **options) -> Header:
    return read_header(lambda at, n: raw[at : at + n], len(raw), **options)


# ---- writing ----


def chunk_bytes(flag: bytes, body: bytes) -> bytes:
    return flag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def fmt_bytes(tag: int, channels: int, rate: int, byte_rate: int, align: int, bits: int, ext: bytes | None = None) -> bytes:
    out = struct.pack("<HHIIHH", tag, channels, rate, byte_rate, align, bits)
    return out if ext is None else out + struct.pack("<H", len(ext)) + ext


def _sz(text: str) -> bytes:
    raw = text.encode()
    return raw if raw.endswith(b"\0") else raw + b"\0"


def info_bytes(info: dict[str, str]) -> bytes:
    return chunk_bytes(b"LIST", b"INFO" + b"".join(chunk_bytes(k.encode("latin-1"), _sz(v)) for k, v in sorted(info.items())))


def cue_bytes(cues: list[dict]) -> bytes:
    return chunk_bytes(b"cue ", struct.pack("<I", len(cues)) + b"".join(struct.pack("<II4sIII", c["cue_point_id"], c["position"], c["data_chunk_id"].encode("latin-1"), c["chunk_start"], c["block_start"], c["offset"]) for c in cues))


def plst_bytes(rows: list[dict]) -> bytes:
    return chunk_bytes(b"plst", struct.pack("<I", len(rows)) + b"".join(struct.pack("<III", r["cue_point_id"], r["num_samples"], r["repeats"]) for r in rows))


def adtl_bytes(rows: list[dict]) -> bytes:
    out = b"adtl"
    for r in sorted(rows, key=lambda r: r["cue_point_id"]):
        body = struct.pack("<I", r["cue_point_id"])
        if r["kind"] == "ltxt":
            body += struct.pack("<I4sHHHH", r["sample_length"], r["purpose_id"].encode().ljust(4, b"\0"), r["country"], r["language"], r["dialect"], r["code_page"]) + _sz(r["data"])
        elif r["kind"] == "file":
            body += struct.pack("<I", r["media_type"]) + r["file_data"]
        else:
            body += _sz(r["data"])
        out += chunk_bytes(r["kind"].encode("latin-1"), body)
    return chunk_bytes(b"LIST", out)


def bext_bytes(b: dict) -> bytes:
    fixed = b"".join(b[n].encode()[:size].ljust(size, b"\0") for n, size in (("description", 256), ("originator", 32), ("originator_ref", 32), ("origination_date", 10), ("origination_time", 8)))
    return chunk_bytes(b"bext", fixed + struct.pack("<QH", b["time_ref"], b["version"]) + (b.get("umid") or b"").ljust(64, b"\0") + bytes(190) + b"\0")


def smpl_bytes(s: dict) -> bytes:
    names = ["manufacturer", "product", "sample_period", "midi_unity_note", "midi_pitch_fraction", "smpte_format", "smpte_offset"]
    out = struct.pack("<9I", *[s[n] for n in names], len(s["loops"]), s["sampler_data"])
    return chunk_bytes(b"smpl", out + b"".join(struct.pack("<6I", *[x[n] for n in ("identifier", "type", "start", "end", "fraction", "play_count")]) for x in s["loops"]))


def metadata_bytes(meta: dict, junk: bool = True) -> bytes:
    """All metadata chunks that ``meta`` (in the form of ``Header.meta``) holds."""
    out = b""
    if meta.get("slnt") is not None:
        out += chunk_bytes(b"slnt", struct.pack("<I", meta["slnt"]))
    if meta.get("bext"):
        out += bext_bytes(meta["bext"])
    if meta.get("smpl"):
        out += smpl_bytes(meta["smpl"])
    if meta.get("inst"):
        out += chunk_bytes(b"INST", struct.pack("<7B", *meta["inst"].values()))
    if meta.get("plst"):
        out += plst_bytes(meta["plst"])
    if meta.get("cues"):
        out += cue_bytes(meta["cues"])
    if meta.get("trkn"):
        out += chunk_bytes(b"Trkn", struct.pack("<HH", *meta["trkn"].values()))
    if meta.get("acid"):
        a = meta["acid"]
        out += chunk_bytes(b"acid", struct.pack("<IHHfIHHf", a["flags"], a["root_node"], 0, 0.0, a["num_beats"], a["meter_denominator"], a["meter_numerator"], a["tempo"]))
    if meta.get("info"):
        out += info_bytes(meta["info"])
    if meta.get("adtl"):
        out += adtl_bytes(meta["adtl"])
    for name, flag in (("axml", b"axml"), ("ixml", b"iXML")):
        if meta.get(name):
            out += chunk_bytes(flag, meta[name].encode())
    if meta.get("id3"):
        out += chunk_bytes(b"id3 ", meta["id3"])
    return out + b"".join(chunk_bytes(b"JUNK", j) for j in (meta.get("junk") or []) if junk)


def inherit_metadata(target: dict, source: dict, junk: bool = False) -> dict:
    """``target`` with every part that ``source`` has; junk is appended."""
    out = target | {k: v for k, v in source.items() if v not in (None, {}, []) and k != "junk"}
    kept = list(target.get("junk") or [])
    return out | {"junk": kept + [j for j in source.get("junk") or [] if junk and j not in kept]}


def container_bytes(fmt: bytes, data: bytes, fact: int | None = None, meta: dict | None = None, riff: str = "never") -> bytes:
    """A whole file.  ``riff``: ``never`` (an error above 4 GB), ``allow`` (RF64 if needed) or ``force`` (RF64)."""
    extra = metadata_bytes(meta or {})
    head = chunk_bytes(b"fmt ", fmt)
    room = len(head) + len(data) + (len(data) & 1) + len(extra) + 64
    large = riff == "force" or room > 0xFFFFFFFE
    if large and riff == "never":
        raise WavError("a RIFF file cannot be larger than 4 GB")
    facts = b"" if fact is None else chunk_bytes(b"fact", struct.pack("<Q" if large else "<I", fact))
    pad = b"\0" * (len(data) & 1)
    if large:
        size = 4 + 36 + len(head) + len(facts) + 8 + len(data) + len(pad) + len(extra)
        ds64 = b"ds64" + struct.pack("<IQQQI", 28, size, len(data), fact or 0, 0)
        return b"RF64\xff\xff\xff\xffWAVE" + ds64 + head + facts + b"data\xff\xff\xff\xff" + data + pad + extra
    junk = chunk_bytes(b"JUNK", bytes(RESERVED_JUNK)) if riff == "allow" else b""
    body = b"WAVE" + junk + head + facts + b"data" + struct.pack("<I", len(data)) + data + pad + extra
    return b"RIFF" + struct.pack("<I", len(body)) + body
