"""Codec registry: bytes of a block range to frames, and frames to a file.

``DECODERS`` and ``ENCODERS`` are open: a further codec registers a function
under its name, a decoder of (bytes, fmt) to frames and an encoder of frames
to (fmt chunk, data, whether it writes a fact chunk).  Codecs whose libraries are absent raise ``CodecUnavailable``.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

from wavequarry.functions import adpcm

from . import flac, riff


class CodecUnavailable(NotImplementedError):
    """No decoder or encoder for a codec is registered."""


_DTYPES = {"u8": "u1", "i16": "<i2", "i32": "<i4", "i64": "<i8", "f32": "<f4", "f64": "<f8"}
TAGS = {"u8": 1, "i16": 1, "i24": 1, "i32": 1, "i64": 1, "f32": 3, "f64": 3, "alaw": 6, "mulaw": 7, "ms": 2, "ima": 0x11, "yamaha": 0x20, "flac": 0xF1AC}
BITS = {"u8": 8, "i16": 16, "i24": 24, "i32": 32, "i64": 64, "f32": 32, "f64": 64, "alaw": 8, "mulaw": 8, "ms": 4, "ima": 4, "yamaha": 4, "flac": 16}


def _range(kind: str) -> tuple[int, int]:
    bits = int(kind[1:])
    return (-(1 << bits - 1), (1 << bits - 1) - 1) if kind[0] == "i" else (0, (1 << bits) - 1)


def convert(x: np.ndarray, source: str, target: str) -> np.ndarray:
    """Range-strict conversion; the rules are those of ``functions.samples.scale``."""
    if source == target:
        return x
    if target[0] == "f":
        out = x.astype(np.float64)
        if source[0] != "f":
            bits = int(source[1:])
            out = (out - (0 if source[0] == "i" else 2.0 ** (bits - 1))) / float((1 << bits - 1) - 1)
        return out.astype(_DTYPES[target])
    b = int(target[1:])
    if source[0] == "f":
        scaled = np.clip(x.astype(np.float64), -1, 1) * float((1 << b - 1) - 1)
        signed = np.trunc(np.minimum(scaled, 9.223372036854775e18)).astype(np.int64)
    else:
        a = int(source[1:])
        signed = x.astype(np.int64) if source != "u64" else (x.astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
        if source[0] == "u" and a < 64:
            signed = signed - (1 << a - 1)
        signed = signed << (b - a) if b >= a else signed >> (a - b)
    if target[0] == "i":
        return signed
    return (signed.view(np.uint64) ^ np.uint64(1 << 63)) if b == 64 else signed + (1 << b - 1)


def _pcm(kind: str) -> Callable[[bytes, dict], np.ndarray]:
    def decode(data: bytes, fmt: dict) -> np.ndarray:
        if kind == "i24":
            raw = np.frombuffer(data, np.uint8, len(data) // 3 * 3).reshape(-1, 3).astype(np.int32)
            flat = (raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) << 8 >> 8
        else:
            dtype = np.dtype(_DTYPES[kind])
            flat = np.frombuffer(data, dtype, len(data) // dtype.itemsize)
        n = len(flat) // fmt["channels"]
        return flat[: n * fmt["channels"]].reshape(n, fmt["channels"])

    return decode


def _mulaw_table() -> np.ndarray:
    code = 255 - np.arange(256)
    size = ((code % 16 * 8 + 132) << (code % 128 // 16)) - 132
    return np.where(code >= 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    segment = code % 128 // 16
    size = (code % 16 * 16 + np.where(segment == 0, 8, 264)) << np.maximum(segment - 1, 0)
    return np.where(code >= 128, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()


def mulaw_codes(x: np.ndarray) -> np.ndarray:
    size = np.minimum(np.abs(x.astype(np.int64)), 32635) + 132
    segment = np.frexp(size.astype(np.float64))[1] - 8
    return (255 - (np.where(x < 0, 128, 0) + segment * 16 + (size >> (segment + 3)) % 16)).astype(np.uint8)


def alaw_codes(x: np.ndarray) -> np.ndarray:
    value = x.astype(np.int64) >> 3
    size = np.where(value >= 0, value, -value - 1)
    segment = np.maximum(np.frexp(size.astype(np.float64))[1] - 5, 0)
    plain = segment * 16 + (size >> np.maximum(segment, 1)) % 16
    return (plain ^ np.where(value >= 0, 0xD5, 0x55)).astype(np.uint8)


def _xlaw(table: np.ndarray) -> Callable[[bytes, dict], np.ndarray]:
    def decode(data: bytes, fmt: dict) -> np.ndarray:
        n = len(data) // fmt["channels"]
        return table[np.frombuffer(data, np.uint8, n * fmt["channels"])].reshape(n, fmt["channels"])

    return decode


def _rows(frames, channels: int) -> np.ndarray:
    return np.array(list(frames), np.int16).reshape(-1, channels)


def _flac(data: bytes, fmt: dict) -> np.ndarray:
    """Samples in the 32-bit range, whatever the stream's size is."""
    x, info = flac.decode(data)
    return x << 32 - info["bits"]


DECODERS: dict[str, Callable[[bytes, dict], np.ndarray]] = {
    **{k: _pcm(k) for k in ("u8", "i16", "i24", "i32", "i64", "f32", "f64")},
    "mulaw": _xlaw(MULAW), "alaw": _xlaw(ALAW),
    "ima": lambda data, fmt: _rows(adpcm.decode_ima(data, fmt["channels"], fmt["block_align"]), fmt["channels"]),
    "ms": lambda data, fmt: adpcm.ms_frames(data, fmt["channels"], fmt["block_align"], fmt.get("coefficients")),
    "flac": _flac,
    "yamaha": lambda data, fmt: _rows(adpcm.decode_yamaha(data, fmt["channels"]), fmt["channels"]),
}


def native_type(kind: str) -> str:
    """The sample type that a codec decodes to."""
    return kind if kind in _DTYPES or kind == "i24" else "i32" if kind == "flac" else "i16"


def block_bytes_and_frames(kind: str, fmt: dict) -> tuple[int, int]:
    """(bytes, frames) of the smallest part that decodes by itself; (0, 0): only the whole."""
    channels, align = fmt["channels"], max(1, fmt["block_align"])
    if kind == "ima":
        return align, (align // channels - 4) * 2 + 1
    if kind == "ms":
        return align, (align // channels - 7) * 2 + 2
    if kind in ("alaw", "mulaw"):
        return channels, 1
    return (0, 0) if kind not in DECODERS or kind in ("yamaha", "flac") else (channels * (BITS[kind] // 8), 1)


def total_frames(kind: str, fmt: dict, n_bytes: int) -> int | None:
    """Frames of ``n_bytes`` of data, from its length rather than the fact chunk; None where the length does not tell."""
    if kind == "yamaha":
        return n_bytes * 2 // fmt["channels"]
    size, n = block_bytes_and_frames(kind, fmt)
    if not size:
        return None
    whole, rest = divmod(n_bytes, size)
    channels = fmt["channels"]
    head, first = (4, 1) if kind == "ima" else (7, 2)
    if kind in ("ima", "ms") and rest >= head * channels:
        left = rest - head * channels
        return whole * n + first + (left // (4 * channels) * 8 if kind == "ima" else left * 2 // channels)
    return whole * n


def leading_bytes(kind: str, fmt: dict, frames: int) -> int | None:
    """Bytes of a part that decodes by itself which its first ``frames`` frames take; None: all of them."""
    channels = fmt["channels"]
    if kind == "ima":
        return 4 * channels * (1 + -(-max(0, frames - 1) // 8))
    if kind == "ms":
        return 7 * channels + -(-max(0, frames - 2) * channels // 2)
    if kind == "yamaha":
        return -(-frames * channels // 2)
    size, n = block_bytes_and_frames(kind, fmt)
    return size * frames if n == 1 else None


def decode(kind: str, data: bytes, fmt: dict, target: str) -> np.ndarray:
    """Frames of whole blocks as ``target`` samples, (frames, channels)."""
    if kind not in DECODERS:
        raise CodecUnavailable(f"no decoder for {kind} is registered")
    return convert(DECODERS[kind](data, fmt), native_type(kind), target)


def pcm_bytes(x: np.ndarray, kind: str) -> bytes:
    low, high = (None, None) if kind[0] == "f" else _range(kind)
    if low is not None and x.size and (x.min() < low or x.max() > high):
        raise ValueError(f"samples out of the range of {kind}")
    if kind == "i24":
        return np.ascontiguousarray(x.astype("<i4").reshape(-1, 1).view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()
    return x.astype(_DTYPES[kind]).tobytes()


def _encode_pcm(kind: str):
    def encode(frames: np.ndarray, source: str, rate: int, mask: int, bits: int | None) -> tuple[bytes, bytes, bool]:
        channels, size = frames.shape[1], BITS[kind] // 8
        if mask and bin(mask).count("1") != channels:
            raise ValueError("the channel mask does not fit the channels")
        ext, tag = None, TAGS[kind]
        if mask:
            ext, tag = struct.pack("<HI", BITS[kind], mask) + (riff.GUID_FLOAT if tag == 3 else riff.GUID_PCM), 0xFFFE
        fmt = riff.fmt_bytes(tag, channels, rate, rate * channels * size, channels * size, BITS[kind], ext)
        return fmt, pcm_bytes(convert(frames, source, kind), kind), tag != 1

    return encode


def _encode_flac(frames: np.ndarray, source: str, rate: int, mask: int, bits: int | None) -> tuple[bytes, bytes, bool]:
    bits = bits or 16
    data = flac.encode(convert(frames, source, "i32") >> 32 - bits, rate, bits)
    return riff.fmt_bytes(0xF1AC, frames.shape[1], rate, max(1, len(data) * rate // max(1, len(frames))), 1, bits, b""), data, True


def _encode_16(make):
    """An encoder of 16-bit frames; ``make(frames, channels, rate)`` gives fmt and data."""

    def encode(frames: np.ndarray, source: str, rate: int, mask: int, bits: int | None) -> tuple[bytes, bytes, bool]:
        return *make(convert(frames, source, "i16"), frames.shape[1], rate), True

    return encode


def _xlaw_file(kind: str, codes):
    return _encode_16(lambda x, c, rate: (riff.fmt_bytes(TAGS[kind], c, rate, rate * c, c, 8, b""), codes(x).tobytes()))


def _ms_file(x: np.ndarray, c: int, rate: int) -> tuple[bytes, bytes]:
    coefficients = b"".join(struct.pack("<hh", *pair) for pair in adpcm.MS_COEFFS)
    return riff.fmt_bytes(2, c, rate, rate * c * 1024 // 2036, 1024 * c, 4, struct.pack("<HH", 2036, 7) + coefficients), adpcm.encode_ms(x.tolist(), c)


ENCODERS: dict[str, Callable[..., tuple[bytes, bytes, bool]]] = {
    **{k: _encode_pcm(k) for k in ("u8", "i16", "i24", "i32", "i64", "f32", "f64")},
    "alaw": _xlaw_file("alaw", alaw_codes), "mulaw": _xlaw_file("mulaw", mulaw_codes), "flac": _encode_flac,
    "ima": _encode_16(lambda x, c, rate: (riff.fmt_bytes(0x11, c, rate, rate * c * 512 // 1017, 512 * c, 4, struct.pack("<H", 1017)), adpcm.encode_ima(x.tolist(), c))),
    "ms": _encode_16(_ms_file), "yamaha": _encode_16(lambda x, c, rate: (riff.fmt_bytes(0x20, c, rate, rate * c // 2, 1024, 4, b""), adpcm.encode_yamaha(x.tolist(), c))),
}


def most_channels(codec: str) -> int:
    return 18 if codec in _DTYPES or codec == "i24" else flac.MAX_CHANNELS if codec == "flac" else 2


def encode_file(frames: np.ndarray, source: str, codec: str, rate: int, channel_mask: int = 0, meta: dict | None = None, riff_mode: str = "never", bits: int | None = None) -> bytes:
    """A whole file of (frames, channels) samples of type ``source`` in ``codec``; ``bits`` is for FLAC (16 if not given)."""
    if codec not in ENCODERS:
        raise CodecUnavailable(f"no encoder for {codec} is registered")
    n, channels = frames.shape
    if channels < 1 or channels > most_channels(codec):
        raise ValueError(f"{codec} holds no {channels} channels")
    fmt, data, tells = ENCODERS[codec](frames, source, rate, channel_mask, bits)
    return riff.container_bytes(fmt, data, n * channels if tells else None, meta, riff_mode)
