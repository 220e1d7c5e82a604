"""FLAC streams (RFC 9639): a decoder of all subframe kinds, and an encoder with fixed predictors."""

from __future__ import annotations

import hashlib

import numpy as np

BLOCK = 4096
MAX_CHANNELS = 8
# Block sizes, sample sizes and predictors of the format.
_SIZES = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _table(width: int, poly: int) -> list[int]:
    out, top, mask = [], 1 << width - 1, (1 << width) - 1
    for byte in range(256):
        v = byte << width - 8
        for _ in range(8):
            v = (v << 1 ^ (poly if v & top else 0)) & mask
        out.append(v)
    return out


_CRC8, _CRC16 = _table(8, 0x07), _table(16, 0x8005)


def _crc8(data: bytes) -> int:
    v = 0
    for b in data:
        v = _CRC8[v ^ b]
    return v


def _crc16(data: bytes) -> int:
    v = 0
    for b in data:
        v = (v << 8 & 0xFFFF) ^ _CRC16[v >> 8 ^ b]
    return v


def stream_info(data: bytes) -> dict:
    """What the first metadata block says, and where frames begin."""
    if data[:4] != b"fLaC" or len(data) < 42:
        raise ValueError("not a FLAC stream")
    packed = int.from_bytes(data[18:26], "big")
    out = {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "frames": packed & (1 << 36) - 1, "md5": data[26:42]}
    at = 4
    while at + 4 <= len(data):
        last, size = data[at] >> 7, int.from_bytes(data[at + 1 : at + 4], "big")
        at += 4 + size
        if last:
            break
    return out | {"begin": at}


class _Reader:
    """Bits of a stream; ones are indexed so that a unary number is one search."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.ones = np.flatnonzero(self.bits)
        self.at = 0
        self.raw = data

    def take(self, n: int) -> int:
        if not n:
            return 0
        first, last = self.at // 8, (self.at + n + 7) // 8
        if last > len(self.raw):
            raise ValueError("the FLAC stream ends within a frame")
        v = int.from_bytes(self.raw[first:last], "big") >> (last * 8 - self.at - n)
        self.at += n
        return v & (1 << n) - 1

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> n - 1 else v

    def unary(self) -> int:
        k = int(np.searchsorted(self.ones, self.at))
        if k == len(self.ones):
            raise ValueError("the FLAC stream ends within a frame")
        n = int(self.ones[k]) - self.at
        self.at += n + 1
        return n


def _residual(r: _Reader, size: int, order: int) -> list[int]:
    method = r.take(2)
    if method > 1:
        raise ValueError("unknown FLAC residual coding")
    width = 4 + method
    parts = 1 << r.take(4)
    out: list[int] = []
    for p in range(parts):
        n = size // parts - (order if p == 0 else 0)
        k = r.take(width)
        if k == (1 << width) - 1:
            raw = r.take(5)
            out += [r.signed(raw) for _ in range(n)]
        else:
            for _ in range(n):
                u = r.unary() << k | r.take(k)
                out.append(u >> 1 ^ -(u & 1))
    return out


def _predict(warm: list[int], residual: list[int], coeffs: list[int], shift: int) -> list[int]:
    out, order = list(warm), len(coeffs)
    for e in residual:
        out.append(e + (sum(c * out[-1 - j] for j, c in enumerate(coeffs)) >> shift) if order else e)
    return out


def _subframe(r: _Reader, size: int, bits: int) -> list[int]:
    r.take(1)
    kind, wasted = r.take(6), 0
    if r.take(1):
        wasted = r.unary() + 1
    bits -= wasted
    if kind == 0:
        out = [r.signed(bits)] * size
    elif kind == 1:
        out = [r.signed(bits) for _ in range(size)]
    elif 8 <= kind <= 12:
        order = kind - 8
        warm = [r.signed(bits) for _ in range(order)]
        out = _predict(warm, _residual(r, size, order), _FIXED[order], 0)
    elif kind >= 32:
        order = kind - 31
        warm = [r.signed(bits) for _ in range(order)]
        precision, shift = r.take(4) + 1, r.signed(5)
        coeffs = [r.signed(precision) for _ in range(order)]
        out = _predict(warm, _residual(r, size, order), coeffs, shift)
    else:
        raise ValueError("reserved FLAC subframe")
    return [v << wasted for v in out] if wasted else out


def _pcm_md5(x: np.ndarray, bits: int) -> bytes:
    size = (bits + 7) // 8
    raw = np.ascontiguousarray(x.astype("<i8")).reshape(-1, 1).view(np.uint8).reshape(-1, 8)[:, :size]
    return hashlib.md5(raw.tobytes()).digest()


def decode(data: bytes) -> tuple[np.ndarray, dict]:
    """((frames, channels) samples, stream info) of a whole stream; checksums are verified."""
    info = stream_info(data)
    r = _Reader(data[info["begin"] :])
    blocks = []
    while r.at + 80 <= len(r.bits) and (not info["frames"] or sum(map(len, blocks)) < info["frames"]):
        begin = r.at // 8
        if r.take(15) != 0x7FFC:
            raise ValueError("no FLAC frame where one should begin")
        r.take(1)
        size_code, rate_code, assignment, bits_code = r.take(4), r.take(4), r.take(4), r.take(3)
        r.take(1)
        lead = r.take(8)
        while lead & 0x80 and lead & 0x40:
            r.take(8)
            lead = lead << 1 & 0xFF
        size = _SIZES.get(size_code) or r.take(8 if size_code == 6 else 16) + 1
        if rate_code >= 12:
            r.take(8 if rate_code == 12 else 16)
        head = r.raw[begin : r.at // 8]
        if r.take(8) != _crc8(head):
            raise ValueError("a FLAC frame header is damaged")
        bits = _BITS.get(bits_code, info["bits"])
        channels = assignment + 1 if assignment < 8 else 2
        side = {8: 1, 9: 0, 10: 1}.get(assignment)
        parts = [np.array(_subframe(r, size, bits + (c == side)), np.int64) for c in range(channels)]
        if assignment == 8:
            parts[1] = parts[0] - parts[1]
        elif assignment == 9:
            parts[0] = parts[0] + parts[1]
        elif assignment == 10:
            mid = parts[0] * 2 + (parts[1] & 1)
            parts = [mid + parts[1] >> 1, mid - parts[1] >> 1]
        r.at += -r.at % 8
        body = r.raw[begin : r.at // 8]
        if r.take(16) != _crc16(body):
            raise ValueError("a FLAC frame is damaged")
        blocks.append(np.stack(parts, axis=1))
    out = np.concatenate(blocks) if blocks else np.zeros((0, info["channels"]), np.int64)
    if any(info["md5"]) and _pcm_md5(out, info["bits"]) != info["md5"]:
        raise ValueError("the FLAC samples do not have the stream's MD5")
    return out, info


def _field(value: int, n: int) -> np.ndarray:
    return np.array([value >> (n - 1 - k) & 1 for k in range(n)], np.uint8)


def _rice(residual: np.ndarray, k: int) -> np.ndarray:
    """Bits of folded residuals with parameter ``k``."""
    u = np.where(residual < 0, -2 * residual - 1, 2 * residual)
    q = u >> k
    ends = np.cumsum(q + 1 + k)
    stop = ends - k - 1
    out = np.zeros(int(ends[-1]) if len(u) else 0, np.uint8)
    out[stop] = 1
    for j in range(k):
        out[stop + 1 + j] = u >> (k - 1 - j) & 1
    return out


def _encode_channel(x: np.ndarray, bits: int) -> np.ndarray:
    """The smallest of constant, verbatim and fixed-predictor subframes."""
    if (x == x[0]).all():
        return np.concatenate([_field(0, 8), _field(int(x[0]) & (1 << bits) - 1, bits)])
    verbatim = bits * len(x)
    best, chosen = verbatim, None
    for order in range(min(5, len(x))):
        rest = np.diff(x, n=order)
        u = np.where(rest < 0, -2 * rest - 1, 2 * rest)
        k = min(14, max(0, int(np.log2(max(1.0, float(u.mean()))))))
        cost = order * bits + int((u >> k).sum()) + len(u) * (k + 1) + 10
        if cost < best:
            best, chosen = cost, (order, k, rest)
    signed = (x & (1 << bits) - 1)[:, None] >> np.arange(bits - 1, -1, -1) & 1
    if chosen is None:
        return np.concatenate([_field(1 << 1, 8), signed.astype(np.uint8).reshape(-1)])
    order, k, rest = chosen
    return np.concatenate([_field(8 + order << 1, 8), signed[:order].astype(np.uint8).reshape(-1), _field(0, 6), _field(k, 4), _rice(rest, k)])


def _number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << 5 * k + 1)
    tail = bytes(0x80 | n >> 6 * j & 0x3F for j in range(size - 2, -1, -1))
    return bytes([(0xFF00 >> size & 0xFF) | n >> 6 * (size - 1)]) + tail


def encode(x: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """A stream of (frames, channels) samples of ``bits`` bits."""
    n, channels = x.shape
    if not 1 <= channels <= MAX_CHANNELS:
        raise ValueError(f"FLAC holds no {channels} channels")
    x = x.astype(np.int64)
    packed = (rate << 44 | channels - 1 << 41 | bits - 1 << 36 | n).to_bytes(8, "big")
    out = b"fLaC\x80\x00\x00\x22" + BLOCK.to_bytes(2, "big") * 2 + bytes(6) + packed + _pcm_md5(x, bits)
    for number, begin in enumerate(range(0, n, BLOCK)):
        part = x[begin : begin + BLOCK]
        head = b"\xff\xf8\x70" + bytes([channels - 1 << 4]) + _number(number) + (len(part) - 1).to_bytes(2, "big")
        head += bytes([_crc8(head)])
        frame = head + np.packbits(np.concatenate([_encode_channel(part[:, c], bits) for c in range(channels)])).tobytes()
        out += frame + _crc16(frame).to_bytes(2, "big")
    return out
