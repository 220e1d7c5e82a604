"""ADPCM steps, as Catalyst folds and as plain functions for long files.

A fold carries its state through ``aggregate`` and appends to an array, which
suits blocks of up to a few thousand samples; the plain functions hold the
same recurrences for whole files in a Python worker.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .samples import let

# Fixed values of the codecs.
IMA_INDEX = [-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8]
IMA_STEP = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411,
    1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493,
    10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
MS_ADAPT = [230, 230, 230, 230, 307, 409, 512, 614, 768, 614, 512, 409, 307, 230, 230, 230]
MS_COEFFS = [(256, 0), (512, -256), (0, 0), (192, 64), (240, 0), (460, -208), (392, -232)]
YAMAHA_SCALE = [230, 230, 230, 230, 307, 409, 512, 614, 230, 230, 230, 230, 307, 409, 512, 614]
YAMAHA_DIFF = [1, 3, 5, 7, 9, 11, 13, 15, -1, -3, -5, -7, -9, -11, -13, -15]


def _long(value: Column | int) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("long")


def _table(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[_long(v) for v in values]), (at + 1).cast("int"))


def _div(a: Column, b: Column | int) -> Column:
    """Division that truncates toward zero; the products here are exact in doubles."""
    q = a / b
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("long")


def _clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.least(x, _long(high)), _long(low))


def _fold(values: Column, first: dict[str, int | Column], step) -> Column:
    """The array of outputs; ``step(state, x)`` gives the new state with ``o``, the output."""
    start = F.struct(*[_long(v).alias(k) for k, v in first.items()], F.array().cast("array<bigint>").alias("out"))

    def merge(state: Column, x: Column) -> Column:
        return let(step(state, _long(x)), lambda n: F.struct(*[n[k].alias(k) for k in first], F.array_append(state["out"], n["o"]).alias("out")))

    return F.aggregate(values, start, merge, lambda s: s["out"])


def _ima_next(state: Column, nibble: Column) -> Column:
    size = F.shiftright(_table(IMA_STEP, state["i"]) * (nibble % 8 * 2 + 1), 3)
    p = _clamp(F.when(nibble >= 8, state["p"] - size).otherwise(state["p"] + size), -32768, 32767)
    return F.struct(p.alias("p"), _clamp(state["i"] + _table(IMA_INDEX, nibble), 0, 88).alias("i"), nibble.alias("n"))


def ima_encode(samples: Column, predictor: int | Column = 0, index: int | Column = 0) -> Column:
    """Nibbles of 16-bit samples, one block."""

    def step(state: Column, x: Column) -> Column:
        size = F.least(F.floor(F.abs(x - state["p"]) * 4 / _table(IMA_STEP, state["i"])).cast("long"), _long(7))
        nibble = size + F.when(x < state["p"], _long(8)).otherwise(_long(0))
        return let(nibble, lambda n: let(_ima_next(state, n), lambda s: F.struct(s["p"].alias("p"), s["i"].alias("i"), n.alias("o"))))

    return _fold(samples, {"p": predictor, "i": index}, step)


def ima_decode(nibbles: Column, predictor: int | Column = 0, index: int | Column = 0) -> Column:
    """Samples of the nibbles of one block (the header's sample not among them)."""
    return _fold(nibbles, {"p": predictor, "i": index}, lambda state, n: let(_ima_next(state, n), lambda s: F.struct(s["p"].alias("p"), s["i"].alias("i"), s["p"].alias("o"))))


def _ms_next(state: Column, predicted: Column, nibble: Column, most: int) -> Column:
    signed = F.when(nibble >= 8, nibble - 16).otherwise(nibble)
    return F.struct(
        _clamp(predicted + signed * state["d"], -32768, 32767).alias("s1"),
        state["s1"].alias("s2"),
        _clamp(F.shiftright(_table(MS_ADAPT, nibble) * state["d"], 8), 16, most).alias("d"),
    )


def _ms_predicted(state: Column, c1: Column, c2: Column) -> Column:
    return _div(state["s1"] * c1 + state["s2"] * c2, 256)


def ms_encode(samples: Column, s1: int | Column = 0, s2: int | Column = 0, delta: int | Column = 16, predictor: int = 0) -> Column:
    """Nibbles of the samples behind a block's header."""
    c1, c2 = map(_long, MS_COEFFS[predictor])

    def step(state: Column, x: Column) -> Column:
        def with_predicted(p: Column) -> Column:
            rest = x - p
            bias = F.when(rest >= 0, _div(state["d"], 2)).otherwise(_div(-state["d"], 2))
            nibble = F.pmod(_clamp(_div(rest + bias, state["d"]), -8, 7), _long(16))
            return let(nibble, lambda n: let(_ms_next(state, p, n, 2**31 - 1), lambda s: F.struct(s["s1"].alias("s1"), s["s2"].alias("s2"), s["d"].alias("d"), n.alias("o"))))

        return let(_ms_predicted(state, c1, c2), with_predicted)

    return _fold(samples, {"s1": s1, "s2": s2, "d": delta}, step)


def ms_decode(nibbles: Column, s1: int | Column = 0, s2: int | Column = 0, delta: int | Column = 16, predictor: int = 0) -> Column:
    """Samples of a block's nibbles (the header's two samples not among them)."""
    c1, c2 = map(_long, MS_COEFFS[predictor])

    def step(state: Column, n: Column) -> Column:
        return let(_ms_next(state, _ms_predicted(state, c1, c2), n, (2**31 - 1) // 768), lambda s: F.struct(s["s1"].alias("s1"), s["s2"].alias("s2"), s["d"].alias("d"), s["s1"].alias("o")))

    return _fold(nibbles, {"s1": s1, "s2": s2, "d": delta}, step)


def _yamaha_next(state: Column, nibble: Column) -> Column:
    p = state["p"] + _clamp(_div(state["s"] * _table(YAMAHA_DIFF, nibble), 8), -32768, 32767)
    return F.struct(p.alias("p"), _clamp(F.shiftright(state["s"] * _table(YAMAHA_SCALE, nibble), 8), 127, 24576).alias("s"))


def yamaha_encode(samples: Column) -> Column:
    """Nibbles of a whole file's samples of one channel."""

    def step(state: Column, x: Column) -> Column:
        nibble = F.least(F.floor(F.abs(x - state["p"]) * 4 / state["s"]).cast("long"), _long(7)) + F.when(x < state["p"], _long(8)).otherwise(_long(0))
        return let(nibble, lambda n: let(_yamaha_next(state, n), lambda s: F.struct(s["p"].alias("p"), s["s"].alias("s"), n.alias("o"))))

    return _fold(samples, {"p": 0, "s": 127}, step)


def yamaha_decode(nibbles: Column) -> Column:
    """Samples of nibbles; the predictor wraps to 16 bits on output only."""

    def step(state: Column, n: Column) -> Column:
        return let(_yamaha_next(state, n), lambda s: F.struct(s["p"].alias("p"), s["s"].alias("s"), (F.pmod(s["p"] + 32768, _long(65536)) - 32768).alias("o")))

    return _fold(nibbles, {"p": 0, "s": 127}, step)


# ---- the same recurrences for whole files ----


def _trunc(a: int, b: int) -> int:
    return a // b if (a >= 0) == (b >= 0) or a % b == 0 else a // b + 1


class Ima:
    """State of one channel."""

    def __init__(self, predictor: int = 0, index: int = 0):
        self.p, self.i = predictor, index

    def expand(self, nibble: int) -> int:
        size = IMA_STEP[self.i] * (2 * (nibble & 7) + 1) >> 3
        self.p = max(-32768, min(32767, self.p - size if nibble & 8 else self.p + size))
        self.i = max(0, min(88, self.i + IMA_INDEX[nibble]))
        return self.p

    def compress(self, sample: int) -> int:
        nibble = min(abs(sample - self.p) * 4 // IMA_STEP[self.i], 7) | (8 if sample < self.p else 0)
        self.expand(nibble)
        return nibble


class Ms:
    def __init__(self, predictor: int = 0, delta: int = 16, s1: int = 0, s2: int = 0, coefficients=None):
        (self.c1, self.c2), self.d, self.s1, self.s2 = (coefficients or MS_COEFFS)[predictor], delta, s1, s2

    def _move(self, predicted: int, nibble: int, most: int) -> int:
        signed = nibble - 16 if nibble & 8 else nibble
        self.s2, self.s1 = self.s1, max(-32768, min(32767, predicted + signed * self.d))
        self.d = max(16, min(most, MS_ADAPT[nibble] * self.d >> 8))
        return self.s1

    def expand(self, nibble: int) -> int:
        return self._move(_trunc(self.s1 * self.c1 + self.s2 * self.c2, 256), nibble, (2**31 - 1) // 768)

    def compress(self, sample: int) -> int:
        predicted = _trunc(self.s1 * self.c1 + self.s2 * self.c2, 256)
        rest = sample - predicted
        nibble = max(-8, min(7, _trunc(rest + (self.d // 2 if rest >= 0 else _trunc(-self.d, 2)), self.d))) & 15
        self._move(predicted, nibble, 2**31 - 1)
        return nibble

    @property
    def state(self) -> tuple[int, int, int]:
        return self.s1, self.s2, self.d

    def compress_same(self, sample: int, n: int) -> list[int]:
        """Nibbles of ``sample`` ``n`` times: once the state comes back, so do the nibbles from there on."""
        seen, states, out = {}, [], []
        for k in range(n):
            first = seen.setdefault(self.state, k)
            if first < k:
                self.s1, self.s2, self.d = states[first + (n - k) % (k - first)]
                return out + [out[first + j % (k - first)] for j in range(n - k)]
            states.append(self.state)
            out.append(self.compress(sample))
        return out


class Yamaha:
    def __init__(self, predictor: int = 0, step: int = 127):
        self.p, self.s = predictor, step

    def expand(self, nibble: int) -> int:
        self.p += max(-32768, min(32767, _trunc(self.s * YAMAHA_DIFF[nibble], 8)))
        self.s = max(127, min(24576, self.s * YAMAHA_SCALE[nibble] >> 8))
        return (self.p + 32768) % 65536 - 32768

    def compress(self, sample: int) -> int:
        nibble = min(7, abs(sample - self.p) * 4 // self.s) + (8 if sample < self.p else 0)
        self.expand(nibble)
        return nibble


def decode_ima(data: bytes, channels: int, block: int) -> Iterator[list[int]]:
    """Frames of IMA blocks: the header's samples first, then four bytes a channel in turn."""
    for at in range(0, len(data), block):
        part = data[at : at + block]
        if len(part) < 4 * channels:
            return
        states, out = [], []
        for c in range(channels):
            if part[4 * c + 3]:
                raise ValueError("the reserved byte of an IMA block header is not zero")
            states.append(Ima(int.from_bytes(part[4 * c : 4 * c + 2], "little", signed=True), min(part[4 * c + 2], 88)))
        out = [[s.p] for s in states]
        for g in range(4 * channels, len(part) - 4 * channels + 1, 4 * channels):
            for c, s in enumerate(states):
                for byte in part[g + 4 * c : g + 4 * c + 4]:
                    out[c] += [s.expand(byte & 15), s.expand(byte >> 4)]
        yield from map(list, zip(*out, strict=True))


def _ms_body(states: list[Ms], body: bytes) -> list[list[int]]:
    nibbles, channels = [n for byte in body for n in (byte >> 4, byte & 15)], len(states)
    return [[s.expand(nibbles[k + c]) for c, s in enumerate(states)] for k in range(0, len(nibbles) - channels + 1, channels)]


def _ms_same(states: list[Ms], pair: bytes, n: int) -> np.ndarray:
    """Frames of two bytes ``n`` times, of one or two channels: once the states come back, so do the frames from there on."""
    seen, out, per = {}, [], 4 // len(states)
    for k in range(n):
        first = seen.setdefault(tuple(s.state for s in states), k)
        if first < k:
            return np.concatenate([np.array(out, np.int16), np.resize(np.array(out[first * per :], np.int16), ((n - k) * per, len(states)))])
        out += _ms_body(states, pair)
    return np.array(out, np.int16)


def ms_frames(data: bytes, channels: int, block: int, coefficients: list[tuple[int, int]] | None = None) -> np.ndarray:
    """(frames, channels) of MS blocks: the two header samples, then high nibbles first; a file may bring its own coefficients."""
    coefficients, out = coefficients or MS_COEFFS, [np.zeros((0, channels), np.int16)]
    for at in range(0, len(data), block):
        part = data[at : at + block]
        if len(part) < 7 * channels:
            break
        if max(part[:channels]) >= len(coefficients):
            raise ValueError("no such MS predictor")
        word = [int.from_bytes(part[channels + 2 * k : channels + 2 * k + 2], "little", signed=True) for k in range(3 * channels)]
        states = [Ms(part[c], word[c], word[channels + c], word[2 * channels + c], coefficients) for c in range(channels)]
        body = part[7 * channels :]
        # a block that is filled up, or ends in silence, ends in equal pairs of bytes
        begin = len(body)
        if channels <= 2:
            raw = np.frombuffer(body, np.uint8)
            begin = int(np.flatnonzero(raw[2:] != raw[:-2])[-1:].sum()) + 1 if len(raw) > 2 else 0
            begin += (len(body) - begin) % 2
        out.append(np.array([[s.s2 for s in states], [s.s1 for s in states], *_ms_body(states, body[:begin])], np.int16))
        if begin < len(body):
            out.append(_ms_same(states, body[begin : begin + 2], (len(body) - begin) // 2))
    return np.concatenate(out)


def decode_ms(data: bytes, channels: int, block: int, coefficients: list[tuple[int, int]] | None = None) -> Iterator[list[int]]:
    """Frames as ``ms_frames`` has them, as lists."""
    yield from ms_frames(data, channels, block, coefficients).tolist()


def decode_yamaha(data: bytes, channels: int) -> Iterator[list[int]]:
    """Frames of a whole file: low nibble first, or left in the low one."""
    states = [Yamaha() for _ in range(channels)]
    for byte in data:
        if channels == 1:
            yield [states[0].expand(byte & 15)]
            yield [states[0].expand(byte >> 4)]
        else:
            yield [states[0].expand(byte & 15), states[1].expand(byte >> 4)]


def encode_ima(frames: list[list[int]], channels: int, block: int = 512) -> bytes:
    """Blocks of ``block`` bytes a channel, each with its header; the last one is filled up with zeros."""
    per_block = (block - 4) * 2
    out, states = bytearray(), [Ima() for _ in range(channels)]
    for at in range(0, len(frames), per_block):
        part = frames[at : at + per_block]
        part = part + [part[-1]] * (-len(part) % 8)
        if at:
            for c, s in enumerate(states):
                s.p = frames[at - 1][c]
        for s in states:
            out += s.p.to_bytes(2, "little", signed=True) + bytes([s.i, 0])
        for g in range(0, len(part), 8):
            for c, s in enumerate(states):
                n = [s.compress(f[c]) for f in part[g : g + 8]]
                out += bytes(a | b << 4 for a, b in zip(n[::2], n[1::2], strict=True))
    return bytes(out)


def encode_ms(frames: list[list[int]], channels: int, block: int = 1024) -> bytes:
    """Blocks of ``block`` bytes a channel, predictor 0; the last one is filled up."""
    per_block = 2 + (block - 7) * 2
    out, delta = bytearray(), [16] * channels
    for at in range(0, len(frames), per_block):
        part = frames[at : at + per_block]
        fill = min(per_block - 2, per_block - len(part))
        part = part + [part[-1]] * (2 - len(part))
        states = [Ms(0, delta[c], part[1][c], part[0][c]) for c in range(channels)]
        out += bytes(channels)
        for values in ([s.d for s in states], [s.s1 for s in states], [s.s2 for s in states]):
            out += b"".join((v & 0xFFFF).to_bytes(2, "little") for v in values)
        own = [[s.compress(f[c]) for f in part[2:]] + s.compress_same(part[-1][c], fill) for c, s in enumerate(states)]
        n = [x for f in zip(*own, strict=True) for x in f]
        out += bytes(a << 4 | b for a, b in zip(n[::2], n[1::2], strict=True))
        delta = [s.d for s in states]
    return bytes(out)


def encode_yamaha(frames: list[list[int]], channels: int) -> bytes:
    states = [Yamaha() for _ in range(channels)]
    n = [s.compress(f[c]) for f in frames for c, s in enumerate(states)]
    n += [0] * (len(n) % 2)
    return bytes(a | b << 4 for a, b in zip(n[::2], n[1::2], strict=True))


def nibbles_of(data: Iterable[int]) -> list[int]:
    return [n for byte in data for n in (byte & 15, byte >> 4)]
