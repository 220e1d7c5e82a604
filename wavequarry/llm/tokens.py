"""Token ids of whole texts, as little-endian unsigned 32-bit bytes.

The ids are those of the tokenizers library with the file as it stands, so the
text of an added token is that token.  A byte-level vocabulary never
joins a piece across a space that stands between two other characters, so
texts are cut before such spaces.  The cuts of many texts are found at once in
their bytes, Arrow numbers the distinct ones, only these are looked up in a
byte-bounded two-generation cache, and the ids of all cuts are gathered by number.
A cut made of words of letters on lines of their own, each with optional marks
behind it, goes word by word straight to the library's merge model, and its
words are kept as cuts of their own; every other cut goes through the whole
tokenizer.
"""

from __future__ import annotations

import array
import os
import re
import string
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from .common import release_memory

#: Bytes of text whose cuts are numbered together.
CHUNK = 4 << 20
#: Bytes that a generation of the cache holds, about, and bytes of the longest cut that it keeps.
CACHE_BYTES, KEPT_CUT = 72 << 20, 64
#: A space at which a text may be cut.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than ASCII, in UTF-8.
_WHITE2 = np.array([int.from_bytes(c.encode()) for c in "\u0085\u00a0"])
_WHITE3 = np.array([int.from_bytes(c.encode()) for c in ["\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]])
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([{0}]*)(?:\n([A-Za-zÀ-ÖØ-öø-ÿ]+)([{0}]*))?".replace("{0}", re.escape(string.punctuation)))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class _Cache(dict):
    """Key -> bytes of ids; two generations of about ``limit`` bytes, objects included.

    Keys of over ``KEPT_CUT`` characters are made anew each time.
    """

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit, self.held = make, limit, 0
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > KEPT_CUT:
            return self.make(key)
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        # a slot of the dictionary takes about 100 bytes, the two objects' heads about 90
        self.held += 190 + len(key) + len(found)
        self[key] = found
        return found

    def trim(self) -> None:
        if self.held > self.limit:
            self.older = dict(self)
            self.clear()
            self.held = 0


class TextEncoder:
    """Encodes texts with one tokenizer file.

    ``limit`` bounds the bytes that a generation of the cache holds between chunks.
    """

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cuts = _Cache(self.encode_cut, limit)
        self.marks = _Cache(self.whole, limit // 16)
        self.alphabet = _byte_alphabet()
        kind = type(self.tokenizer.pre_tokenizer).__name__
        self.byte_level = kind == "ByteLevel" and self.tokenizer.normalizer is None

    @staticmethod
    def _pack(ids: Iterable[int]) -> bytes:
        return array.array("I", ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        """The ids of letters, with or without a space before them."""
        stands_in = word.replace(" ", self.alphabet[32]) if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        return self._pack([t.id for t in self.model.tokenize(stands_in)])

    def encode_cut(self, cut: str) -> bytes:
        """The ids of a cut, which holds the space before it."""
        plain = _PLAIN.fullmatch(cut)
        if not plain:
            return self.whole(cut)
        word, marks, below, last = plain.groups()
        if not marks and not below:
            return self._word(word)
        ids = self.cuts[word]
        if marks:
            ids += self.marks[marks]
        if below:
            ids += self.marks["\n"] + self.cuts[below]
            if last:
                ids += self.marks[last]
        return ids

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each of ``pieces``, whose joined bytes are numbered together."""
        ends = np.cumsum([len(piece) for piece in pieces])
        firsts = ends - [len(piece) for piece in pieces]
        data = b"".join(pieces)
        begins, first_cut = _cuts(data, firsts, ends)
        offsets = np.append(begins, len(data)).astype(np.int32)
        cuts = pa.Array.from_buffers(pa.string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        number = cuts.indices.to_numpy()
        found = list(map(self.cuts.__getitem__, cuts.dictionary.to_numpy(zero_copy_only=False)))
        known = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        lengths = size[number]
        after = np.cumsum(lengths)
        before = (np.cumsum(size) - size)[number]
        ids = known[np.repeat(before - (after - lengths), lengths) + np.arange(int(after[-1]))].tobytes()
        bounds = (4 * np.append(0, after)[np.append(first_cut, len(begins))]).tolist()
        for cache in (self.cuts, self.marks):
            cache.trim()
        return [ids[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, four bytes each; a null text has none.

        About ``CHUNK`` bytes of texts are held at a time; a longer text is
        encoded in pieces.
        """
        held: list[bytes] = []
        size = 0
        for text in texts:
            text = text or ""
            if not self.byte_level:
                yield self.whole(text)
                continue
            if len(text) > CHUNK:
                if held:
                    yield from self._encode_pieces(held)
                    held, size = [], 0
                yield b"".join(self._encode_pieces([piece.encode()])[0] for piece in _pieces(text))
                continue
            held.append(text.encode())
            size += len(held[-1])
            if size >= CHUNK:
                yield from self._encode_pieces(held)
                held, size = [], 0
        if held:
            yield from self._encode_pieces(held)

    def rest(self) -> None:
        """Between tasks: only the newer generation stays, and freed memory goes back to the system."""
        for cache in (self.cuts, self.marks):
            cache.older = {}
        release_memory()

    def encode(self, text: str) -> bytes:
        """The ids of ``text``, four bytes each."""
        return next(self.encode_many([text]))


def _pieces(text: str) -> Iterator[str]:
    """A long text in pieces of ``CHUNK`` characters, each up to the next place to cut."""
    begin = 0
    while cut := _CUT.search(text, begin + CHUNK):
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def _cuts(data: bytes, firsts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where cuts begin in ``data``, the number of each text's first cut).

    Texts lie in ``data`` from ``firsts`` to ``ends``.  A cut begins where a
    text does, and at a space with no white space and no end of the text beside it.
    """
    raw = np.frombuffer(b"\0\0\0" + data + b"\0\0\0", np.uint8)
    white = np.zeros(256, bool)
    white[[*range(9, 14), *range(28, 33)]] = True
    at = np.flatnonzero(raw == 32)
    before, after = raw[at - 1], raw[at + 1]
    fits = ~(white[before] | white[after])
    wide = np.flatnonzero(fits & ((before | after) > 127))
    if len(wide):
        here = at[wide]
        three = [raw[here + k].astype(np.int64) << 16 | raw[here + k + 1].astype(np.int64) << 8 | raw[here + k + 2] for k in (-3, 1)]
        fits[wide] = ~(np.isin(three, _WHITE3).any(axis=0) | np.isin(three[0] & 0xFFFF, _WHITE2) | np.isin(three[1] >> 8, _WHITE2))
    at = at[fits] - 3
    edge = np.zeros(len(data) + 2, bool)
    edge[firsts] = True
    edge[ends] = True
    at = at[~(edge[at] | edge[at + 1])]
    rank = np.searchsorted(at, firsts)
    return np.insert(at, rank, firsts), rank + np.arange(len(firsts))


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder per worker and file; workers outlive tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
