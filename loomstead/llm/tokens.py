"""Token ids by the tokenizers library, with each distinct piece of text encoded once per worker.

Both vocabularies cut a text into pieces before any merge, so the ids of a text
are the ids of its pieces, one after the other. The cuts of a batch are found in
one pass over its bytes: runs of letters, digits and other signs, and white
space. Arrow names the distinct pieces, the library's model merges those that a
worker has not met lately (a bounded table of two generations), and the ids of
all texts are gathered by their places.

Bytes that the pass has no rule for (apostrophes, control signs, letters beyond
Latin Extended-A, other scripts) make the run between white space one piece,
which the library encodes as a text of its own. A text that may hold an added
token, or white space beyond ASCII where white space has ids, goes to the library
whole. The ids are those of ``encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa

from loomstead.llm.common import cut_at_space

#: Entries of one generation of a worker's table, and bytes of a piece that is kept in it.
CACHE_ENTRIES, CACHE_BYTES = 250_000, 64
#: Bytes of text that are cut at once.
PASS_BYTES = 4 << 20

_OTHER, _LETTER, _DIGIT, _SPACE, _ODD = range(5)
#: UTF-8 of white space beyond ASCII, and control signs that some definition counts as white space.
_WIDE_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8f\xa8\xa9\xaf]|\x81[\x9f\xa0])|\xe3\x80\x80|\xef\xbb\xbf")
_SPACES = b" \t\n\r\x0b\x0c"


def _classes() -> np.ndarray:
    """The class of each byte; letters of U+00C0 to U+017F take two bytes, both of class _LETTER."""
    out = np.full(256, _ODD, np.uint8)
    out[0x21:0x7F] = _OTHER
    for first, last, kind in ((0x41, 0x5A, _LETTER), (0x61, 0x7A, _LETTER), (0x30, 0x39, _DIGIT), (0x80, 0xBF, _LETTER), (0xC3, 0xC5, _LETTER)):
        out[first : last + 1] = kind
    out[list(_SPACES)] = _SPACE
    out[ord("'")] = _ODD
    return out


_CLASSES = _classes()
#: Two-byte signs of that range that are no letters or change their length in lower case: U+00D7, U+00F7, U+0130.
_NO_LETTER = [(0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0)]
#: Finds the bytes of class _ODD, and those signs.
_NO_RULE = re.compile(rb"['\x00-\x08\x0e-\x1f\x7f\xc0-\xc2\xc6-\xff]|\xc3[\x97\xb7]|\xc4\xb0")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Table:
    """A map of two generations; at most 2 * CACHE_ENTRIES entries."""

    def __init__(self, make):
        self.make, self.young, self.old = make, {}, {}

    def get(self, key: bytes) -> bytes:
        """The value of a key that is not in the young generation."""
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= CACHE_BYTES:
            if len(self.young) >= CACHE_ENTRIES:
                self.old, self.young = self.young, {}
            self.young[key] = found
        return found


class Encoder:
    """Ids of texts. kind: "word" (lower case, white space is dropped) or "byte" (white space is encoded)."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.kind = self.tokenizer.model, kind
        self.letters = _byte_letters()
        self.pieces = Table(self._piece)

    def whole(self, text: bytes) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4")

    def _piece(self, piece: bytes) -> bytes:
        """Ids of a piece, as little-endian uint32."""
        if _NO_RULE.search(piece):
            return self.whole(piece).tobytes()
        if self.kind == "word":
            if piece[0] in _SPACES:
                return b""
            piece = piece.lower() if piece.isascii() else piece.decode().lower().encode()
        ids = [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _apart(self, text: bytes) -> bool:
        """Whether a text goes to the library whole."""
        return b"<|" in text or (self.kind == "byte" and bool(_WIDE_SPACE.search(text)))

    def _starts(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where pieces begin in texts laid end to end; ``begins`` has the first byte of each text."""
        kind = _CLASSES[data]
        for a, b in _NO_LETTER:
            at = np.flatnonzero(data[:-1] == a)
            kind[at[data[at + 1] == b]] = _ODD
        space, first = kind == _SPACE, np.zeros(len(data), bool)
        first[begins] = True
        before = np.empty(len(data), bool)  # white space stands before
        before[0], before[1:] = False, space[:-1]
        start = np.empty(len(data), bool)
        start[0], start[1:] = True, kind[1:] != kind[:-1]
        if self.kind == "word":
            start |= kind == _DIGIT
        else:
            # of a run of white space before a word, the last sign is cut off; a blank goes with the word
            last = np.empty(len(data), bool)
            last[-1], last[:-1] = False, ~space[1:] & ~first[1:]
            start |= space & last
            start[1:] &= space[1:] | (data[:-1] != 32)
        start |= first
        odd = np.flatnonzero(kind == _ODD)
        if len(odd):
            run = ~space & (before | first)  # a run between white space begins
            number = np.cumsum(run, dtype=np.int32)
            held = np.zeros(int(number[-1]) + 1, bool)
            held[number[odd]] = True
            start &= space | ~held[number] | run
        return np.flatnonzero(start)

    def _pass(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts that are not empty and not apart."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        begins = np.cumsum([0, *map(len, texts)])
        starts = self._starts(data, begins[:-1])
        offsets = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        place = np.asarray(pieces.indices)
        get, young = self.pieces.get, self.pieces.young
        values = [young[p] if p in young else get(p) for p in pieces.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        pool, at = np.frombuffer(b"".join(values), "<u4"), np.cumsum(sizes) - sizes
        n = sizes[place]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(at[place] - ends[:-1], n) + np.arange(ends[-1])]
        edge = ends[np.searchsorted(starts, begins)]
        return [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text (uint32)."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        owners: list[int] = []
        parts: list[bytes] = []
        held = 0

        def flush():
            nonlocal owners, parts, held
            for i, ids in zip(owners, self._pass(parts) if parts else ()):
                out[i].append(ids)
            owners, parts, held = [], [], 0

        for i, text in enumerate(texts):
            if self._apart(text):
                flush()
                out[i].append(self.whole(text))
                continue
            for part in cut_at_space(text, PASS_BYTES) if text else ():
                if held + len(part) > PASS_BYTES:
                    flush()
                owners.append(i)
                parts.append(part)
                held += len(part)
        flush()
        empty = np.zeros(0, "<u4")
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else empty for x in out]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text.encode()])[0]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]
