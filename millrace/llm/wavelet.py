"""A wavelet matrix of token ids in one compressed file.

Layout, little-endian: the magic; a header of seven 64-bit numbers (tokens, documents, planes, and the compressed sizes of
the four tables that follow); then, zstd-compressed, document ids (int64), ends of documents in tokens (int64), the planes'
numbers of zeros (int64), and for every block of every plane its file offset and the ones before it (int64 pairs); then the
blocks. A block is BLOCK bytes of a plane's bits, zstd-compressed, or raw where that is not shorter.

Planes go from the highest bit of a token to the lowest; each orders the tokens by the bits of the planes above, zeros
first, stably. A lookup reads one block in each plane.
"""

from __future__ import annotations

from functools import lru_cache
from io import BytesIO
from typing import BinaryIO

import numpy as np
import zstandard

MAGIC = b"MRWVMTX1"
BLOCK = 8192
_PER = BLOCK * 8
_PART = 1 << 15


def _by_bit(values: np.ndarray, plane: int) -> tuple[np.ndarray, np.ndarray]:
    """The values whose bit is 0, then the others, each in order, and all bits, packed. Done in parts that stay in the cache."""
    mask, zeros, ones, packed = values.dtype.type(1 << plane), [], [], []
    for i in range(0, len(values), _PART):
        part = values[i : i + _PART]
        bit = (part & mask) != 0
        packed.append(np.packbits(bit, bitorder="little"))
        ones.append(part.take(np.flatnonzero(bit)))
        zeros.append(part.take(np.flatnonzero(~bit)))
    return np.concatenate([values[:0], *zeros, *ones]), np.concatenate([np.empty(0, np.uint8), *packed])


def write(out: BinaryIO, tokens: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray, bits: int = 16) -> None:
    """tokens: unsigned, below 2**bits; ends: for each document, the number of tokens up to and including its own."""
    zip_ = zstandard.ZstdCompressor(level=1).compress
    values, blocks, index, zeros, at = tokens, [], [], [], 0
    for plane in range(bits - 1, -1, -1):
        values, packed = _by_bit(values, plane)
        ones = np.bitwise_count(packed)
        before = 0
        for i in range(0, len(packed), BLOCK):
            raw = packed[i : i + BLOCK].tobytes()
            short = zip_(raw)
            if len(short) >= len(raw):
                short = raw
            index += [at, before]
            blocks.append(short)
            at += len(short)
            before += int(ones[i : i + BLOCK].sum(dtype=np.int64))
        index += [at, before]
        zeros.append(len(values) - before)
    tables = [zip_(np.asarray(t, np.int64).tobytes()) for t in (doc_ids, ends, zeros, index)]
    out.write(MAGIC)
    out.write(np.array([len(tokens), len(doc_ids), bits, *map(len, tables)], np.int64).tobytes())
    for part in (*tables, *blocks):
        out.write(part)


class Reader:
    """Token access, counting and occurrence lookup on a file opened for reading."""

    def __init__(self, file: BinaryIO) -> None:
        self.file = file
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a wavelet matrix of this format")
        self.n, docs, self.bits, *sizes = np.frombuffer(file.read(56), np.int64).tolist()
        unzip = zstandard.ZstdDecompressor().decompress
        self.doc_ids, self.ends, self.zeros, index = (np.frombuffer(unzip(file.read(s)), np.int64) for s in sizes)
        self.index = index.reshape(self.bits, -1, 2)
        self.base = len(MAGIC) + 56 + sum(sizes)
        self._unzip = unzip
        self._block = lru_cache(maxsize=256)(self._read_block)

    def _read_block(self, plane: int, k: int) -> np.ndarray:
        start, end = int(self.index[plane, k, 0]), int(self.index[plane, k + 1, 0])
        self.file.seek(self.base + start)
        return self._bits(plane, k, self.file.read(end - start))

    def _bits(self, plane: int, k: int, raw: bytes) -> np.ndarray:
        size = min(_PER, self.n - k * _PER)
        packed = raw if len(raw) == -(-size // 8) else self._unzip(raw)
        return np.unpackbits(np.frombuffer(packed, np.uint8), count=size, bitorder="little")

    def _ones(self, plane: int, i: int) -> int:
        """Ones in the first i bits of the plane."""
        k, rest = divmod(i, _PER)
        return int(self.index[plane, k, 1]) + (int(self._block(plane, k)[:rest].sum(dtype=np.int64)) if rest else 0)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for plane in range(self.bits):
            bit = int(self._block(plane, i // _PER)[i % _PER])
            ones = self._ones(plane, i)
            i = int(self.zeros[plane]) + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the last ordering has the occurrences of token within start..end."""
        for plane in range(self.bits):
            a, b = self._ones(plane, start), self._ones(plane, end)
            z = int(self.zeros[plane])
            start, end = (z + a, z + b) if token >> (self.bits - 1 - plane) & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of token at start..end."""
        if token >> self.bits:
            return 0
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    rank = count

    def _find(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of that value in the plane."""
        low, high = 0, self.index.shape[1] - 1
        while high - low > 1:
            mid = (low + high) // 2
            before = int(self.index[plane, mid, 1])
            if (before if bit else mid * _PER - before) <= k:
                low = mid
            else:
                high = mid
        before = int(self.index[plane, low, 1])
        return low * _PER + int(np.flatnonzero(self._block(plane, low) == bit)[k - (before if bit else low * _PER - before)])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of token."""
        a, b = self._range(token, 0, self.n) if token >> self.bits == 0 else (0, 0)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            i = self._find(plane, bit, i - int(self.zeros[plane]) if bit else i)
        return i

    def document(self, k: int) -> np.ndarray:
        """Tokens of the k-th document."""
        start = int(self.ends[k - 1]) if k else 0
        return np.array([self.access(i) for i in range(start, int(self.ends[k]))], np.uint32)

    def tokens(self) -> np.ndarray:
        """All tokens: the planes are read once each, and the orderings are undone from the last to the first."""
        values = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for plane in range(self.bits - 1, -1, -1):
            edges = self.index[plane, :, 0]
            self.file.seek(self.base + int(edges[0]))
            raw = self.file.read(int(edges[-1] - edges[0]))
            zero, one, up = 0, int(self.zeros[plane]), np.empty_like(values)
            mask = values.dtype.type(1 << (self.bits - 1 - plane))
            for k in range(len(edges) - 1):
                bit = self._bits(plane, k, raw[edges[k] - edges[0] : edges[k + 1] - edges[0]])
                for i in range(0, len(bit), _PART):
                    part, to = bit[i : i + _PART].view(bool), up[k * _PER + i :][: min(_PART, len(bit) - i)]
                    ones, others = np.flatnonzero(part), np.flatnonzero(~part)
                    to[ones] = values[one : one + len(ones)] | mask
                    to[others] = values[zero : zero + len(others)]
                    one, zero = one + len(ones), zero + len(others)
            values = up
        return values


def dumps(tokens: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray, bits: int = 16) -> bytes:
    out = BytesIO()
    write(out, tokens, doc_ids, ends, bits)
    return out.getvalue()
