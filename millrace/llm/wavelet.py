"""Wavelet matrix files: a sequence of token ids with access, rank and select from its compressed form.

The matrix has one bit-plane per bit of an id, highest first. Plane l holds bit l of each id in the
order that the planes above give: ids whose bit there is 0 come before those with a 1, each part in
the order it had. So all equal ids end up side by side, and a position moves from one plane to the
next by counting bits before it.

A file holds, after MAGIC and the size of its index: the index (JSON, compressed), then the blocks of
all planes, each BLOCK bits, compressed one by one unless that makes them larger. The index states for
every block its place and the ones before it, and for every document its id and number of ids. A reader
unpacks only the blocks that a question touches.
"""

from __future__ import annotations

import json
import struct
from collections import OrderedDict

import numpy as np
import zstandard

MAGIC = b"WAVEMAT1"
#: Bits of a block, and unpacked blocks that a reader keeps.
BLOCK = 1 << 16
KEPT = 64


def pack(ids: np.ndarray, documents: list[tuple[int | None, int]], **more: int) -> bytes:
    """The file of a sequence of ids; documents are (id, number of token ids) in order."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    order = ids.astype(np.uint32)
    blocks, zeros, places = [], [], []
    at = 0
    for level in range(levels):
        bits = (order & np.uint32(1 << (levels - 1 - level))) != 0
        zeros.append(int(len(bits) - np.count_nonzero(bits)))
        ones = 0
        for start in range(0, len(bits), BLOCK):
            part = bits[start : start + BLOCK]
            raw = np.packbits(part).tobytes()
            small = squeeze(raw)
            blocks.append(small if len(small) < len(raw) else raw)
            places.append((at, len(blocks[-1]), len(small) < len(raw), ones))
            at += len(blocks[-1])
            ones += int(np.count_nonzero(part))
        order = np.concatenate([order[~bits], order[bits]])
    index = {"n": len(ids), "levels": levels, "zeros": zeros, "blocks": places, "documents": documents, **more}
    head = squeeze(json.dumps(index).encode())
    return b"".join([MAGIC, struct.pack("<Q", len(head)), head, *blocks])


class Wavelet:
    """Questions about the ids of a file. Positions count from 0; rank looks at the positions before its own."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (size,) = struct.unpack_from("<Q", content, 8)
        self.expand = zstandard.ZstdDecompressor().decompress
        self.content, self.start = content, 16 + size
        self.index = json.loads(self.expand(content[16 : self.start]))
        self.n, self.levels, self.zeros = self.index["n"], self.index["levels"], self.index["zeros"]
        self.per_level = -(-self.n // BLOCK)
        places = np.array(self.index["blocks"], np.int64).reshape(self.levels, self.per_level, 4)
        self.places, self.before = places, places[:, :, 3]
        self.documents = [(i, n) for i, n in self.index["documents"]]
        self.starts = np.concatenate([[0], np.cumsum([n for _, n in self.documents], dtype=np.int64)])
        self.unpacked: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()

    def bits(self, level: int, block: int) -> np.ndarray:
        """The bits of a block as 0 and 1."""
        key = level, block
        if key not in self.unpacked:
            at, size, squeezed, _ = (int(x) for x in self.places[level, block])
            raw = self.content[self.start + at : self.start + at + size]
            raw = self.expand(raw) if squeezed else raw
            count = min(BLOCK, self.n - block * BLOCK)
            self.unpacked[key] = np.unpackbits(np.frombuffer(raw, np.uint8), count=count)
            if len(self.unpacked) > KEPT:
                self.unpacked.popitem(last=False)
        self.unpacked.move_to_end(key)
        return self.unpacked[key]

    def bit(self, level: int, i: int) -> int:
        return int(self.bits(level, i // BLOCK)[i % BLOCK])

    def ones(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        if i >= self.n:
            return self.n - self.zeros[level]
        block = i // BLOCK
        return int(self.before[level, block]) + int(np.count_nonzero(self.bits(level, block)[: i % BLOCK]))

    def down(self, level: int, i: int, bit: int) -> int:
        """Where position i goes in the plane below, if its bit is `bit`."""
        ones = self.ones(level, i)
        return self.zeros[level] + ones if bit else i - ones

    def access(self, i: int) -> int:
        """The id at a position."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        made = 0
        for level in range(self.levels):
            bit = self.bit(level, i)
            made = made << 1 | bit
            i = self.down(level, i, bit)
        return made

    def spread(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """The places below the last plane of the token's occurrences in [lo, hi)."""
        if token < 0 or token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            bit = token >> (self.levels - 1 - level) & 1
            lo, hi = self.down(level, lo, bit), self.down(level, hi, bit)
            if lo == hi:
                return 0, 0
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token in [lo, hi)."""
        hi = self.n if hi is None else min(hi, self.n)
        first, end = self.spread(token, min(lo, hi), hi)
        return end - first

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before position i."""
        return self.count(token, 0, i)

    def find(self, level: int, bit: int, order: np.ndarray) -> np.ndarray:
        """Positions in a plane of the order-th bits of that kind; order is sorted."""
        before = self.before[level] if bit else np.arange(self.per_level) * BLOCK - self.before[level]
        block = np.searchsorted(before, order, "right") - 1
        out = np.empty(len(order), np.int64)
        edges = np.flatnonzero(np.diff(block)) + 1
        for part in np.split(np.arange(len(order)), edges):
            if len(part):
                b = int(block[part[0]])
                out[part] = b * BLOCK + np.flatnonzero(self.bits(level, b) == bit)[order[part] - before[b]]
        return out

    def occurrences(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Positions of a token in [lo, hi), ascending."""
        hi = self.n if hi is None else min(hi, self.n)
        first, end = self.spread(token, min(lo, hi), hi)
        return self.climbed(token, np.arange(first, end))

    def climbed(self, token: int, at: np.ndarray) -> np.ndarray:
        """From places below the last plane up to positions."""
        for level in reversed(range(self.levels)):
            bit = token >> (self.levels - 1 - level) & 1
            at = self.find(level, bit, at - self.zeros[level] if bit else at)
        return at

    def select(self, token: int, k: int) -> int:
        """The position of the k-th occurrence of a token, from 0."""
        first, end = self.spread(token, 0, self.n)
        if not 0 <= k < end - first:
            raise IndexError(k)
        return int(self.climbed(token, np.array([first + k]))[0])

    def tokens(self) -> np.ndarray:
        """All ids: from below the last plane up, each plane says which of its ids come from the front part."""
        made = np.zeros(self.n, np.uint32)
        for level in reversed(range(self.levels)):
            bits = np.concatenate([self.bits(level, b) for b in range(self.per_level)]) if self.n else np.zeros(0, np.uint8)
            ones = bits.view(bool)
            above = np.empty_like(made)
            above[~ones] = made[: self.zeros[level]]
            above[ones] = made[self.zeros[level] :] | np.uint32(1 << (self.levels - 1 - level))
            made = above
        return made

    def place(self, i: int) -> tuple[int, int]:
        """The document of a position, as its number in the file, and the place in it."""
        d = int(np.searchsorted(self.starts, i, "right")) - 1
        return d, i - int(self.starts[d])
