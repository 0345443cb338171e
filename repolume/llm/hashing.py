"""Arrays of word hashes, and their transport in compressed blobs."""

from __future__ import annotations

import struct

import numpy as np
import xxhash
import zstandard

KEPT_WORDS, KEPT_BYTES = 100_000, 64  # words kept, and the longest of them
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """64-bit hashes of distinct words."""

    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= KEPT_BYTES:
            self[word] = out
        return out

    def of(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").split()
        if len(self) > KEPT_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * K1
    out += b
    out ^= out >> np.uint64(29)
    out *= K2
    out ^= out >> np.uint64(32)
    return out


def ahead(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros_like(x)
    if n < len(x):
        out[: len(x) - n] = x[n:]
    return out


def prefix_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each place on, by doubling."""
    out, done, power, size = None, 0, words, 1
    while True:
        if length & size:
            out = power if out is None else mix(out, ahead(power, done))
            done += size
        size *= 2
        if size > length:
            return out
        power = mix(power, ahead(power, size // 2))


def pieces(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1 .. of each piece, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def blob_of(*arrays: np.ndarray) -> bytes:
    head = struct.pack("<B", len(arrays)) + b"".join(
        struct.pack("<cBq", a.dtype.kind.encode(), a.dtype.itemsize, len(a)) for a in arrays
    )
    data = b"".join(a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + data)


def arrays_of(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 1 + 10 * data[0]
    for i in range(data[0]):
        kind, size, count = struct.unpack_from("<cBq", data, 1 + 10 * i)
        out.append(np.frombuffer(data, f"{kind.decode()}{size}", count, at))
        at += size * count
    return out
