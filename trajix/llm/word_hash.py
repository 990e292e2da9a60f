"""Word shingles of whole columns of texts, hashed by NumPy.

Words are runs without blanks, A-Z in lower case. Arrow splits a batch of texts and names its
distinct words, each of which is hashed once; shingles are mixed from their words' hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values; one to one."""
    x = (x ^ (x >> np.uint64(33))) * MIX[2]
    x = (x ^ (x >> np.uint64(33))) * MIX[3]
    return x ^ (x >> np.uint64(33))


def words(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts (none null) and, with one more entry than texts, where each text's begin."""
    _, offsets, data = texts.buffers()
    raw = LOWER[np.frombuffer(data, np.uint8)] if data else np.zeros(0, np.uint8)
    low = pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(raw)], offset=texts.offset)
    lists = pc.ascii_split_whitespace(low)
    flat = lists.flatten()
    first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = flat.dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(real)])
    return hashes[coded.indices.to_numpy()[real]] if len(flat) else np.zeros(0, np.uint64), ends[first]


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, and where each text's begin.

    A text with fewer than ``size`` words has its whole sequence as one shingle, one without words none.
    """
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), count)
    begin = np.cumsum(count) - count
    at = np.arange(len(owner)) - begin[owner] + first[:-1][owner]
    length = np.minimum(n, size)[owner]
    out = np.full(len(owner), 0x5851F42D4C957F2D, np.uint64)
    padded = np.append(hashes, np.zeros(size, np.uint64))
    for k in range(size):
        step = mix(out * MIX[0] + padded[at + k] + MIX[1])
        out = np.where(length > k, step, out)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[fresh], owner[fresh]
    return out, np.searchsorted(owner, np.arange(len(n) + 1))


def sequence_keys(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A 128-bit key of each text's words in turn."""
    raw = hashes.tobytes()
    return [xxhash.xxh3_128_digest(raw[8 * i : 8 * j]) for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
