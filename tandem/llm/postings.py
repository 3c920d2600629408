"""Token postings: per bucket of the token hash, which documents hold which tokens how often.

A map task gathers the documents of a *chunk* (some MB of text), and for each
bucket packs the chunk's distinct tokens with their (document, frequency)
postings into one row. A bucket then sees every distinct token of the corpus
share that falls to it, gives each one value, and sends back, per chunk, the
sum of frequency x value for every document it touched; a chunk adds these
up. Rows per shuffle are chunks x buckets, as in any Spark shuffle; a common
token costs a few bytes per document and spreads over the chunks, so no key is
hot.
"""

from __future__ import annotations

import numpy as np
import zstandard

CHUNK_BYTES = 16 << 20


class Chunk:
    """Collects (document, hash, ...) occurrences of one chunk."""

    def __init__(self) -> None:
        self.n_docs = 0
        self.keys: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.freq: list[np.ndarray] = []

    def add(self, hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> None:
        """Hashes of the tokens of ``n_docs`` further documents, with the document of each (from 0)."""
        order = np.lexsort((doc, hashes))
        h, d = hashes[order], doc[order]
        if len(h):
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
            self.keys.append(h[new])
            self.docs.append((d[new] + self.n_docs).astype(np.uint32))
            self.freq.append(np.diff(np.append(new, len(h))).astype(np.uint32))
        self.n_docs += n_docs

    def buckets(self, n: int):
        """(bucket, distinct keys, postings per key, documents, frequencies), by bucket."""
        if not self.keys:
            return
        h, d, f = (np.concatenate(x) for x in (self.keys, self.docs, self.freq))
        order = np.lexsort((d, h))
        h, d, f = h[order], d[order], f[order]
        # the top bits choose the bucket, so buckets are runs of the sorted keys
        bounds = np.array([-(-(b << 64) // n) for b in range(1, n)], dtype=np.uint64) if n > 1 else np.zeros(0, np.uint64)
        cut = [0, *np.searchsorted(h, bounds).tolist(), len(h)]
        for b in range(n):
            lo, hi = cut[b], cut[b + 1]
            if lo < hi:
                k = h[lo:hi]
                new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                yield b, k[new], np.diff(np.append(new, hi - lo)), d[lo:hi], f[lo:hi]


def pack(*arrays: np.ndarray) -> bytes:
    """Several arrays as one compressed blob."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize))], dtype="<u8").tobytes()
    kinds = b"".join(a.dtype.kind.encode() for a in arrays)
    return head + kinds + zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, "<u8", 1)[0])
    dims = np.frombuffer(blob, "<u8", 2 * n, 8).tolist()
    kinds = blob[8 + 16 * n : 8 + 17 * n].decode()
    data = zstandard.ZstdDecompressor().decompress(blob[8 + 17 * n :]) if any(dims[::2]) else b""
    out, at = [], 0
    for k, size, width in zip(kinds, dims[::2], dims[1::2]):
        out.append(np.frombuffer(data, f"<{k}{width}", size, at))
        at += size * width
    return out


def small(a: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest unsigned type."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def sum_by_document(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents touched and the sum of their values (float64 weights)."""
    docs, inverse = np.unique(doc, return_inverse=True)
    return docs, np.bincount(inverse, weights=value, minlength=len(docs))
