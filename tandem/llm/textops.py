"""Vectorised text primitives used inside tasks: UTF-8 buffers, words, pre-tokens, 64-bit hashes.

All functions work on one byte buffer that holds a run of documents back to
back, with ``offs`` (n + 1 ascending offsets) marking the documents. They use
a few 8-byte arrays per byte of text, so callers feed slices made by
:func:`slices` (a single document is never cut and may exceed the slice size).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_000_000  # the tables of powers then hold 2 ** 20 entries
# ASCII white space of the word rule [^\x20\x09-\x0D]+.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# A-Z to a-z, every other byte unchanged.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# Hashes are polynomials modulo the prime 2^61 - 1 at a fixed random point, so that no text
# clashes by the shape of its bytes alone (modulo 2^64 such texts exist for every base).
_PRIME = (1 << 61) - 1
_P = np.uint64(_PRIME)
_BASE = 0x12F1C1B3A98D5E47 % _PRIME
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_S61, _S31, _S30, _ONE = np.uint64(61), np.uint64(31), np.uint64(30), np.uint64(1)
_POW = np.ones(1, dtype=np.uint64)
_INV = np.ones(1, dtype=np.uint64)
_HALVES: tuple[np.ndarray, np.ndarray] = (_POW >> _S30, _POW & _LOW30)
_SPAN = 1 << 22  # bytes of a span whose two sums cannot exceed 64 bits


def fold61(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers reduced modulo 2^61 - 1."""
    x = (x & _P) + (x >> _S61)
    return np.where(x >= _P, x - _P, x)


def mul61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2^61 - 1 of numbers below it, by halves of 31 bits."""
    ah, al, bh, bl = a >> _S31, a & _LOW31, b >> _S31, b & _LOW31
    mid = ah * bl + al * bh
    low = al * bl
    # 2^62 = 2 and 2^61 = 1 modulo the prime
    return fold61(((ah * bh) << _ONE) + (mid >> _S30) + ((mid & _LOW30) << _S31) + (low & _P) + (low >> _S61))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Halves of the powers of the base (above 30 bits, below) and the powers of its inverse."""
    global _POW, _INV, _HALVES
    if len(_POW) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = []
        for base in (_BASE, pow(_BASE, -1, _PRIME)):
            p = np.ones(1, dtype=np.uint64)
            while len(p) < size:
                p = np.concatenate([p, mul61(p, np.full(len(p), pow(base, len(p), _PRIME), np.uint64))])
            out.append(p)
        _POW, _INV = out
        _HALVES = _POW >> _S30, _POW & _LOW30
    return _HALVES[0][:n], _HALVES[1][:n], _INV[:n]


def _trim():
    """glibc's ``malloc_trim``, or None elsewhere."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


_TRIM = _trim()


def release() -> None:
    """Hand unused memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(run):
    """A function over Arrow batches that hands memory back when its task ends: the worker
    stays for later tasks, and what it keeps is missing to the executor."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (a bijection), so that every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _sums61(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum over each span of (byte + 1) x base^position modulo the prime; spans of at most ``_SPAN`` bytes."""
    high, low, _ = _powers(len(buf) + 1)
    value = buf.astype(np.uint64) + _ONE
    halves = []
    for part in (high, low):  # running sums wrap at 2^64; a span's own sum is below it
        acc = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.multiply(value, part[: len(buf)], out=acc[1:])
        np.cumsum(acc[1:], out=acc[1:])
        halves.append(fold61(acc[end] - acc[start]))
    top = halves[0]
    return fold61(((top & _LOW31) << _S30) + (top >> _S31) + halves[1])


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes give equal hashes wherever they stand.

    Different bytes clash with a chance of about their length in 2^61; where
    a clash would change ids or counts, callers compare bytes (``same_spans``).
    """
    if len(start) == 0:
        return np.zeros(0, dtype=np.uint64)
    _, _, inv = _powers(len(buf) + 1)
    size = end - start
    if int(size.max()) <= _SPAN:
        total = _sums61(buf, start, end)
    else:
        pieces = -(-size // _SPAN)
        pieces[size == 0] = 1
        first = np.cumsum(pieces) - pieces
        at = np.repeat(start, pieces) + (np.arange(int(pieces.sum())) - np.repeat(first, pieces)) * _SPAN
        parts = _sums61(buf, at, np.minimum(at + _SPAN, np.repeat(end, pieces)))
        total = parts[first]
        for i in np.flatnonzero(pieces > 1).tolist():
            total[i] = sum(parts[first[i] : first[i] + pieces[i]].tolist()) % _PRIME
    return mix(mul61(total, inv[start]))


def _words64(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on, as one little-endian number (zeros beyond the end)."""
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))


_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def equal_spans(a: np.ndarray, a_start: np.ndarray, size: np.ndarray, b: np.ndarray, b_start: np.ndarray) -> np.ndarray:
    """Whether the ``size[i]`` bytes at a_start[i] of one buffer are those at b_start[i] of another."""
    ok = np.ones(len(size), dtype=bool)
    todo = np.arange(len(size))
    wa, wb = _words64(a), _words64(b)
    at = 0
    while len(todo) > 32:
        left = size[todo] - at
        differ = (wa[a_start[todo] + at] ^ wb[b_start[todo] + at]) & _HEAD[np.minimum(left, 8)]
        ok[todo[differ != 0]] = False
        todo = todo[(differ == 0) & (left > 8)]
        at += 8
    for i in todo.tolist():
        ok[i] = np.array_equal(a[a_start[i] + at : a_start[i] + size[i]], b[b_start[i] + at : b_start[i] + size[i]])
    return ok


def same_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether span i holds the same bytes as span other[i], for every i."""
    size = end - start
    ok = size == size[other]
    todo = np.flatnonzero(ok & (other != np.arange(len(other))))
    ok[todo] = equal_spans(buf, start[todo], size[todo], buf, start[other[todo]])
    return ok


def distinct_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where, number): one span of each distinct text, and for every span the index of its text in ``where``.

    Found by hash and confirmed by bytes: a span whose bytes differ from those
    of its hash's first span gets a text of its own.
    """
    _, where, number = np.unique(hashes, return_index=True, return_inverse=True)
    odd = np.flatnonzero(~same_spans(buf, start, end, where[number]))
    if len(odd):
        raw, more, found = buf.tobytes(), [], {}
        number = number.copy()
        for i in odd.tolist():
            text = raw[start[i] : end[i]]
            if text not in found:
                found[text] = len(where) + len(more)
                more.append(i)
            number[i] = found[text]
        where = np.concatenate([where, np.array(more, dtype=where.dtype)])
    return where, number


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], (offs - offs[0]).astype(np.int64)


def slices(buf: np.ndarray, offs: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive runs of whole documents of about ``size`` bytes: (first, last + 1, bytes, offsets)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def is_space(buf: np.ndarray) -> np.ndarray:
    return _SPACE[buf]


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of all words ``[^\\x20\\x09-\\x0D]+``; first[d]..first[d+1] are document d's."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    ink = ~_SPACE[buf]
    begin, stop = ink.copy(), ink.copy()
    begin[1:] &= ~ink[:-1]
    stop[:-1] &= ~ink[1:]
    edge = offs[:-1][offs[:-1] < len(buf)]
    begin[edge] = ink[edge]
    edge = offs[1:][offs[1:] > 0] - 1
    stop[edge] = ink[edge]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(stop) + 1, np.searchsorted(start, offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of lower-cased words, first): the words of document d are hashes[first[d]:first[d+1]]."""
    low = lower_ascii(buf)
    start, end, first = word_spans(low, offs)
    return span_hashes(low, start, end), first


# --- pre-tokens of the byte-level pattern ------------------------------------

SPECIAL = b"<|endoftext|>"
_CLASS: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Class of every code point: 0 other, 1 letter, 2 number, 3 white space."""
    global _CLASS
    if _CLASS is None:
        import unicodedata

        import regex
        from tokenizers.pre_tokenizers import ByteLevel

        table = np.zeros(0x110000, dtype=np.uint8)
        kinds = {"L": 1, "N": 2, "Z": 3}
        newer = []
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))
            table[c] = kinds.get(kind[0], 0)
            if kind == "Cn":
                newer.append(chr(c))
        table[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85]] = 3  # control characters that are white space
        # letters and numbers younger than Python's table: as the library splits them
        newer = regex.findall(r"[\p{L}\p{N}]", "".join(newer))
        pieces = {w for w, _ in ByteLevel(add_prefix_space=False).pre_tokenize_str("".join(f"\na{c}\n1{c}" for c in newer))}
        byte_chars = ByteLevel(add_prefix_space=False)
        for c in newer:
            spelled = byte_chars.pre_tokenize_str(c)[0][0]
            table[ord(c)] = 1 if "a" + spelled in pieces else 2 if "1" + spelled in pieces else 0
        _CLASS = table
    return _CLASS


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte position of each) of valid UTF-8."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    b0 = buf[lead]
    cp = b0.astype(np.int32)
    wide = np.flatnonzero(b0 >= 0xC0)
    if len(wide):
        at, head = lead[wide], b0[wide]
        n = len(buf) - 1
        c = [(buf[np.minimum(at + k, n)] & 0x3F).astype(np.int32) for k in (1, 2, 3)]
        h = head.astype(np.int32)
        two = ((h & 0x1F) << 6) | c[0]
        three = ((h & 0x0F) << 12) | (c[0] << 6) | c[1]
        four = ((h & 0x07) << 18) | (c[0] << 12) | (c[1] << 6) | c[2]
        cp[wide] = np.where(head < 0xE0, two, np.where(head < 0xF0, three, four))
    return cp, lead


def _specials(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions of the special string inside single documents, left to right without overlap."""
    raw, found, at = buf.tobytes(), [], 0
    while (at := raw.find(SPECIAL, at)) >= 0:
        d = int(np.searchsorted(offs, at, side="right"))
        if at + len(SPECIAL) <= offs[d]:
            found.append(at)
            at += len(SPECIAL)
        else:
            at += 1
    return np.asarray(found, dtype=np.int64)


def pretokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Split documents as the byte-level pattern does, with special strings as pieces of their own.

    Returns (start, end, first, special): byte spans in order, ``first`` as in
    :func:`word_spans`, and a mask of the spans that are the special string.
    """
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64), np.zeros(0, bool)
    cp, at = code_points(buf)
    kind = _classes()[cp]
    n = len(cp)
    special = _specials(buf, offs)
    cuts = np.unique(np.concatenate([offs[:-1], special, special + len(SPECIAL)]))
    cuts = np.searchsorted(at, cuts[cuts < len(buf)])
    edge = np.zeros(n + 1, dtype=bool)
    edge[cuts] = True
    edge[n] = True
    run = edge.copy()  # first character of each run of one class
    run[1:n] |= kind[1:] != kind[:-1]
    blank = kind == 3
    begin = run[:n].copy()
    # the last blank before ink leads the next piece (a plain space) or stands alone
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~edge[1:n]) if n > 1 else np.zeros(0, np.int64)
    begin[last] = True
    glued = last[cp[last] == 0x20] + 1
    begin[glued] = False
    # contractions: an apostrophe that begins a piece, alone before a letter
    quote = np.flatnonzero((cp == 0x27) & begin)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == 1) & ~edge[quote + 1]]
    if len(quote):
        one = cp[quote + 1]
        more = (quote + 2 < n) & ~edge[np.minimum(quote + 2, n)]
        two = np.where(more, cp[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long_ = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, width in ((short, 2), (long_ & ~short, 3)):
            q = quote[hit]
            begin[q + 1] = False
            nxt = q + width
            begin[nxt[nxt < n]] = True
    is_special = np.zeros(n, dtype=bool)
    if len(special):
        s = np.searchsorted(at, special)
        for k in s.tolist():
            begin[k + 1 : k + len(SPECIAL)] = False
        is_special[s] = True
    b = np.flatnonzero(begin)
    start = at[b]
    end = np.append(start[1:], len(buf))
    return start, end, np.searchsorted(start, offs), is_special[b]


def expand(flat: np.ndarray, offs: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate rows ``which`` of a ragged array (flat, offs); also returns the lengths."""
    size = (offs[1:] - offs[:-1])[which]
    total = int(size.sum())
    if total == 0:
        return flat[:0], size
    ends = np.cumsum(size)
    index = np.arange(total, dtype=np.int64) + np.repeat(offs[:-1][which] - (ends - size), size)
    return flat[index], size


def ragged(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unsigned 32-bit numbers as (flat numbers, number of each row)."""
    size = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)) >> 2
    return np.frombuffer(b"".join(rows), dtype="<u4"), size


class PieceCache:
    """Ids of distinct pre-tokens, kept per worker up to ``limit`` entries, then begun anew.

    ``encode(list of bytes) -> (flat ids, number of ids of each)`` is called
    once for every pre-token that the table does not hold. Entries are found
    by hash (open addressing, whole arrays at a time) and confirmed by their
    bytes. The limit bounds memory only.
    """

    LONG = 200  # bytes of a pre-token beyond which it is not kept

    def __init__(self, encode, limit: int = 200_000):
        self.encode, self.limit = encode, limit
        self.mask = (1 << (5 * limit // 2).bit_length()) - 1
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(self.mask + 1, dtype=np.uint64)  # 0: free
        self.entry = np.zeros(self.mask + 1, dtype=np.int32)
        self.n = 0
        self.text, self.text_at = np.zeros(1 << 16, np.uint8), np.zeros(1 << 12, np.int64)
        self.ids, self.ids_at = np.zeros(1 << 14, "<u4"), np.zeros(1 << 12, np.int64)

    @staticmethod
    def _put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
        if at + len(values) > len(array):
            array = np.concatenate([array[:at], np.zeros(max(len(array), len(values)) + len(values), array.dtype)])
        array[at : at + len(values)] = values
        return array

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry with that hash, or -1."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        todo, slot = np.arange(len(hashes)), (hashes & np.uint64(self.mask)).astype(np.int64)
        while len(todo):
            found = self.keys[slot]
            hit = found == hashes[todo]
            out[todo[hit]] = self.entry[slot[hit]]
            more = ~hit & (found != 0)
            todo, slot = todo[more], (slot[more] + 1) & self.mask
        return out

    def _insert(self, hashes: np.ndarray, entry: np.ndarray) -> None:
        hashes, first = np.unique(hashes, return_index=True)
        todo, slot = np.arange(len(hashes)), (hashes & np.uint64(self.mask)).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == 0)
            taken, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.keys[taken] = hashes[todo[won]]
            self.entry[taken] = entry[first[todo[won]]]
            left = np.ones(len(todo), dtype=bool)
            left[won] = False
            todo, slot = todo[left], (slot[left] + 1) & self.mask

    def lookup(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the spans, which hold distinct texts: rows ``which`` of a ragged array (flat, offsets, which)."""
        if self.n + len(start) > self.limit or self.ids_at[self.n] > 16 * self.limit:
            self._clear()
        hashes = np.maximum(hashes, np.uint64(1))
        which = self._find(hashes)
        size = end - start
        held = np.flatnonzero(which >= 0)
        at = self.text_at[which[held]]
        same = self.text_at[which[held] + 1] - at == size[held]
        same[same] = equal_spans(buf, start[held[same]], size[held[same]], self.text, at[same])
        which[held[~same]] = -1
        new = np.flatnonzero(which < 0)
        if len(new):
            raw = buf.tobytes()
            flat, n_ids = self.encode([raw[a:b] for a, b in zip(start[new].tolist(), end[new].tolist())])
            kept = np.where(size[new] < self.LONG, size[new], 0)
            text, _ = expand(buf, np.column_stack([start[new], start[new] + kept]).ravel(), np.arange(0, 2 * len(new), 2))
            ends = self.text_at[self.n] + np.cumsum(kept)
            self.text = self._put(self.text, int(self.text_at[self.n]), text)
            self.text_at = self._put(self.text_at, self.n + 1, ends)
            ends = self.ids_at[self.n] + np.cumsum(n_ids)
            self.ids = self._put(self.ids, int(self.ids_at[self.n]), flat)
            self.ids_at = self._put(self.ids_at, self.n + 1, ends)
            which[new] = np.arange(self.n, self.n + len(new))
            self.n += len(new)
            store = new[size[new] < self.LONG]
            self._insert(hashes[store], which[store])
        return self.ids[: self.ids_at[self.n]], self.ids_at[: self.n + 1], which


def encode_documents(buf: np.ndarray, offs: np.ndarray, cache: PieceCache, special_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every document: (flat ids, ends of documents as n + 1 offsets)."""
    start, end, first, special = pretokens(buf, offs)
    if len(start) == 0:
        return np.zeros(0, "<u4"), np.zeros(len(offs), np.int64)
    hashes = span_hashes(buf, start, end)
    where, number = distinct_spans(buf, start, end, hashes)
    plain = ~special[where]
    ours = where[plain]
    flat, ragged, which = cache.lookup(buf, start[ours], end[ours], hashes[ours])
    if not plain.all():  # the special string is one text; its id becomes the last row
        flat, ragged = np.append(flat, np.uint32(special_id)), np.append(ragged, len(flat) + 1)
        row = np.full(len(where), len(ragged) - 2)
        row[plain] = which
        which = row
    ids, size = expand(flat, ragged, which[number])
    at = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(size, out=at[1:])
    return ids, at[first]
