"""Language-model scores from a probabilistic suffix tree over words.

Counting: a chunk of documents sends its distinct words and runs (a context and
the token after it) to the buckets of their hashes. A first round counts the
words and tells which runs can occur ``min_count`` times, by the top bits of the
hashes (the longest by the two runs they hold); a second one counts those
exactly, over all training rows, and tells every chunk the totals of its runs
in the order in which it named them. The least count is fixed, so a phrase that is
learned stays learned however much text is added.
Growing: one chunk describes each run (context, suffix, counts) in a table that
grows with the input and is never held by the driver. A context is kept when the
divergence of its next-symbol distribution from that of its longest kept suffix,
times its count, reaches ``min_gain`` nats. Smoothing: a state gives its stored
symbols their counts and hands the rest, with a weight per stored symbol, to its
longest kept suffix; the root is the unigram base. Scoring: the buckets tell every
chunk which of its contexts were kept, with two small numbers each, and the chunk
walks its tokens once, each under the longest suffix state that was kept.

What chunks and buckets tell each other is landed, and a table is dropped once
what was made of it is landed, so the disk holds one step at a time.

Every distribution sums to one over the known words, the end and one unknown
word. Results by case: null and empty texts are the end token alone; rows that
repeat or share an id are counted and scored one by one; a null id counts as the
id ''; without training rows every token has the base's probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm import postings as ps
from tandem.llm import textops as tx
from tandem.llm.tables import Scratch

MIN_COUNT, MAX_DEPTH, MIN_GAIN = 2, 3, 10.0
CHUNK_BYTES = 8 << 20
BUCKET_CHUNKS = 8  # chunks of text whose runs a bucket holds at most, on average
SIEVE_BITS = 36
END = np.uint64(0x5DEECE66D1234567)
_STEP = np.uint64(0x9E3779B97F4A7C15)
TOKENS, SIEVED, ABLE, TOTALS, STATES, SUMS = range(6)  # kinds of rows
_ROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])
_DDL = "kind int, bucket int, chunk long, blob binary"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of every document followed by the end token: (flat, offsets)."""
    h, first = tx.word_hashes(buf, offs)
    h[h == END] += np.uint64(1)
    return np.insert(h, first[1:], END), first + np.arange(len(first))


def grams(flat: np.ndarray, ends: np.ndarray, longest: int) -> list[np.ndarray]:
    """g[d][i]: hash of the d + 1 tokens that end at i, 0 where the document is too short."""
    out = [flat]
    room = np.arange(len(flat)) - np.repeat(ends[:-1], np.diff(ends))  # tokens before i in its document
    for d in range(1, longest):
        g = np.zeros_like(flat)
        g[1:] = tx.mix(out[-1][:-1] * _STEP + flat[1:])
        g[room < d] = 0
        out.append(g)
    return out


def _parts(keys: np.ndarray, n: int) -> list[slice]:
    """Sorted hashes by bucket: the top bits choose it."""
    bounds = np.array([-(-(b << 64) // n) for b in range(1, n)], dtype=np.uint64)
    cut = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
    return [slice(a, b) for a, b in zip(cut, cut[1:])]


def _row(kind: int, bucket: int, chunk: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([chunk], pa.int64()), pa.array([blob], pa.binary())], schema=_ROW)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for batch in batches:
        for kind, bucket, chunk, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
            yield kind, bucket, chunk, blob.as_py()


def _planes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers by byte position, and their bytes."""
    a = ps.small(a)
    return np.array([a.itemsize], dtype=np.uint8), a.view(np.uint8).reshape(len(a), a.itemsize).T.ravel()


def _unplanes(width: np.ndarray, planes: np.ndarray) -> np.ndarray:
    w = int(width[0])
    return np.ascontiguousarray(planes.reshape(w, len(planes) // w).T).view(f"<u{w}").ravel()


def _pressed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending numbers as the first, and their steps by byte position (which packs well)."""
    return keys[:1], *_planes(np.diff(keys))


def _unpressed(first: np.ndarray, width: np.ndarray, planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([first, _unplanes(width, planes).astype(np.uint64)]), dtype=np.uint64)


class Chunk:
    """The tokens of some documents, their distinct runs by length, and what the buckets told about those.

    ``keys[d]`` are the distinct runs of d + 1 tokens, ascending, ``at[d]`` the end of an
    occurrence of each, ``index[d]`` the run that ends at every token (-1: none that counts),
    ``n[d]`` their totals.
    """

    def __init__(self, blob: bytes, depth: int, n_buckets: int):
        self.ids, self.known, self.train, sizes, width, stream, often, *classes = ps.unpack(blob)
        words = np.concatenate([_unpressed(*classes[3 * k : 3 * k + 3]) for k in range(int(often[0]))])
        order = np.argsort(words)
        words, place = words[order], np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.depth, self.n_buckets, self.sieved = depth, n_buckets, max(depth - 1, 1)
        self.ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
        self.inside = np.repeat(self.train != 0, sizes)
        self.keys, self.index, self.at = [words], [place[_unplanes(width, stream)]], [None]
        self.g = grams(words[self.index[0]], self.ends, depth + 1)
        self.n: list[np.ndarray] = []
        self.mine: list[np.ndarray] = []
        self.states: list[list[np.ndarray]] = []

    def level(self, d: int, there: np.ndarray) -> None:
        """The runs of d + 1 tokens that end at the marked tokens."""
        where = np.flatnonzero(there)
        k = self.g[d][where]
        order = np.argsort(k)
        k = k[order]
        new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        where = where[order]
        index = np.full(len(there), -1, dtype=np.int32)
        index[where] = np.repeat(np.arange(len(new), dtype=np.int32), np.diff(np.append(new, len(k))))
        self.keys.append(k[new])
        self.index.append(index)
        self.at.append(where[new])

    def trained(self, d: int) -> np.ndarray:
        """Occurrences in training rows of each run of d + 1 tokens."""
        return np.bincount(self.index[d][self.inside & (self.index[d] >= 0)], minlength=len(self.keys[d]))

    def spread(self, d: int, values: np.ndarray) -> np.ndarray:
        """Values of runs at every token that ends one, 0 elsewhere."""
        return np.append(values, 0)[self.index[d]]

    def _told(self, rows: list[tuple[int, np.ndarray]], keys: list[np.ndarray]) -> list[np.ndarray]:
        """Values in the buckets' order, back in that of the keys."""
        out = [np.zeros(len(k), dtype=np.int64) for k in keys]
        parts = [_parts(k, self.n_buckets) for k in keys]
        for b, values in rows:
            lo = 0
            for o, p in zip(out, parts):
                size = p[b].stop - p[b].start
                o[p[b]] = values[lo : lo + size]
                lo += size
        return out

    def take_sieved(self, rows: list[tuple[int, list[np.ndarray]]]) -> None:
        """The totals of the words, and which of the shorter runs passed the sieve."""
        for d in range(1, self.sieved + 1):
            self.level(d, self.g[d] != 0)
        self.n = self._told([(b, _unplanes(*r[:2])) for b, r in rows], self.keys[:1])
        able = self._told([(b, np.unpackbits(r[2])) for b, r in rows], self.keys[1:])
        for d, ok in enumerate(able, 1):
            ok = ok > 0
            place = np.where(ok, np.cumsum(ok) - 1, -1).astype(np.int32)
            self.keys[d], self.at[d] = self.keys[d][ok], self.at[d][ok]
            self.index[d] = np.append(place, np.int32(-1))[self.index[d]]
        self._longest()

    def able(self) -> bytes:
        """What ``take_sieved`` learned, with a bit per token and length, so that later passes sort what passed only."""
        return ps.pack(*_planes(self.n[0]), *(np.packbits(self.index[d] >= 0) for d in range(1, self.sieved + 1)))

    def take_able(self, width: np.ndarray, planes: np.ndarray, *bits: np.ndarray) -> None:
        self.n = [_unplanes(width, planes).astype(np.int64)]
        for d, b in enumerate(bits, 1):
            self.level(d, np.unpackbits(b, count=len(self.g[0])))
        self._longest()

    def _longest(self) -> None:
        if self.depth > 1:  # what holds two runs that are too rare is too rare
            here = self.index[-1] >= 0
            before = np.append(False, here[:-1])
            self.level(self.depth, (self.g[self.depth] != 0) & here & before)

    def take_totals(self, rows: list[tuple[int, list[np.ndarray]]]) -> None:
        self.n += self._told([(b, _unplanes(*r[:2])) for b, r in rows], self.keys[1:])
        self.mine = [None, *(x > 0 for x in self._told([(b, np.unpackbits(r[2])) for b, r in rows], self.keys[1:]))]

    def take_states(self, rows: list[tuple[int, list[np.ndarray]]], min_count: int) -> None:
        """Per length of a context, its stored symbols and the occurrences that none of them follows."""
        asked = [n >= min_count for n in self.n[: self.depth]]
        keys = [k[some] for k, some in zip(self.keys, asked)]
        told = [self._told([(b, _unplanes(*r[j : j + 2])) for b, r in rows], keys) for j in (0, 2)]
        for some, symbols, rest in zip(asked, *told):
            state = [np.zeros(len(some), dtype=np.int64) for _ in (0, 1)]
            state[0][some], state[1][some] = symbols, rest
            self.states.append(state)

    def gains(self, base: np.ndarray, min_count: int) -> np.ndarray:
        """Per token, the tree's log10 probability less the base's."""
        own, hand = np.zeros(len(base)), np.ones(len(base))
        for d, (symbols, rest) in enumerate(self.states):
            context = np.append(np.int32(-1), self.index[d][:-1])
            context[self.ends[:-1]] = -1
            i = np.flatnonzero(np.append(symbols, 0)[context])
            symbols, rest, whole = (x[context[i]] for x in (symbols, rest, self.n[d]))
            m = whole + symbols
            w = (rest + symbols) / m
            n = self.spread(d + 1, np.where(self.n[d + 1] >= min_count, self.n[d + 1], 0))[i]
            own[i] = own[i] * w + n / m
            hand[i] *= w
        return np.log10(own / base + hand)


def _texts(chunk_bytes: int):
    """Chunks of documents, one row each: which word stands where, by its place among the chunk's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seq, held, size = 0, [], 0

        def flush() -> pa.RecordBatch:
            ids, known, train, sizes, flat = (np.concatenate([h[k] for h in held]) for k in range(5))
            words, stream, n = np.unique(flat, return_inverse=True, return_counts=True)
            # by the power of two of their count, then by hash: the places of common words are small numbers
            often = -np.log2(n).astype(np.int8)
            order = np.argsort(often, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            classes = np.split(words[order], np.flatnonzero(np.diff(often[order])) + 1)
            packed = (x for c in classes for x in _pressed(c))
            return _row(TOKENS, -1, part << 32 | seq, ps.pack(ids, known, train, ps.small(sizes), *_planes(place[stream]), np.array([len(classes)], dtype=np.uint8), *packed))

        for batch in batches:
            buf, offs = tx.buffers(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j, data, cuts in tx.slices(buf, offs):
                mine = ids[i:j]
                flat, ends = tokens(np.ascontiguousarray(data), np.asarray(cuts, dtype=np.int64))
                held.append(
                    (
                        np.array([0 if d is None else d for d in mine], dtype=np.int64),
                        np.array([d is not None for d in mine], dtype=np.uint8),
                        np.array([not held_out(d) for d in mine], dtype=np.uint8),
                        np.diff(ends),
                        flat,
                    )
                )
                # an empty text is an end token all the same
                size += len(data) + 16 * len(mine)
                if size >= chunk_bytes:
                    yield flush()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield flush()

    return run


def _spread(n_buckets: int, depth: int):
    """Per chunk and bucket: its words and the top bits of its sieved runs, with their counts in training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, name, blob in _rows(batches):
            c = Chunk(blob, depth, n_buckets)
            for d in range(1, c.sieved + 1):
                c.level(d, c.g[d] != 0)
            parts = [_parts(k, n_buckets) for k in c.keys]
            trained = [c.trained(d) for d in range(len(c.keys))]
            for b in range(n_buckets):
                out = []
                for keys, n, part in zip(c.keys, trained, parts):
                    s = part[b]
                    out += [*_pressed(keys[s] if keys is c.keys[0] else keys[s] >> np.uint64(64 - SIEVE_BITS)), *_planes(n[s])]
                if any(p[b].start < p[b].stop for p in parts):
                    yield _row(0, b, name, ps.pack(*out))

    return run


def _totals(keys: list[np.ndarray], weights: list[np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """Of several arrays of keys, one behind the other: distinct keys with a weight, the total of every entry's key, one entry of each key."""
    k, w = np.concatenate(keys), np.concatenate(weights).astype(np.int64)
    order = np.argsort(k)
    k = k[order]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    n = np.add.reduceat(w[order], new) if len(k) else w
    each, one = np.empty(len(k), dtype=np.int64), np.zeros(len(k), dtype=bool)
    each[order] = np.repeat(n, np.diff(np.append(new, len(k))))
    one[order[new]] = True
    return int(np.count_nonzero(n)), each, one


def _cut(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    return np.split(flat, np.cumsum([len(x) for x in like])[:-1])


def _sieve(min_count: int, levels: int):
    """A bucket's rows: every chunk's words with their exact totals, and a bit for each of its longer runs that can reach ``min_count``.

    Runs are told apart by their top bits here, so some pass that do not reach
    it; none is missed. Adds a row of the number of words and tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, words, counts, runs, trained = [], [], [], [], []
        for _, bucket, chunk, blob in _rows(batches):
            w = ps.unpack(blob)
            names.append((bucket, chunk))
            words.append(_unpressed(*w[:3]))
            counts.append(_unplanes(*w[3:5]))
            runs.append(np.concatenate([_unpressed(*w[5 * d : 5 * d + 3]) for d in range(1, levels + 1)]))
            trained.append(np.concatenate([_unplanes(*w[5 * d + 3 : 5 * d + 5]) for d in range(1, levels + 1)]).astype(np.uint32))
        if not names:
            return
        distinct, of_word, _ = _totals(words, counts)
        total = int(sum(int(c.sum()) for c in counts))
        _, of_run, _ = _totals(runs, trained)
        for (bucket, chunk), n, m in zip(names, _cut(of_word, words), _cut(of_run >= min_count, runs)):
            yield _row(SIEVED, bucket, chunk, ps.pack(*_planes(n), np.packbits(m)))
        yield _row(SUMS, 0, -1, ps.pack(np.array([distinct, total], dtype=np.int64)))

    return run


def _chunks(batches: Iterator[pa.RecordBatch], depth: int, n_buckets: int, min_count: int) -> Iterator[tuple[int, Chunk]]:
    """Chunks with all that the buckets told them so far; rows are sorted by chunk, kind and bucket."""
    now, blob, told = None, b"", {}

    def whole() -> Chunk:
        c = Chunk(blob, depth, n_buckets)
        if ABLE not in told:
            c.take_sieved(told.get(SIEVED, []))
            return c
        c.take_able(*told[ABLE][0][1])
        c.take_totals(told.get(TOTALS, []))
        if STATES in told:
            c.take_states(told[STATES], min_count)
        return c

    for kind, bucket, chunk, data in _rows(batches):
        if chunk != now:
            if now is not None:
                yield now, whole()
            now, told = chunk, {}
        if kind == TOKENS:
            blob = data
        else:
            told.setdefault(kind, []).append((bucket, ps.unpack(data)))
    if now is not None:
        yield now, whole()


def _candidates(n_buckets: int, depth: int, min_count: int):
    """Per chunk what the sieve told it, and by bucket the longer runs that passed, with their counts in training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, c in _chunks(batches, depth, n_buckets, min_count):
            parts = [_parts(k, n_buckets) for k in c.keys[1:]]
            trained = [c.trained(d) for d in range(1, depth + 1)]
            yield _row(ABLE, -1, name, c.able())
            for b in range(n_buckets):
                if any(p[b].start < p[b].stop for p in parts):
                    out = [x for k, n, p in zip(c.keys[1:], trained, parts) for x in (*_pressed(k[p[b]]), *_planes(n[p[b]]))]
                    yield _row(0, b, name, ps.pack(*out))

    return run


def _exact(depth: int):
    """A bucket's rows: for every chunk the totals of its runs, and a bit for those that it is to describe, of all chunks; rows of no bucket pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, keys, trained = [], [], []
        for kind, bucket, chunk, blob in _rows(batches):
            if bucket < 0:
                yield _row(kind, bucket, chunk, blob)
                continue
            w = ps.unpack(blob)
            names.append((bucket, chunk))
            keys.append(np.concatenate([_unpressed(*w[5 * d : 5 * d + 3]) for d in range(depth)]))
            trained.append(np.concatenate([_unplanes(*w[5 * d + 3 : 5 * d + 5]) for d in range(depth)]).astype(np.uint32))
        if not names:
            return
        _, n, one = _totals(keys, trained)
        for (bucket, chunk), x, mine in zip(names, _cut(n, keys), _cut(one, keys)):
            yield _row(TOTALS, bucket, chunk, ps.pack(*_planes(x), np.packbits(mine)))

    return run


_RUNS = "run long, context long, suffix long, n long, whole long, symbol long, depth int"


def _described(n_buckets: int, depth: int, min_count: int):
    """Every run of ``min_count`` once, by the chunk that is to describe it: its context and suffix, its count, that of the context and (for two tokens) of the last token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c in _chunks(batches, depth, n_buckets, min_count):
            for d in range(1, depth + 1):
                mine = c.mine[d] & (c.n[d] >= min_count)
                at, none = c.at[d][mine], np.zeros(int(mine.sum()), dtype=np.int64)
                cols = [
                    c.keys[d][mine].view(np.int64) if d < depth else none,
                    c.g[d - 1][at - 1].view(np.int64),
                    c.g[d - 1][at].view(np.int64) if d > 1 else none,
                    c.n[d][mine],
                    c.spread(d - 1, c.n[d - 1])[at - 1],
                    c.n[0][c.index[0][at]] if d == 1 else none,
                    np.full(len(at), d, dtype=np.int32),
                ]
                names = ["run", "context", "suffix", "n", "whole", "symbol", "depth"]
                for lo in range(0, len(at), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in cols], names=names)

    return run


def _total_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, _, blob in _rows(batches):
        v, n = ps.unpack(blob)[0].tolist()
        yield pa.RecordBatch.from_arrays([pa.array([v]), pa.array([n])], names=["distinct", "total"])


def _model_rows(n_buckets: int):
    """(run, symbols, rest) to one row per bucket and batch, told from a chunk by -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, *values = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            key = key.view(np.uint64)
            order = np.argsort(key)
            key, values = key[order], [x[order] for x in values]
            for b, s in enumerate(_parts(key, n_buckets)):
                if s.start < s.stop:
                    yield _row(0, b, -1, ps.pack(*_pressed(key[s]), *(ps.small(x[s]) for x in values)))

    return run


def _asked(n_buckets: int, depth: int, min_count: int):
    """Per chunk and bucket, the runs of ``min_count`` that can be contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, c in _chunks(batches, depth, n_buckets, min_count):
            keys = [k[n >= min_count] for k, n in zip(c.keys[:depth], c.n)]
            parts = [_parts(k, n_buckets) for k in keys]
            for b in range(n_buckets):
                if any(p[b].start < p[b].stop for p in parts):
                    yield _row(0, b, name, ps.pack(*(x for k, p in zip(keys, parts) for x in _pressed(k[p[b]]))))

    return run


def _answers(depth: int):
    """A bucket's rows, the model's first: for every chunk the stored symbols and the rest of its contexts, 0 where one is not kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, model = [], None
        for _, bucket, chunk, blob in _rows(batches):
            if chunk < 0:
                w = ps.unpack(blob)
                held.append([_unpressed(*w[:3]), *(x.astype(np.int64) for x in w[3:])])
                continue
            if not held:
                continue
            if model is None:
                model = [np.concatenate(c) for c in zip(*held)]
                order = np.argsort(model[0])
                model = [c[order] for c in model]
            w = ps.unpack(blob)
            ask = np.concatenate([_unpressed(*w[3 * d : 3 * d + 3]) for d in range(depth)])
            at = np.minimum(np.searchsorted(model[0], ask), len(model[0]) - 1)
            hit = model[0][at] == ask
            yield _row(STATES, bucket, chunk, ps.pack(*(y for x in model[1:] for y in _planes(np.where(hit, x[at], 0)))))

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scores(n_buckets: int, depth: int, min_count: int, z: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c in _chunks(batches, depth, n_buckets, min_count):
            n = np.diff(c.ends)
            count = c.n[0][c.index[0]]
            # every document has an end token; summed per document, so equal texts score equally
            logs = np.add.reduceat(np.log10(count + 0.5), c.ends[:-1])
            seen = np.add.reduceat((count > 0).astype(np.int64), c.ends[:-1])
            base = logs - n * np.log10(z)
            score = base + np.add.reduceat(c.gains((count + 0.5) / z, min_count), c.ends[:-1])
            cols = [pa.array(c.ids, pa.int64(), mask=c.known == 0), pa.array(c.train == 0), pa.array(n, pa.int64()), pa.array(seen, pa.int64()), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def grow(scratch: Scratch, total: int, distinct: int, max_depth: int, min_gain: float) -> DataFrame:
    """The kept contexts as a table: run, stored symbols, and occurrences that no stored symbol follows.

    The runs of one length meet the probabilities of those one shorter by their
    suffix, and are summed by their context; nothing passes through the driver.
    Both joins hash the side that has each key once, so its share of a partition
    is even whatever run is hot.
    """
    z = float(total + 0.5 * (distinct + 1))
    parts = None
    for d in range(1, max_depth + 1):
        here = scratch.read("lm_runs").filter(F.col("depth") == d)
        if d == 1:
            here = here.withColumn("q_below", (F.col("symbol") + 0.5) / z).select("run", "context", "n", "whole", "q_below")
        else:
            here = here.select("run", "context", "suffix", "n", "whole").join(scratch.read(f"lm_level_{d - 1}").hint("shuffle_hash"), "suffix")
            here = scratch.land(here.select("run", "context", "n", "whole", "q_below"), f"lm_here_{d}", hashes=("run", "context", "q_below"))
            scratch.drop(f"lm_level_{d - 1}")
            scratch.drop("lm_runs", f"depth={d}")
        sums = here.groupBy("context").agg(
            F.sum("n").alias("stored"),
            F.count("*").alias("symbols"),
            F.sum("q_below").alias("seen"),
            F.sum(F.col("n") * F.log(F.col("n") / F.col("q_below"))).alias("gain"),
            F.max("whole").alias("whole"),
        )
        sums = sums.withColumn("rest", F.greatest(F.col("whole") - F.col("stored"), F.lit(0)))
        spare = F.greatest(1 - F.col("seen"), F.lit(1e-12))
        gain = F.col("gain") - F.col("stored") * F.log("whole")
        gain = gain + F.when(F.col("rest") > 0, F.col("rest") * F.log(F.col("rest") / F.col("whole") / spare)).otherwise(0.0)
        states = scratch.land(sums.filter(gain >= min_gain).select("context", "symbols", "rest"), f"lm_states_{d}")
        if d < max_depth:
            m = F.col("whole") + F.col("symbols")
            q = F.coalesce(F.col("n") / m + (F.col("rest") + F.col("symbols")) / m * F.col("q_below"), "q_below")
            scratch.land(here.join(states.hint("shuffle_hash"), "context", "left").select(F.col("run").alias("suffix"), q.alias("q_below")), f"lm_level_{d}", hashes=("suffix", "q_below"))
        scratch.drop(*(("lm_runs", "depth=1") if d == 1 else (f"lm_here_{d}",)))
        named = states.select(F.col("context").alias("run"), "symbols", "rest")
        parts = named if parts is None else parts.unionByName(named)
    return parts


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT, max_depth: int = MAX_DEPTH, min_gain: float = MIN_GAIN, buckets: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10), learned from the rows not held out."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    depth = max_depth
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    with scratch:
        texts = scratch.land(d.mapInArrow(tx.tidy(_texts(chunk_bytes)), _DDL), "lm_tokens", compression="uncompressed")
        made = texts.agg(F.count("*").alias("n"), F.max(F.expr("chunk & 4294967295")).alias("last")).first()
        # a bucket's share is held by one task, so their number grows with the input
        n_buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-made.n // BUCKET_CHUNKS))
        # chunks are dealt evenly, by their number in the order of the tasks that made them
        place = F.expr(f"cast(pmod(shiftright(chunk, 32) * {(made.last or 0) + 1} + (chunk & 4294967295), {n_buckets}) as int)")

        def by_bucket(rows: DataFrame) -> DataFrame:
            return rows.repartitionById(n_buckets, F.when(F.col("bucket") < 0, place).otherwise(F.col("bucket")))

        def by_chunk(*told: DataFrame) -> DataFrame:
            rows = texts
            for t in told:
                rows = rows.unionByName(t)
            return rows.repartitionById(n_buckets, place).sortWithinPartitions("chunk", "kind", "bucket")

        spread = by_bucket(texts.mapInArrow(tx.tidy(_spread(n_buckets, depth)), _DDL))
        sieved = scratch.land(spread.mapInArrow(tx.tidy(_sieve(min_count, max(depth - 1, 1))), _DDL), "lm_sieved", compression="uncompressed")
        sums = sieved.filter(F.col("kind") == SUMS).mapInArrow(_total_rows, "distinct long, total long").agg(F.sum("distinct").alias("v"), F.sum("total").alias("n")).first()
        total, distinct = sums.n or 0, sums.v or 0
        runs = by_bucket(by_chunk(sieved.filter(F.col("kind") == SIEVED)).mapInArrow(tx.tidy(_candidates(n_buckets, depth, min_count)), _DDL))
        totals = scratch.land(runs.mapInArrow(tx.tidy(_exact(depth)), _DDL), "lm_totals", compression="uncompressed")
        scratch.drop("lm_sieved")
        told = by_chunk(totals)
        scratch.land(told.mapInArrow(tx.tidy(_described(n_buckets, depth, min_count)), _RUNS), "lm_runs", "depth", hashes=("run", "context", "suffix"))
        model = grow(scratch, total, distinct, depth, min_gain)
        asked = told.mapInArrow(tx.tidy(_asked(n_buckets, depth, min_count)), _DDL).unionByName(model.mapInArrow(_model_rows(n_buckets), _DDL))
        states = scratch.land(by_bucket(asked).sortWithinPartitions("chunk").mapInArrow(tx.tidy(_answers(depth)), _DDL), "lm_answers", compression="uncompressed")
    rows = by_chunk(totals, states).mapInArrow(tx.tidy(_scores(n_buckets, depth, min_count, float(total + 0.5 * (distinct + 1)))), _SCORES)
    return rows.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
