"""BPE encoding and decoding by per-prefix dynamic programming.

For byte-pair encoding the encoding of a prefix is unique, and so is its last
token. Reading a pre-token byte by byte, a suffix automaton over the
vocabulary (trie edges and failure links, longest token per state, next
shorter suffix token per token) lists the tokens that end at each
position. The one whose predecessor (the last token of the prefix before it)
is *compatible* is stored; following these back-pointers from the end emits
the exact ids. Two tokens are compatible when undoing their merges, latest
first, never uncovers a merge across their border that would have come
earlier. The cost is linear in the bytes times the few suffix tokens, so a
long text without blanks stays cheap.

Results by case: null text counts as empty; empty text gives no ids and an
empty decoded string; the special string inside a text gives its id; repeated
rows each get their own result row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm import textops as tx

_NONE = np.int32(1 << 30)
_LONG = 256  # bytes of a pre-token beyond which it is encoded by itself


def byte_chars() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Merge rank of a pair of token ids by open addressing; works on whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, (4 * len(left)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        self.vals = np.full(size, _NONE, dtype=np.int32)
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        for k, h, v in zip(key.tolist(), self._slot(key).tolist(), rank.tolist()):
            while self.keys[h] != 0xFFFFFFFFFFFFFFFF:
                h = (h + 1) & (size - 1)
            self.keys[h], self.vals[h] = k, v

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.vals[slot], _NONE)
        todo = np.flatnonzero((found != key) & (found != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.vals[slot[todo[hit]]]
            todo = todo[~hit & (found != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out


class Bpe:
    """A byte-level BPE vocabulary with its suffix automaton and pair test."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_chars()
        vocab = spec["model"]["vocab"]
        n = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes: list[bytes] = [b""] * n
        for word, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in word)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for word, i in self.special.items():
            self.bytes[i] = word.encode()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = np.full(n, -1, dtype=np.int32)
        self.left = np.arange(n, dtype=np.int32)
        self.right = np.arange(n, dtype=np.int32)
        pl, pr = np.zeros(len(merges), np.int64), np.zeros(len(merges), np.int64)
        for r, (a, b) in enumerate(merges):
            i, x, y = vocab[a + b], vocab[a], vocab[b]
            pl[r], pr[r] = x, y
            if self.rank[i] < 0:
                self.rank[i], self.left[i], self.right[i] = r, x, y
        self.pairs = PairTable(pl, pr, np.arange(len(merges)))
        self.size = np.array([len(b) for b in self.bytes], dtype=np.int32)
        self._automaton(sorted((b, i) for i, b in enumerate(self.bytes) if b and i not in self.special.values()))
        flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        offs = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(self.size, out=offs[1:])
        self.flat, self.flat_offs = flat, offs

    def _automaton(self, words: list[tuple[bytes, int]]) -> None:
        children: list[dict[int, int]] = [{}]
        token = [-1]
        for word, i in words:
            s = 0
            for byte in word:
                t = children[s].get(byte)
                if t is None:
                    t = children[s][byte] = len(children)
                    children.append({})
                    token.append(-1)
                s = t
            token[s] = i
        fail = np.zeros(len(children), dtype=np.int32)
        longest = np.full(len(children), -1, dtype=np.int32)
        shorter = np.full(len(self.bytes), -1, dtype=np.int32)
        queue = [0]
        for s in queue:
            if s:
                up = longest[fail[s]]
                longest[s] = token[s] if token[s] >= 0 else up
                if token[s] >= 0:
                    shorter[token[s]] = up
            for byte, t in children[s].items():
                at = fail[s]
                while s and at and byte not in children[at]:
                    at = fail[at]
                fail[t] = children[at].get(byte, 0) if s else 0
                queue.append(t)
        edges = np.array([(s, byte, t) for s, row in enumerate(children) for byte, t in row.items()], dtype=np.int64)
        self.edges = PairTable(edges[:, 0], edges[:, 1], edges[:, 2])
        self.fail, self.longest, self.shorter = fail, longest, shorter

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Automaton states after one more byte each; only the edges of the trie are stored."""
        out = self.edges.get(state, byte)
        todo = np.flatnonzero(out == _NONE)
        at = state[todo]
        while len(todo):
            # from the root, a byte that begins no token stays there
            out[todo[at == 0]] = 0
            todo, at = todo[at != 0], self.fail[at[at != 0]]
            found = self.edges.get(at, byte[todo])
            out[todo] = found
            todo, at = todo[found == _NONE], at[found == _NONE]
        return out

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether tokens x[i], y[i] can stand side by side in an encoding."""
        out = np.ones(len(x), dtype=bool)
        at = np.arange(len(x))
        bound = np.full(len(x), _NONE, dtype=np.int32)
        while len(at):
            across = self.pairs.get(x, y)
            rx, ry = self.rank[x], self.rank[y]
            bad = across < bound
            out[at[bad]] = False
            more = ~bad & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry = at[more], x[more], y[more], rx[more], ry[more]
            undo_left = rx > ry
            # a border merge of equal rank comes before the right token's, after the left one's
            bound = np.where(undo_left, rx, ry + 1)
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        many = [i for i, p in enumerate(pieces) if len(p) <= _LONG]
        for i, p in enumerate(pieces):
            if len(p) > _LONG:
                out[i] = self._encode_one(p)
        many.sort(key=lambda i: -len(pieces[i]))
        for lo in range(0, len(many), 50_000):
            part = many[lo : lo + 50_000]
            for i, ids in zip(part, self._encode_many([pieces[i] for i in part])):
                out[i] = ids
        return out

    def _encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """All pieces in lock step, one byte of each at a time; longest pieces first."""
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        base = np.concatenate([[0], np.cumsum(size)])[:-1]
        last = np.zeros(len(raw), dtype=np.int32)
        count = np.zeros(len(raw), dtype=np.int32)
        state = np.zeros(len(pieces), dtype=np.int32)
        for i in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -i, side="left"))  # pieces longer than i
            state = self.step(state[:n], raw[base[:n] + i])
            token = self.longest[state]
            todo = np.arange(n)
            while len(todo):
                before = i - self.size[token]  # offset of the previous token's last byte, -1 at the start
                ok = before < 0
                inner = np.flatnonzero(~ok)
                if len(inner):
                    ok[inner] = self.compatible(last[base[todo[inner]] + before[inner]], token[inner])
                at = base[todo[ok]]
                last[at + i] = token[ok]
                prev = before[ok]
                count[at + i] = 1 + np.where(prev >= 0, count[at + np.maximum(prev, 0)], 0)
                todo, token = todo[~ok], self.shorter[token[~ok]]
        total = count[base + size - 1].astype(np.int64)
        ends = np.cumsum(total)
        ids = np.zeros(int(ends[-1]) if len(ends) else 0, dtype="<u4")
        where, write = base + size - 1, ends - 1
        floor = base
        while len(where):
            token = last[where]
            ids[write] = token
            where = where - self.size[token]
            more = where >= floor
            where, write, floor = where[more], write[more] - 1, floor[more]
        data = ids.tobytes()
        return [data[4 * (e - t) : 4 * e] for e, t in zip(ends.tolist(), total.tolist())]

    def _encode_one(self, piece: bytes) -> bytes:
        """The same programme for one long piece; pair tests are remembered."""
        longest, shorter, size = self.longest, self.shorter, self.size
        after: dict[tuple[int, int], int] = {}
        seen: dict[tuple[int, int], bool] = {}
        last = [0] * len(piece)
        state = 0
        for i, byte in enumerate(piece):
            move = state, byte
            state = after.get(move)
            if state is None:
                state = after[move] = int(self.step(np.array([move[0]], np.int32), np.array([byte], np.uint8))[0])
            token = int(longest[state])
            while True:
                before = i - int(size[token])
                if before < 0:
                    break
                pair = (last[before], token)
                ok = seen.get(pair)
                if ok is None:
                    ok = seen[pair] = bool(self.compatible(np.array([pair[0]]), np.array([token]))[0])
                if ok:
                    break
                token = int(shorter[token])
            last[i] = token
        ids, i = [], len(piece) - 1
        while i >= 0:
            ids.append(last[i])
            i -= int(size[last[i]])
        return np.array(ids[::-1], dtype="<u4").tobytes()

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[str]:
        """Text of each run ids[offs[i]:offs[i + 1]]; invalid UTF-8 becomes the replacement character."""
        raw, size = tx.expand(self.flat, self.flat_offs, ids)
        ends = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(size, out=ends[1:])
        data, cut = raw.tobytes(), ends[offs].tolist()
        return [data[a:b].decode("utf-8", errors="replace") for a, b in zip(cut, cut[1:])]


_LOADED: dict[str, tuple[Bpe, tx.PieceCache]] = {}


def load(path: str) -> tuple[Bpe, tx.PieceCache]:
    """The vocabulary and its cache of encoded pre-tokens, one of each per worker."""
    if path not in _LOADED:
        bpe = Bpe(path)
        _LOADED[path] = bpe, tx.PieceCache(lambda pieces: tx.ragged(bpe.encode_pieces(pieces)))
    return _LOADED[path]


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None, decoded_col: str | None = None) -> DataFrame:
    """Columns ``keep`` (default: all but the text and any named like a result), the ids of the whole text and, if named, the text decoded from them.

    One narrow pass: no shuffle, a bounded cache of pre-tokens per worker.
    """
    made = {ids_col, decoded_col}
    keep = [c for c in df.columns if c != text_col and c not in made] if keep is None else keep
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in keep]).add(ids_col, T.ArrayType(T.IntegerType()))
    if decoded_col:
        schema = schema.add(decoded_col, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = load(path)
        special = bpe.special.get(tx.SPECIAL.decode(), 0)
        for batch in batches:
            buf, offs = tx.buffers(batch.column(batch.num_columns - 1))
            for i, j, part, cuts in tx.slices(buf, offs):
                ids, ends = tx.encode_documents(part, cuts, cache, special)
                cols = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns - 1)]
                cols.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))))
                if decoded_col:
                    cols.append(pa.array(bpe.decode(ids, ends), type=pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, ids_col, *([decoded_col] if decoded_col else [])])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_bpe_text")).mapInArrow(tx.tidy(run), schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Replace a column of ids by the text they stand for (null ids: null text)."""
    keep = [c for c in df.columns if c != ids_col]
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in keep]).add(text_col, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = load(path)
        for batch in batches:
            runs = batch.column(batch.num_columns - 1)
            size = np.array([len(r) if r.is_valid else 0 for r in runs], dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(size)])
            ids = runs.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [t if r.is_valid else None for t, r in zip(bpe.decode(ids, ends), runs)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(texts, type=pa.string())], names=[*keep, text_col])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids_col}`").cast("array<int>").alias("_bpe_ids")).mapInArrow(run, schema)
