"""Token ids in wavelet-matrix shard files.

A shard holds the ids of consecutive documents as 16 or more succinct
bit-planes (most significant bit first, each plane a stable partition of the
one above). With a rank directory over the planes one compressed blob answers
``access`` (token at a position), ``rank`` / ``count`` and ``select`` /
``occurrences`` in one step per plane, and gives all ids back exactly.

``write_shards`` range-partitions documents by id, encodes them with the
tokenizers library, appends the end id and lands one row per shard file
content; Spark's commit protocol makes a retried task harmless. Results by
case: null text is empty (only the end id); null ids come last; rows that
share an id stand in the order of their text's hash and each keeps its own
row; no rows give no shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandem.llm import textops as tx
from tandem.llm.bpe import byte_chars

MAGIC = b"WMX1"
SHARD_TOKENS = 1 << 20


class Plane:
    """One bit-plane with rank and select."""

    def __init__(self, packed: np.ndarray, n: int):
        words = np.zeros(-(-n // 64) + 1, dtype="<u8")
        words.view(np.uint8)[: len(packed)] = packed
        self.words, self.n = words, n
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]
        self.zeros = n - int(self.rank1(n))

    def bit(self, i: int) -> int:
        return int(self.words[i >> 6] >> np.uint64(i & 63)) & 1

    def rank1(self, i: int) -> int:
        part = int(self.words[i >> 6]) & ((1 << (i & 63)) - 1)
        return int(self.before[i >> 6]) + part.bit_count()

    def rank(self, bit: int, i: int) -> int:
        ones = self.rank1(i)
        return ones if bit else i - ones

    def select(self, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            if self.rank(bit, mid + 1) <= k:
                lo = mid + 1
            else:
                hi = mid
        return lo


class WaveletMatrix:
    def __init__(self, planes: list[np.ndarray], n: int):
        self.packed, self.n = planes, n
        self._planes: list[Plane] | None = None

    @property
    def planes(self) -> list[Plane]:
        if self._planes is None:
            self._planes = [Plane(p, self.n) for p in self.packed]
        return self._planes

    @classmethod
    def of(cls, tokens: np.ndarray) -> WaveletMatrix:
        a = np.asarray(tokens, dtype=np.uint32)
        bits = max(1, int(a.max()).bit_length()) if len(a) else 1
        if bits <= 16:
            a = a.astype(np.uint16)
        planes = []
        for level in range(bits - 1, -1, -1):
            one = (a >> a.dtype.type(level)) & a.dtype.type(1) != 0
            planes.append(np.packbits(one, bitorder="little"))
            a = np.concatenate([a[~one], a[one]])
        return cls(planes, len(a))

    def tokens(self) -> np.ndarray:
        """All ids in order: the partitions undone from the lowest plane up."""
        a = np.zeros(self.n, dtype=np.uint32)
        for k, packed in enumerate(reversed(self.packed)):
            one = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            zeros = self.n - int(np.count_nonzero(one))
            b = np.empty_like(a)
            b[~one] = a[:zeros]
            b[one] = a[zeros:] | np.uint32(1 << k)
            a = b
        return a

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for p in self.planes:
            bit = p.bit(i)
            i = p.zeros + p.rank1(i) if bit else i - p.rank1(i)
            token = token << 1 | bit
        return token

    def _range(self, token: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        for k, p in enumerate(self.planes):
            bit = token >> (len(self.planes) - 1 - k) & 1
            lo, hi = (p.zeros + p.rank1(lo), p.zeros + p.rank1(hi)) if bit else (p.rank(0, lo), p.rank(0, hi))
        return lo, hi

    def rank(self, token: int, end: int) -> int:
        """Occurrences of the token before position ``end``."""
        if token < 0 or token >> len(self.packed):
            return 0
        lo, hi = self._range(token, min(end, self.n))
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the token's k-th occurrence (from 0)."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(token, self.n)[0] + k
        for level, p in enumerate(reversed(self.planes)):
            bit = token >> level & 1
            at = p.select(bit, at - p.zeros if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def pack_shard(doc_ids: list[int | None], sizes: list[int], tokens: np.ndarray) -> bytes:
    """The content of one shard file: documents, lengths, bit-planes."""
    wm = WaveletMatrix.of(tokens)
    pack = zstandard.ZstdCompressor(level=1).compress
    ids = np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes()
    null = np.packbits(np.array([d is None for d in doc_ids], dtype=bool)).tobytes()
    parts = [pack(ids), pack(null), pack(np.array(sizes, dtype="<u8").tobytes()), *(pack(p.tobytes()) for p in wm.packed)]
    head = struct.pack("<4sQQB", MAGIC, len(doc_ids), len(tokens), len(wm.packed))
    return head + struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


def unpack_shard(blob: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """(document ids, lengths, wavelet matrix) of a shard file's content."""
    magic, n_docs, n, bits = struct.unpack_from("<4sQQB", blob)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = struct.calcsize("<4sQQB")
    sizes = struct.unpack_from(f"<{bits + 3}Q", blob, at)
    at += 8 * (bits + 3)
    parts = []
    for size in sizes:
        parts.append(zstandard.ZstdDecompressor().decompress(blob[at : at + size]) if size else b"")
        at += size
    null = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=n_docs).tolist()
    ids = [None if z else d for d, z in zip(np.frombuffer(parts[0], "<i8").tolist(), null)]
    return ids, np.frombuffer(parts[2], "<u8").astype(np.int64), WaveletMatrix([np.frombuffer(p, np.uint8) for p in parts[3:]], n)


def library_encoder(path: str):
    """Pre-tokens to ids with the tokenizers library, many in one call.

    The pieces are given in the byte-level alphabet with the special string
    between them, so that its id parts the ids of one piece from the next.
    No pre-token holds the special string (``textops.pretokens``).
    """
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    between = tx.SPECIAL.decode()
    special = tokenizer.token_to_id(between)
    if special is None:
        tokenizer.add_special_tokens([between])
    mark = tokenizer.token_to_id(between)
    tokenizer.encode_special_tokens = False
    tokenizer.pre_tokenizer = pre_tokenizers.Split("\n", "removed")  # a piece has no line break and stays whole
    tokenizer.no_truncation()
    tokenizer.no_padding()
    letter = {b: ord(c) for c, b in byte_chars().items()} | {256: between}

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        line = "\u0100".join([p.decode("latin-1") for p in pieces]).translate(letter)
        ids = np.array(tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype="<u4")
        marks = np.flatnonzero(ids == mark)
        return np.delete(ids, marks), np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1

    return encode, 0 if special is None else special


_CACHES: dict[str, tuple[tx.PieceCache, int]] = {}


def library_cache(path: str) -> tuple[tx.PieceCache, int]:
    if path not in _CACHES:
        encode, special = library_encoder(path)
        _CACHES[path] = tx.PieceCache(encode, limit=600_000), special
    return _CACHES[path]


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode whole texts and write them, ascending by id, as shards of about ``shard_tokens`` ids.

    One shuffle (range partitioning by id); a task holds one shard at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, special = library_cache(tokenizer_path)
        part = TaskContext.get().partitionId()
        ids: list[int | None] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        n = seq = before = 0

        def shard() -> pa.RecordBatch:
            nonlocal n, seq, before
            tokens = np.concatenate(held)
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_docs": [len(ids)], "n_tokens": [n], "start_in_part": [before], "content": [pack_shard(ids, sizes, tokens)]}, schema=_SHARD)
            seq, before, n = seq + 1, before + n, 0
            ids.clear(), sizes.clear(), held.clear()
            return row

        for batch in batches:
            keys = batch.column(0).to_pylist()
            buf, offs = tx.buffers(batch.column(1))
            for i, _, data, cuts in tx.slices(buf, offs):
                flat, ends = tx.encode_documents(data, cuts, cache, special)
                # the end id after every document
                flat = np.insert(flat, ends[1:], np.uint32(end_id))
                ends = ends + np.arange(len(ends))
                for d in range(len(ends) - 1):
                    ids.append(keys[i + d])
                    sizes.append(int(ends[d + 1] - ends[d]))
                    held.append(flat[ends[d] : ends[d + 1]])
                    n += sizes[-1]
                    if n >= shard_tokens:
                        yield shard()
        if ids:
            yield shard()

    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    order = [F.col("doc").asc_nulls_last(), F.xxhash64("text").asc()]
    d = d.repartitionByRange(*order).sortWithinPartitions(*order)
    d.mapInArrow(run, "part int, seq int, n_docs long, n_tokens long, start_in_part long, content binary").write.option("compression", "uncompressed").parquet(path)


_SHARD = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("start_in_part", pa.int64()), ("content", pa.binary())])


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of the shards: doc_id, start (ids before it), n_tokens, crc32 of the ids as little-endian u32, and the ids.

    Shards are decoded where they are read; only one total per range
    partition is broadcast (their number is the write's partition count).
    """
    shards = spark.read.schema("part int, seq int, n_docs long, n_tokens long, start_in_part long, content binary").parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("part_start"))
    placed = shards.join(F.broadcast(starts), "part").select((F.col("part_start") + F.col("start_in_part")).alias("at"), "content")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, sizes, wm = unpack_shard(blob.as_py())
                tokens = wm.tokens().astype("<u4")
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                data, cut = memoryview(tokens.tobytes()), ends.tolist()
                cols = [pa.array(ids, pa.int64()), pa.array(at + ends[:-1]), pa.array(sizes), pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(cut, cut[1:])], pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return placed.mapInArrow(run, schema)
