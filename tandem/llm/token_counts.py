"""Token counts of documents without materialising ids.

Texts are split into pre-tokens; the pieces of each distinct pre-token are
counted once (over all documents, in the bucket its hash falls to), joined to
the per-document pre-token frequencies and summed. See ``postings``.

Results by case: null text counts as empty (0 bytes, 0 tokens); the special
string inside a text counts as one token; rows that repeat, share an id or
have a null id are counted one by one; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm import postings as ps
from tandem.llm import textops as tx
from tandem.llm.wavelet import library_encoder

_ROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])
_DDL = "bucket int, chunk long, blob binary"


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, chunk_bytes: int = ps.CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; ``buckets`` defaults to the shuffle partitions."""
    spark = docs.sparkSession
    n_buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = d.mapInArrow(_frequencies(n_buckets, chunk_bytes), _DDL)
    summed = rows.repartitionById(n_buckets, F.expr(f"if(bucket < 0, cast(pmod(hash(chunk), {n_buckets}) as int), bucket)"))
    back = summed.mapInArrow(_pieces(tokenizer_path), _DDL)
    return back.repartition(n_buckets, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(_documents, "doc_id long, n_bytes long, n_tokens long")


def _frequencies(n_buckets: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seq = 0
        state = _Gather()
        for batch in batches:
            buf, offs = tx.buffers(batch.column(1))
            for i, j, data, cuts in tx.slices(buf, offs):
                state.add(batch.column(0).slice(i, j - i), data, cuts)
                if state.bytes >= chunk_bytes:
                    yield from state.rows(part << 32 | seq, n_buckets)
                    state, seq = _Gather(), seq + 1
        if state.chunk.n_docs:
            yield from state.rows(part << 32 | seq, n_buckets)

    return run


class _Gather:
    def __init__(self) -> None:
        self.chunk = ps.Chunk()
        self.words: dict[int, bytes] = {}  # text of each key; no two texts of a chunk share a key
        self.ids: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self.special: list[np.ndarray] = []
        self.bytes = 0

    def add(self, ids: pa.Array, data: np.ndarray, cuts: np.ndarray) -> None:
        start, end, first, special = tx.pretokens(data, cuts)
        doc = np.repeat(np.arange(len(cuts) - 1), np.diff(first))
        self.special.append(np.bincount(doc[special], minlength=len(cuts) - 1))
        start, end, doc = start[~special], end[~special], doc[~special]
        h = tx.span_hashes(data, start, end)
        where, number = tx.distinct_spans(data, start, end, h)
        raw = data.tobytes()
        keys = [self._key(k, raw[a:b]) for k, a, b in zip(h[where].tolist(), start[where].tolist(), end[where].tolist())]
        h = np.array(keys, dtype=np.uint64)[number]
        self.chunk.add(h, doc, len(cuts) - 1)
        self.ids.append(ids)
        self.sizes.append(np.diff(cuts))
        self.bytes += len(data)

    def _key(self, key: int, text: bytes) -> int:
        """The text's key in this chunk: its hash, or the next free number where another text has it."""
        while self.words.setdefault(key, text) != text:
            key = (key + 1) & 0xFFFFFFFFFFFFFFFF
        return key

    def rows(self, chunk: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays(self.ids)
        known = np.array(ids.is_valid().to_pylist(), dtype=np.uint8)
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        yield _row(-1, chunk, ps.pack(values, known, np.concatenate(self.sizes), np.concatenate(self.special)))
        for b, keys, n, doc, freq in self.chunk.buckets(n_buckets):
            words = [self.words[k] for k in keys.tolist()]
            size = np.fromiter(map(len, words), np.int64, len(words))
            yield _row(b, chunk, ps.pack(keys, ps.small(size), np.frombuffer(b"".join(words), np.uint8), ps.small(n), ps.small(doc), ps.small(freq)))


def _row(bucket: int, chunk: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([chunk], pa.int64()), pa.array([blob], pa.binary())], schema=_ROW)


def _pieces(tokenizer_path: str):
    """Per bucket row: pieces of each distinct pre-token, counted once per worker's bucket; then sums per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = library_encoder(tokenizer_path)
        count: dict[bytes, int] = {}
        for batch in batches:
            for bucket, chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if bucket < 0:
                    yield _row(bucket, chunk, blob.as_py())
                    continue
                _, size, raw, n, doc, freq = ps.unpack(blob.as_py())
                data, e = raw.tobytes(), [0, *np.cumsum(size.astype(np.int64)).tolist()]
                words = [data[a:b] for a, b in zip(e, e[1:])]
                got = list(map(count.get, words))
                todo = [i for i, g in enumerate(got) if g is None]
                if todo:
                    for i, k in zip(todo, encode([words[i] for i in todo])[1].tolist()):
                        got[i] = count[words[i]] = k
                value = np.repeat(np.array(got, dtype=np.int64), n.astype(np.int64)) * freq
                docs, total = ps.sum_by_document(doc, value)
                yield _row(bucket, chunk, ps.pack(ps.small(docs), ps.small(total.astype(np.int64))))

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk, the chunk's own row (bucket -1) first."""
    now, head, total = None, None, None

    def out() -> pa.RecordBatch:
        values, known, size, _ = head
        ids = pa.array(values, pa.int64(), mask=known == 0)
        return pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(total, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    for batch in batches:
        for bucket, chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            arrays = ps.unpack(blob.as_py())
            if chunk != now:
                if head is not None:
                    yield out()
                now, head, total = chunk, arrays, arrays[3].astype(np.int64)
            if bucket >= 0:
                total[arrays[0]] += arrays[1].astype(np.int64)
    if head is not None:
        yield out()
