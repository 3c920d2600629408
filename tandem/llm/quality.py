"""Quality classifier on supervised subword embeddings.

A text's features are its words, the 3- and 4-byte pieces of its words (with
word ends) and its word pairs (a word that repeats the one before counts as the
same pair whatever the word), hashed into ``2 ** bits`` rows. The learned rows
are averaged over the whole text and a softmax layer gives the class odds. Rows
and layer are trained together by numpy stochastic gradient descent on a
bounded sample of labelled rows (``sample``, taken by a hash of the id), in one
task. Scoring needs only each row's share of the final logit, ``2 ** bits``
numbers of fixed size, which go to all executors; every text is read whole.

Results by case: null and empty texts have no features and get the layer's
bias alone; rows that repeat or share an id are scored one by one; a null id
counts as the id ''; without labelled rows every score is the prior 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm import postings as ps
from tandem.llm import textops as tx

BITS, DIM, EPOCHS, RATE, SAMPLE, SEED = 17, 8, 8, 2.0, 3000, 5
ACCEPT = 0.3  # least score of a document that is kept
_MUL = np.uint64(0x9E3779B97F4A7C15)


def features(buf: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row number, document) of every feature of every document, unordered."""
    start, end, first = tx.word_spans(buf, offs)
    word = tx.span_hashes(buf, start, end)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    rows, docs = [word >> np.uint64(64 - bits)], [owner]
    pair = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
    same = word[pair + 1] == word[pair]
    joined = np.where(same, np.uint64(1), tx.mix(word[pair] * _MUL + word[pair + 1]))
    rows.append(tx.mix(joined) >> np.uint64(64 - bits))
    docs.append(owner[pair])
    # byte pieces: runs of 3 and 4 bytes of "<word>", blanks and text ends standing for < and >
    padded = np.full(len(buf) + len(offs), 32, dtype=np.uint8)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    padded[np.arange(len(buf)) + doc + 1] = buf
    blank = tx._SPACE[padded]
    code = np.where(blank, np.uint64(32), padded.astype(np.uint64))
    where = np.cumsum(np.concatenate([[0], np.diff(offs) + 1]))
    for n in (3, 4):
        m = len(code) - n + 1
        if m <= 0:
            continue
        ok = np.ones(m, dtype=bool)
        key = np.full(m, np.uint64(n))
        for k in range(n):
            key = key << np.uint64(8) | code[k : k + m]
            if 0 < k < n - 1:
                ok &= ~blank[k : k + m]
        at = np.flatnonzero(ok)
        rows.append((key[at] * _MUL) >> np.uint64(64 - bits))
        docs.append(np.minimum(np.searchsorted(where, at, side="right") - 1, len(offs) - 2))
    return np.concatenate(rows).astype(np.int64), np.concatenate(docs)


def bags(buf: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document its distinct rows and their shares of all its features: (rows, shares, offsets)."""
    row, doc = features(buf, offs, bits)
    key, count = np.unique(doc << bits | row, return_counts=True)
    d, r = key >> bits, key & ((1 << bits) - 1)
    total = np.bincount(doc, minlength=len(offs) - 1)
    return r, (count / np.maximum(total, 1)[d]).astype(np.float32), np.searchsorted(d, np.arange(len(offs)))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> np.ndarray:
    """Share of the logit of class 1 that each row adds, and the bias last."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out = np.zeros((dim, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    step, steps = 0, max(1, epochs * len(examples))
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            rows, share, label = examples[i]
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            got = emb[rows]
            hidden = share @ got
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= np.float32(0.1) * lr * p
            emb[rows] = got - lr * share[:, None] * back
    logit = emb @ (out[:, 1] - out[:, 0])
    return np.append(logit, bias[1] - bias[0]).astype(np.float64)


def score_texts(buf: np.ndarray, offs: np.ndarray, weight: np.ndarray, bits: int = BITS) -> np.ndarray:
    row, doc = features(buf, offs, bits)
    n = len(offs) - 1
    total = np.bincount(doc, weights=weight[row], minlength=n)
    # summed in a fixed order per document, so equal texts score equally
    mean = np.round(total / np.maximum(np.bincount(doc, minlength=n), 1), 9)
    return 1 / (1 + np.exp(-np.clip(mean + weight[-1], -700, 700)))


def _bag_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = tx.buffers(batch.column(1))
            for i, j, data, cuts in tx.slices(buf, offs, tx.SLICE_BYTES // 2):
                rows, share, ends = bags(data, cuts, bits)
                cut = ends.tolist()
                blobs = [ps.pack(rows[a:b].astype(np.uint32), share[a:b]) for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(blobs, pa.binary())], names=["key", "label", "bag"])

    return run


def _train_rows(bits: int, dim: int, epochs: int, rate: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for key, label, bag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                held.append((key, label, bag))
        held.sort()
        examples = [(r.astype(np.int64), s, label) for r, s, label in ((*ps.unpack(bag), label) for _, label, bag in held)]
        weight = train(examples, bits, dim, epochs, rate, seed) if examples else np.zeros((1 << bits) + 1)
        yield pa.RecordBatch.from_arrays([pa.array([weight.astype("<f8").tobytes()], pa.binary())], names=["weight"])

    return run


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> np.ndarray:
    """Train on at most ``sample`` labelled rows outside the held-out fold (fold 0); rows chosen by a hash of their id.

    Where an id has several texts its label stands for one of them, that of the least hash.
    """
    known = labels.filter(F.col(f"`{label_col}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull() & (fold(id_col) != 0))
    known = known.groupBy(F.col(f"`{id_col}`").cast("long").alias("key")).agg(F.min(F.col(f"`{label_col}`").cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(sample)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("key is not null")
    # at most ``sample`` rows are broadcast
    rows = texts.join(F.broadcast(chosen), "key").groupBy("key", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    rows = rows.select("key", F.col("least.text").alias("text"), "label").mapInArrow(tx.tidy(_bag_rows(bits)), "key long, label int, bag binary")
    model = rows.repartition(1).mapInArrow(_train_rows(bits, dim, epochs, rate, seed), "weight binary").first()
    return np.frombuffer(model.weight, "<f8")


def score(docs: DataFrame, weight: np.ndarray, text_col: str = "text", score_col: str = "score", bits: int = BITS) -> DataFrame:
    """All columns of ``docs`` and the probability of class 1."""
    held = docs.sparkSession.sparkContext.broadcast(weight)
    cols = docs.columns
    at = cols.index(text_col)
    schema = T.StructType([*(T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)), T.StructField("s", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            buf, offs = tx.buffers(batch.column(at))
            got = [score_texts(data, cuts, w, bits) for _, _, data, cuts in tx.slices(buf, offs, tx.SLICE_BYTES // 2)]
            s = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*(f"c{k}" for k in range(batch.num_columns)), "s"])

    return docs.toDF(*[f"c{k}" for k in range(len(cols))]).mapInArrow(tx.tidy(run), schema).toDF(*cols, score_col)
