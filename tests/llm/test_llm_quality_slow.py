"""The quality classifier's features, training and scores against plain Python."""

import math
import zlib

import numpy as np
import pytest

from tandem.llm import quality
from tests.llm.conftest import doc_rows

M64 = (1 << 64) - 1
P61 = (1 << 61) - 1
MUL = 0x9E3779B97F4A7C15
BASE = 0x12F1C1B3A98D5E47 % P61
BLANKS = b" \t\n\x0b\x0c\r"


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def slow_features(text, bits):
    """Every feature's row, one by one."""
    raw = (text or "").encode()
    words, now = [], b""
    for c in raw + b" ":
        if c in BLANKS:
            if now:
                words.append(now)
            now = b""
        else:
            now += bytes([c])
    hashed = [mix(sum((c + 1) * pow(BASE, i, P61) for i, c in enumerate(w)) % P61) for w in words]
    out = [h >> 64 - bits for h in hashed]
    for a, b in zip(hashed, hashed[1:]):
        out.append(mix(1 if a == b else mix((a * MUL + b) & M64)) >> 64 - bits)
    codes = [32, *(32 if c in BLANKS else c for c in raw), 32]
    for n in (3, 4):
        for i in range(len(codes) - n + 1):
            piece = codes[i : i + n]
            if 32 not in piece[1:-1]:
                key = n
                for c in piece:
                    key = key << 8 | c
                out.append((key * MUL & M64) >> 64 - bits)
    return out


def slow_train(examples, bits, dim, epochs, rate, seed):
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32).tolist()
    out, bias = [[0.0, 0.0] for _ in range(dim)], [0.0, 0.0]
    step, steps = 0, epochs * len(examples)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)).tolist():
            rows, label = examples[i]
            lr = rate * (1 - step / steps)
            step += 1
            share = {r: rows.count(r) / len(rows) for r in sorted(set(rows))}
            hidden = [sum(s * emb[r][k] for r, s in share.items()) for k in range(dim)]
            z = [sum(hidden[k] * out[k][c] for k in range(dim)) + bias[c] for c in (0, 1)]
            e = [math.exp(v - max(z)) for v in z]
            p = [v / sum(e) - (c == label) for c, v in enumerate(e)]
            back = [out[k][0] * p[0] + out[k][1] * p[1] for k in range(dim)]
            for k in range(dim):
                for c in (0, 1):
                    out[k][c] -= lr * hidden[k] * p[c]
            bias = [bias[c] - 0.1 * lr * p[c] for c in (0, 1)]
            for r, s in share.items():
                for k in range(dim):
                    emb[r][k] -= lr * s * back[k]
    return [sum(emb[r][k] * (out[k][1] - out[k][0]) for k in range(dim)) for r in range(1 << bits)] + [bias[1] - bias[0]]


TEXTS = [t for _, t, *_ in doc_rows() if len(t or "") < 1000] + ["a", "ab ab ab", "\x0b\x0cx\ty\r", "é é"]


def as_buffer(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])


@pytest.mark.parametrize("bits", [6, 17])
def test_features(bits):
    row, doc = quality.features(*as_buffer(TEXTS), bits)
    for i, t in enumerate(TEXTS):
        assert sorted(row[doc == i].tolist()) == sorted(slow_features(t, bits))


def test_training_and_scores():
    bits, dim, epochs, rate, seed = 6, 3, 4, 0.5, 11
    some = [t for t in TEXTS if t and t.strip()][:8]
    rows, share, ends = quality.bags(*as_buffer(some), bits)
    fast = quality.train([(rows[a:b], share[a:b], i % 2) for i, (a, b) in enumerate(zip(ends, ends[1:]))], bits, dim, epochs, rate, seed)
    slow = slow_train([(slow_features(t, bits), i % 2) for i, t in enumerate(some)], bits, dim, epochs, rate, seed)
    assert np.abs(fast - np.array(slow)).max() < 1e-4 * max(1, np.abs(fast).max()) and np.abs(fast).max() > 1e-3
    got = quality.score_texts(*as_buffer(TEXTS), fast, bits)
    for t, s in zip(TEXTS, got):
        f = slow_features(t, bits)
        mean = sum(fast[r] for r in f) / len(f) if f else 0.0
        assert abs(s - 1 / (1 + math.exp(-(mean + fast[-1])))) < 1e-8


def test_rows_of_the_query(spark):
    """Which rows are learned from, and that the query's scores are those of the plain features."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    weight = quality.fit(docs, labels)
    outside = labels.collect()
    kept = [r.doc_id for r in outside if zlib.crc32(str(r.doc_id).encode()) % 5 != 0]
    held = spark.createDataFrame([(r.doc_id, 1 - r.quality, 0) if r.doc_id not in kept else (r.doc_id, r.quality, 0) for r in outside], "doc_id long, quality int, toxic int")
    assert (quality.fit(docs, held) == weight).all()  # labels of the held-out fold change nothing
    got = {r.doc_id: r.s for r in quality.score(docs.select("doc_id", "text"), weight, score_col="s").collect()}
    for r in docs.collect()[:12]:
        if len(r.text or "") < 3000:
            f = slow_features(r.text, quality.BITS)
            mean = round(sum(weight[x] for x in f) / max(len(f), 1), 9)
            assert abs(got[r.doc_id] - 1 / (1 + math.exp(-max(-700, min(700, mean + weight[-1]))))) < 1e-6
