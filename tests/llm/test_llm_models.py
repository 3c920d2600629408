"""The suffix tree and the quality classifier: exact base scores, proper distributions, held-out accuracy."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tandem.llm import quality, suffix_lm
from tandem.llm import textops as tx
from tests.conftest import SF_SMALL
from tests.llm import slow_tree
from tests.llm.conftest import doc_rows


def toks(text):
    return [*(text or "").encode().lower().split(), None]


def check_base(rows, texts):
    """rows: scored rows; texts: (id, text) of the same rows."""
    train = Counter(w for i, t in texts if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for w in toks(t))
    n, v = sum(train.values()), len(train)
    z = n + 0.5 * (v + 1)
    want = []
    for i, t in texts:
        base = sum(math.log10((train[w] + 0.5) / z) for w in toks(t))
        want.append((str(i), zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1, len(toks(t)), sum(train[w] > 0 for w in toks(t)), n, round(base, 6)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("chunk_bytes,buckets", [(16 << 20, None), (300, 3)])
def test_scores_of_hard_rows(edge_docs, chunk_bytes, buckets):
    rows = suffix_lm.score(edge_docs, chunk_bytes=chunk_bytes, buckets=buckets).collect()
    check_base(rows, [(r[0], r[1]) for r in doc_rows()])
    # repeated rows score alike
    twice = [r.score for r in rows if r.doc_id == 10]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_empty_table_scores_nothing(no_docs):
    assert suffix_lm.score(no_docs).count() == 0


def test_scores_beat_the_base_where_contexts_help(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = suffix_lm.score(docs).collect()
    check_base(rows, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_every_state_is_a_distribution():
    """Brute force over a small vocabulary: next-symbol probabilities sum to one with the unknown word."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(6)]
    texts = [" ".join(words[(k * j + k) % 6] if rng.random() < 0.8 else words[rng.integers(6)] for j in range(200)) for k in range(1, 6)]
    buf, offs = tx.buffers(__import__("pyarrow").array(texts))
    flat, ends = suffix_lm.tokens(buf, offs)
    g = suffix_lm.grams(flat, ends, 4)
    total, distinct = len(flat), len(set(flat.tolist()))
    z = total + 0.5 * (distinct + 1)
    key, n = np.unique(flat, return_counts=True)
    levels = [slow_tree.Level(key, n, key, key, key)]
    for d in range(1, 4):
        at = np.flatnonzero(g[d])
        key, first, n = np.unique(g[d][at], return_index=True, return_counts=True)
        some = n >= 2
        i = at[first][some]
        ok = np.isin(g[d - 1][i - 1], levels[-1].key) & np.isin(g[d - 1][i], levels[-1].key)
        levels.append(slow_tree.Level(key[some][ok], n[some][ok], g[d - 1][i - 1][ok], g[d - 1][i][ok], flat[i][ok]))
    tree = slow_tree.build(levels, total, distinct, 1.0)
    assert sum(len(s[0]) for s in tree.states) > 3
    counts = Counter(flat.tolist())

    def log10_of(history, symbol):
        run = np.array([*history, symbol], dtype=np.uint64)
        ends = np.array([0, len(run)])
        whole = slow_tree.gains(tree, run, ends)[0]
        before = slow_tree.gains(tree, run[:-1], np.array([0, len(run) - 1]))[0] if history else 0.0
        return whole - before + math.log10((counts[symbol] + 0.5) / z)

    vocab = sorted(counts)
    unknown = 12345
    for history in ([], [vocab[0]], [vocab[1], vocab[2]], [vocab[3], vocab[1], vocab[2]], list(map(int, flat[:3]))):
        if int(suffix_lm.END) in history:
            continue
        assert abs(sum(10 ** log10_of(history, s) for s in [*vocab, unknown]) - 1) < 1e-9


def test_classifier_holds_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    weight = quality.fit(docs, labels)
    scored = {r.doc_id: r.score for r in quality.score(docs.select("doc_id", "text"), weight).collect()}
    held = [(scored[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((s >= quality.ACCEPT) == bool(q) for s, q in held)
    assert len(held) > 50 and right / len(held) >= 0.95
    assert (quality.fit(docs.repartition(5), labels) == weight).all()  # same sample, same model


def test_classifier_on_hard_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (8, 0, 1), (10, 1, 0), (None, 1, 0), (7, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    weight = quality.fit(edge_docs, labels)
    out = quality.score(edge_docs, weight, score_col="made_score")
    assert out.columns == [*edge_docs.columns, "made_score"]
    rows = out.collect()
    assert len(rows) == len(doc_rows()) and all(0 <= r.made_score <= 1 for r in rows)
    same = {r.made_score for r in rows if r.doc_id in (10, 11)}
    assert len(same) == 1 and len({r.made_score for r in rows if not (r.text or "")}) == 1
    none = quality.fit(no_docs, labels.limit(0))
    assert {r.made_score for r in quality.score(edge_docs, none, score_col="made_score").collect()} == {0.5}
    assert quality.score(no_docs, weight, score_col="made_score").count() == 0


@pytest.mark.parametrize("filler", [1_000, 1_700_000])
def test_a_phrase_stays_learned_as_text_is_added(spark, filler):
    train = [i for i in range(50) if not suffix_lm.held_out(i)][:12]
    held = next(i for i in range(50) if suffix_lm.held_out(i))
    phrase = "seldom seen words follow"
    rows = [(train[0], phrase), (train[1], phrase), (held, phrase), *((i, "aa " * (filler // 10)) for i in train[2:])]
    row = next(r for r in suffix_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out)
    assert row.train_tokens >= filler and row.score - row.base_score > 5


def test_tables_build_the_tree_of_all_runs_that_repeat(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").limit(300).toArrow()
    buf, offs = tx.buffers(docs.column(1).combine_chunks())
    flat, ends = suffix_lm.tokens(buf, offs)
    train = np.array([not suffix_lm.held_out(i) for i in docs.column(0).to_pylist()])
    inside = np.repeat(train, np.diff(ends))
    g = suffix_lm.grams(flat, ends, 4)
    key, n = np.unique(flat[inside], return_counts=True)
    total, distinct = int(n.sum()), len(key)
    levels = [slow_tree.Level(key, n, key, key, key)]
    for d in range(1, 4):
        at = np.flatnonzero((g[d] != 0) & inside)
        key, first, n = np.unique(g[d][at], return_index=True, return_counts=True)
        i = at[first][n >= 2]
        levels.append(slow_tree.Level(key[n >= 2], n[n >= 2], g[d - 1][i - 1], g[d - 1][i], flat[i]))
    tree = slow_tree.build(levels, total, distinct, suffix_lm.MIN_GAIN)
    assert all(len(s[0]) > 10 for s in tree.states)
    want = dict(zip(docs.column(0).to_pylist(), slow_tree.gains(tree, flat, ends)))
    rows = suffix_lm.score(spark.createDataFrame(docs), buckets=5, chunk_bytes=100_000).collect()
    assert len(rows) == len(want) and all(abs(r.score - r.base_score - want[r.doc_id]) < 1e-6 for r in rows)


def test_a_repeated_id_is_one_labelled_row(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][:30]
    docs = spark.createDataFrame([(i, f"{'good' if k % 2 else 'bad'} text of w{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    repeated = docs.unionByName(docs.filter(f"doc_id = {ids[0]}").crossJoin(spark.range(100)).drop("id"))
    assert repeated.count() == 130
    assert (quality.fit(repeated, labels) == quality.fit(docs, labels)).all()


def test_words_that_clash_by_shape_are_counted_apart(spark):
    bits = [i.bit_count() & 1 for i in range(1024)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    texts = [(i, f"{a} {b} {b} and {a if i % 2 else b}") for i in range(12)] + [(12, a), (13, b)]
    rows = suffix_lm.score(spark.createDataFrame(texts, "doc_id long, text string").repartition(2)).collect()
    check_base(rows, texts)
