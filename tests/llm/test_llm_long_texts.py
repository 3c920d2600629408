"""Texts longer than a slice (``textops.SLICE_BYTES``), beside short ones, in every operator that reads texts by slices."""

import zlib

import numpy as np
import pytest

from tandem.llm import bpe, minhash, quality, suffix_lm, token_counts, wavelet
from tandem.llm import textops as tx
from tests.llm.test_llm_dedup import word_set
from tests.llm.test_llm_models import check_base
from tests.llm.test_llm_quality_slow import slow_features

LONG = " ".join(f"long{i % 5003} ünd{i % 977}" for i in range(90_000))
NEAR = LONG.replace("long17 ", "other ")
ROWS = [(1, "short one"), (2, LONG), (3, ""), (4, NEAR), (5, None), (6, "short one"), (7, "x" * (tx.SLICE_BYTES + 10))]


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG.encode()) > tx.SLICE_BYTES
    return spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)


def test_ids_and_counts(spark, docs, bpe_path, library, tmp_path):
    want = dict(zip([i for i, _ in ROWS], library([t for _, t in ROWS])))
    assert {r.doc_id: r.ids for r in bpe.encode(docs, bpe_path).collect()} == want
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, bpe_path).collect()} == {i: len(x) for i, x in want.items()}
    wavelet.write_shards(docs, str(tmp_path / "s"), bpe_path, end_id=2)
    got = {r.doc_id: r.ids_crc32 for r in wavelet.read_documents(spark, str(tmp_path / "s"), with_ids=False).collect()}
    assert got == {i: zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for i, x in want.items()}


def test_near_duplicates(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, words=2).collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: len(word_set(t, 2)) for i, t in ROWS}
    assert {i: c for i, (_, c) in got.items()} == {1: 1, 2: 2, 3: 3, 4: 2, 5: 5, 6: 1, 7: 7}


def test_base_scores(docs):
    check_base(suffix_lm.score(docs).collect(), ROWS)


def test_quality(docs):
    weight = np.linspace(-1, 1, (1 << quality.BITS) + 1)
    got = {r.doc_id: r.s for r in quality.score(docs, weight, score_col="s").collect()}
    rows = slow_features(LONG[:4000], quality.BITS)
    part = quality.features(*(lambda raw: (np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))(LONG[:4000].encode()), quality.BITS)[0]
    assert sorted(part.tolist()) == sorted(rows)
    for i, t in ROWS[:4]:
        raw = (t or "").encode()
        alone = quality.score_texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), weight)
        assert abs(got[i] - alone[0]) < 1e-9
