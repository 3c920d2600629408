"""Pre-tokens, BPE, token shards and token counts against the tokenizers library."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tandem.llm import bpe, token_counts, wavelet
from tandem.llm import textops as tx
from tests.llm.conftest import doc_rows

PARTS = ["'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", " ", "1", "²", "é", "é", "-", "中", "😀", "\x1c", "\x85", "the", "aaaaaaa", "<|endoftext|>", "<|endof"]


def as_buffer(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PARTS), st.characters(exclude_categories=["Cs"])), max_size=25).map("".join), max_size=4))
def test_ids_equal_the_library(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    model, cache = bpe.load(path)
    buf, offs = as_buffer(texts)
    ids, ends = tx.encode_documents(buf, offs, cache, model.special["<|endoftext|>"])
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
    assert model.decode(ids, ends) == texts


def test_every_code_point_has_the_librarys_class():
    from tokenizers.pre_tokenizers import ByteLevel

    library = ByteLevel(add_prefix_space=False)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 40_000):
        text = "".join(f"a{chr(c)}a1{chr(c)}1\n\n" for c in points[k : k + 40_000])
        buf, offs = as_buffer([text])
        start, *_ = tx.pretokens(buf, offs)
        at = np.append(tx.code_points(buf)[1], len(buf))
        assert start.tolist() == [int(at[a]) for _, (a, _) in library.pre_tokenize_str(text)]


def test_long_pieces(bpe_path, library):
    model, _ = bpe.load(bpe_path)
    for text in ("a" * 3000, "abcdefghij" * 100, "xyzzy" * 90):
        assert np.frombuffer(model.encode_pieces([text.encode()])[0], "<u4").tolist() == library([text])[0]


def test_bpe_over_hard_rows(edge_docs, bpe_path, library):
    rows = bpe.encode(edge_docs, bpe_path, decoded_col="decoded").collect()
    want = sorted((str(i), tuple(ids), t or "") for (i, t, *_), ids in zip(doc_rows(), library([r[1] for r in doc_rows()])))
    assert sorted((str(r.doc_id), tuple(r.ids), r.decoded) for r in rows) == want
    back = bpe.decode(bpe.encode(edge_docs, bpe_path, keep=["doc_id"]), bpe_path).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, *_ in doc_rows())


def test_decode_of_null_and_broken_ids(spark, bpe_path):
    df = spark.createDataFrame([(1, None), (2, []), (3, [187])], "k int, ids array<int>")
    got = {r.k: r.text for r in bpe.decode(df, bpe_path).collect()}
    assert got[1] is None and got[2] == "" and got[3] == bytes(bpe.load(bpe_path)[0].bytes[187]).decode("utf-8", "replace")


def test_shards_over_hard_rows(spark, edge_docs, bpe_path, library, tmp_path):
    path = str(tmp_path / "shards")
    wavelet.write_shards(edge_docs, path, bpe_path, end_id=2, shard_tokens=500)
    rows = wavelet.read_documents(spark, path).collect()
    ids = {t: i for (_, t, *_), i in zip(doc_rows(), library([r[1] for r in doc_rows()]))}
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in rows) == sorted((str(i), (*ids[t], 2)) for i, t, *_ in doc_rows())
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda d: (d is None, d or 0))
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens


@pytest.mark.parametrize("tokens", [[], [0], [0] * 70, [50256, 2, 2, 7], list(range(300)) * 3])
def test_wavelet_matrix_queries(tokens):
    a = np.array(tokens, dtype=np.uint32)
    _, sizes, wm = wavelet.unpack_shard(wavelet.pack_shard([None, 4], [0, len(a)], a))
    assert wm.tokens().tolist() == tokens and sizes.tolist() == [0, len(a)]
    assert [wm.access(i) for i in range(len(tokens))] == tokens
    for t in {*tokens[:20], 1, 99_999}:
        where = [i for i, x in enumerate(tokens) if x == t]
        assert wm.occurrences(t) == where and wm.count(t) == len(where)
        assert wm.rank(t, len(tokens) // 2) == sum(i < len(tokens) // 2 for i in where)


@pytest.mark.parametrize("chunk_bytes,buckets", [(16 << 20, None), (200, 3)])
def test_counts_over_hard_rows(edge_docs, bpe_path, library, chunk_bytes, buckets):
    rows = token_counts.count_tokens(edge_docs, bpe_path, chunk_bytes=chunk_bytes, buckets=buckets).collect()
    want = sorted((str(i), len((t or "").encode()), len(ids)) for (i, t, *_), ids in zip(doc_rows(), library([r[1] for r in doc_rows()])))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want


def test_empty_tables(spark, no_docs, bpe_path, tmp_path):
    path = str(tmp_path / "none")
    wavelet.write_shards(no_docs, path, bpe_path, end_id=2)
    assert wavelet.read_documents(spark, path).count() == 0
    assert bpe.encode(no_docs, bpe_path, decoded_col="d").count() == 0
    assert token_counts.count_tokens(no_docs, bpe_path).count() == 0


def complements(n):
    """Two words of n letters in the Thue-Morse order: they clash in any polynomial hash modulo 2^64."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_clash_by_shape(spark, bpe_path, library, tmp_path, n):
    a, b = complements(n)
    texts = [a, b, f"{a} {b}", f"{b} {a} {a}", a]
    raw = as_buffer(texts)
    start, end, *_ = tx.pretokens(*raw)
    where, number = tx.distinct_spans(raw[0], start, end, tx.span_hashes(raw[0], start, end))
    spans = [raw[0][s:e].tobytes() for s, e in zip(start, end)]
    assert [spans[i] for i in where[number]] == spans and len({spans[i] for i in where}) == len(where)
    want = library(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert [r.ids for r in bpe.encode(docs, bpe_path).sort("doc_id").collect()] == want
    assert [r.n_tokens for r in token_counts.count_tokens(docs, bpe_path).sort("doc_id").collect()] == [len(w) for w in want]
    path = str(tmp_path / "shards")
    wavelet.write_shards(docs, path, bpe_path, end_id=2)
    assert [r.ids[:-1] for r in wavelet.read_documents(spark, path).sort("doc_id").collect()] == want


def test_texts_are_told_apart_by_bytes_when_hashes_agree(bpe_path, library, monkeypatch):
    """Every span gets one of three hashes: ids and counts stay right."""
    plain = tx.span_hashes
    monkeypatch.setattr(tx, "span_hashes", lambda buf, start, end: plain(buf, start, end) % np.uint64(3))
    texts = [t or "" for _, t, *_ in doc_rows() if len(t or "") < 1000]
    for load in (lambda: bpe.load(bpe_path), lambda: wavelet.library_cache(bpe_path)):
        buf, offs = as_buffer(texts)
        cache = tx.PieceCache(load()[0].encode if hasattr(load()[0], "encode") else load()[1].encode)
        for _ in range(2):
            ids, ends = tx.encode_documents(buf, offs, cache, 50256)
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == library(texts)
    gather = token_counts._Gather()
    buf, offs = as_buffer(texts)
    for _ in range(2):
        gather.add(np.arange(len(texts)), buf, offs)
    assert len(set(gather.words.values())) == len(gather.words)


def test_spans_longer_than_the_sums_hold(monkeypatch):
    monkeypatch.setattr(tx, "_SPAN", 4)
    buf = np.frombuffer(b"abcdefghij-abcdefghij-abcdefghik", np.uint8)
    start, end = np.array([0, 11, 22, 0]), np.array([10, 21, 32, 0])
    h = tx.span_hashes(buf, start, end)
    monkeypatch.undo()
    assert h[0] == h[1] != h[2] and (h == tx.span_hashes(buf, start, end)).all()


def test_ids_text_makes_no_string_per_id(spark):
    """The text that op2 digests, without an array of strings (its garbage filled an executor's heap)."""
    from pyspark.sql import functions as F

    from tandem.llm.queries import ids_text

    df = spark.createDataFrame([([1, 23, 456],), ([],), ([0],), ([50256] * 1000,)], "ids array<int>")
    out = df.select(ids_text("ids").alias("a"), F.concat_ws(",", F.col("ids").cast("array<string>")).alias("b"))
    assert [r.a for r in out.collect()] == [r.b for r in out.collect()]
    assert "array<string>" not in df.select(ids_text("ids"))._jdf.queryExecution().toString()
