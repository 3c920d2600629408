"""Packing against the tokenizers library and the rules of its sequences."""

import zlib
from collections import Counter

import numpy as np
import pytest

from tandem.llm import packing
from tandem.llm import queries as q
from tests.llm.conftest import doc_rows


def check(rows, docs, library, end_id, size):
    """Rows of pieces against whole documents: every id once, gapless sequences, no padding below a power of two."""
    want = Counter()
    for (i, t, *_), ids in zip(docs, library([d[1] for d in docs])):
        want[(i, tuple([*ids, end_id]))] += 1
    got, held = Counter(), {}
    pieces = sorted(rows, key=lambda r: (r["part_key"], r["start"]))
    for r in pieces:
        held.setdefault(r["part_key"], []).append(r)
    for rs in held.values():
        at, ids = 0, []
        for r in rs:
            assert r["start"] == at and r["doc_tokens"] == sum(x["length"] for x in rs)
            ids += r["ids"]
            at += r["length"]
        got[(rs[0]["doc_id"], tuple(ids))] += 1
    assert got == want
    numbers = sorted(r["sequence_id"] for r in rows)
    assert numbers == list(range(len(rows))) and all(r["offset"] == 0 for r in rows)
    assert all(r["length"] <= size and r["length"] & (r["length"] - 1) == 0 for r in rows)
    by_number = sorted((r["sequence_id"], r["length"]) for r in rows)
    assert [n for _, n in by_number] == sorted(n for _, n in by_number)  # one bucket after the other


@pytest.mark.parametrize("size", [1, 64, 1024])
def test_pieces_over_hard_rows(spark, edge_docs, bpe_path, library, tmp_path, size):
    path = str(tmp_path / "sequences")
    # ids of their own tell the rows of one document apart in the test only
    docs = [(n, t) for n, (_, t, *_) in enumerate(doc_rows()) if size > 1 or len(t or "") < 1000]
    packing.write_sequences(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), path, bpe_path, end_id=0, size=size)
    rows = [r.asDict() | {"ids": np.frombuffer(bytes(r.ids), "<u4").tolist(), "part_key": r.doc_id} for r in packing.read_sequences(spark, path).collect()]
    check(rows, docs, library, 0, size)


def test_repeated_and_null_ids_and_clashing_columns(spark, edge_docs, bpe_path, library, tmp_path):
    path = str(tmp_path / "sequences")
    packing.write_sequences(edge_docs.withColumn("length", edge_docs.n_chars).withColumn("rank", edge_docs.n_chars).withColumn("part", edge_docs.text), path, bpe_path, end_id=7)
    rows = packing.read_sequences(spark, path).collect()
    ids = library([r[1] for r in doc_rows()])
    want = Counter()
    for (i, *_), x in zip(doc_rows(), ids):
        at = 0
        for width in [1024] * ((len(x) + 1) // 1024) + [1 << k for k in range(9, -1, -1) if (len(x) + 1) >> k & 1]:
            want[(i, at, width, len(x) + 1, zlib.crc32(np.array([*x, 7][at : at + width], "<u4").tobytes()))] += 1
            at += width
    assert Counter((r.doc_id, r.start, r.length, r.doc_tokens, zlib.crc32(bytes(r.ids))) for r in rows) == want
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))


def test_no_documents(spark, no_docs, bpe_path, tmp_path):
    path = str(tmp_path / "none")
    packing.write_sequences(no_docs, path, bpe_path, end_id=0)
    assert packing.read_sequences(spark, path).count() == 0


def test_sizes_are_powers_of_two(no_docs, bpe_path, tmp_path):
    with pytest.raises(ValueError):
        packing.write_sequences(no_docs, str(tmp_path / "x"), bpe_path, end_id=0, size=1000)


def test_a_text_longer_than_a_slice(spark, bpe_path, library, tmp_path):
    path = str(tmp_path / "long")
    text = " ".join(f"w{i % 7919}" for i in range(250_000))
    packing.write_sequences(spark.createDataFrame([(1, text), (2, "b")], "doc_id long, text string"), path, bpe_path, end_id=0)
    rows = sorted(packing.read_sequences(spark, path).filter("doc_id = 1").collect(), key=lambda r: r.start)
    assert np.frombuffer(b"".join(bytes(r.ids) for r in rows), "<u4").tolist() == [*library([text])[0], 0]


def test_query_over_whole_documents(spark, library):
    sf = "/root/testdata/sf0.001"
    rows = q.op12_packing(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = dict(zip(docs, library(docs.values())))
    assert sum(r.length for r in rows) == sum(len(i) + 1 for i in ids.values())
    for r in rows:
        piece = [*ids[r.doc_id], 0][r.start : r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) + 1
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
