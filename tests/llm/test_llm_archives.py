"""WARC archives and source mixing."""

import base64
import gzip
import hashlib
from collections import Counter

import numpy as np
import pytest

from tandem.llm import mixing, warc
from tandem.llm.tables import land
from tests.llm.conftest import doc_rows

PAGES = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, None), (4, "http://d/\r\nx ", ""),
    (5, "http://e/", "WARC/1.1\r\nWARC-Type: response\r\n\r\nbody\r\n\r\nWARC/1.1\r\n\r\n"), (5, "http://e/", "second row of five"),
    (6, "http://f/", "ünï 😀\x00\r\n\r\n"), (7, "http://g/", "<p>one</p>"), (7, "http://g/", "<p>one</p>"),
    (None, "http://h/", "<p>one</p>"), (None, "http://i/", "only without id"), (8, "http://j/", "long " * 50_000),
]


def captures(spark, rows, path, **kw):
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, number string").repartition(3)
    warc.write_archives(pages, path, **kw)
    return warc.assemble(land(warc.read_records(spark, path), "t")).collect()


@pytest.mark.parametrize("min_bytes", [0, 11])
def test_captures_equal_the_pages(spark, tmp_path, min_bytes):
    got = captures(spark, PAGES, str(tmp_path / "w"), min_bytes=min_bytes)
    largest = {}
    for i, _, html in PAGES:
        h = (html or "").encode()
        if i is not None and len(h) >= min_bytes:
            largest[h] = max(largest.get(h, i), i)
    shared = Counter((html or "").encode() for *_, html in PAGES)
    want = []
    for i, _, html in PAGES:
        h = (html or "").encode()
        first = largest.get(h) if shared[h] > 1 else None
        revisit = first is not None and first != i
        want.append((str(i), len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if revisit else "response", str(first if revisit else None)))
    c = [r.capture for r in got]
    assert sorted((str(x.page_id), x.payload_bytes, x.payload_digest, x.type, str(x.refers_to)) for x in c) == sorted(want)
    assert all(r.request is not None and r.metadata is not None and r.request.url == r.capture.url for r in got)
    assert Counter(bytes(x.payload) for x in c if x.type == "response") == Counter((html or "").encode() for (*_, html), w in zip(PAGES, want) if w[3] == "response")
    assert len({x.record_id for x in c}) == len(PAGES)
    # the other records of the transaction
    assert all(r.metadata.fetched_bytes == r.capture.payload_bytes for r in got)
    asked = {None: "GET / HTTP/1.1", "http://d/%0D%0Ax%20": "GET http://d/%0D%0Ax%20 HTTP/1.1"}
    assert all(r.request.request_line == asked.get(r.request.url, f"GET {r.request.url} HTTP/1.1") for r in got)


def test_files_are_archives_any_reader_can_walk(spark, tmp_path):
    captures(spark, PAGES, str(tmp_path / "w"), file_records=6)
    files = list((tmp_path / "w").glob("part-*.gz"))
    assert len(files) > 3
    kinds = Counter()
    for f in files:
        for _, fields, block in warc.parse_archive(gzip.decompress(f.read_bytes())):
            assert int(fields["content-length"]) == len(block)
            kinds[fields["warc-type"]] += 1
    assert kinds["request"] == kinds["metadata"] == len(PAGES) == kinds["response"] + kinds["revisit"]


@pytest.mark.parametrize("step", [1, 7, 4096])
def test_archives_are_read_in_parts(step):
    blocks = [b"", b"a", b"\r\n\r\nWARC/1.1\r\n\r\n", b"x" * 5000]
    records = [warc._record("metadata", f"id{i}", [], b) .encode() for i, b in enumerate(blocks)]
    plain = b"".join(r + b"\r\n\r\n" for r in records)
    members = b"".join(gzip.compress(r + b"\r\n\r\n") for r in records)
    for data in (plain, gzip.compress(plain), members):
        whole = b"".join(warc.gunzip(data, step))
        assert whole == plain
        got = list(warc.parse_archive(whole[i : i + step] for i in range(0, len(whole), step)))
        assert [b for *_, b in got] == blocks and [whole[a : a + 5] for a, *_ in got] == [b"WARC/"] * 4
    for cut in (10, len(plain) - 3000):
        with pytest.raises(ValueError):
            list(warc.parse_archive([plain[:cut]]))
    assert warc.warc_fields(b"fetchedBytes: 12\r\nno field\r\nvia: http://x/\r\n") == {"fetchedbytes": "12", "via": "http://x/"}


def test_no_pages(spark, tmp_path):
    assert captures(spark, [], str(tmp_path / "w")) == []


def test_targets_reshare_the_excess():
    # 150 % of 260 words; a stops at 20, b at 200, then c and d share the rest by weight
    got = mixing.targets([10, 100, 100, 50, 0], [5, 2, 1, 5, 2], 1.5, 2.0)
    assert abs(sum(got) - 390) < 1e-9 and got[0] == 20 and got[4] == 0
    assert all(t <= 2 * n + 1e-9 for t, n in zip(got, [10, 100, 100, 50, 0]))


def test_permutation_is_a_bijection():
    for size in (1, 2, 3, 7, 64, 1000, 4097):
        assert sorted(mixing.permute(np.arange(size), size, 9).tolist()) == list(range(size))


def test_draws_add_up_and_are_mixed():
    quota = np.array([1000, 3000, 0, 60])
    total = np.zeros(4, dtype=int)
    for _, first, got in mixing.shard_draws(quota, 200, 3):
        assert (first == total).all()
        total += got
    assert (total == quota).all()


def check_mix(rows, texts):
    size = lambda t: len((t or "").encode().split())
    assert Counter((str(r.doc_id), r["size"]) for r in rows) == Counter((str(i), size(t)) for i, t, _ in texts)
    per = Counter()
    for _, t, s in texts:
        per[s] += size(t)
    names = sorted(per, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([per[s] for s in names], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))], 1.5, 2.0)))
    return per, goal


def test_mix_of_hard_rows(edge_docs, no_docs):
    docs = edge_docs.withColumnRenamed("bucket", "before")
    rows = mixing.taken(mixing.draw(docs)).collect()
    check_mix(rows, [(r[0], r[1], r[3]) for r in doc_rows()])
    assert all(r.taken <= 2 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.taken(mixing.draw(docs.repartition(5))).collect()))
    assert mixing.taken(mixing.draw(no_docs)).count() == 0


def test_mix_meets_its_targets(spark):
    from tests.conftest import SF_SMALL

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    mix = mixing.draw(docs)
    rows = mixing.taken(mix).collect()
    source = {r.doc_id: (r.source, r.text) for r in docs.collect()}
    per, goal = check_mix(rows, [(i, t, s) for i, (s, t) in source.items()])
    got = Counter()
    for r in rows:
        s = source[r.doc_id][0]
        got[s] += r.taken
        assert r.source_size == per[s] and abs(r.target - goal[s]) < 1e-6 and r.taken <= 2 * r["size"]
    assert all(abs(got[s] - goal[s]) <= 0.02 * goal[s] for s in goal)
    mixed = mixing.mixed_documents(docs, mix)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        assert r.n_chars == len(r.text) and set(r.text.split()) <= set(source[r.doc_id][1].split())
        words[r.doc_id] += len(r.text.encode().split())
    assert words == Counter({r.doc_id: r.taken for r in rows if r.taken})


def water_fill(sizes, weights, share, passes):
    """Targets by bisection on the level that all weights share, none above its cap."""
    whole = share * sum(sizes)
    low, high = 0.0, whole + 1.0
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(level * w, passes * n) for n, w in zip(sizes, weights)) < whole:
            low = level
        else:
            high = level
    return [min(high * w, passes * n) for n, w in zip(sizes, weights)]


@pytest.mark.parametrize("slots_per_shard", [7, 1 << 14])
def test_mix_against_its_slots(spark, edge_docs, slots_per_shard):
    """Everything that follows from the drawn slots, done again word by word."""
    block = 4
    rows = [(i, t, s) for i, t, _, s, *_ in doc_rows()] + [(100 + i, "w " * (i % 13), "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    mix = mixing.draw(docs, block=block, slots_per_shard=slots_per_shard)
    slots = [tuple(r) for r in mix.slots.collect()]
    words = [len((t or "").encode().split()) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for n, (*_, s) in zip(words, rows) if s == name) for name in names]
    goal = water_fill(sizes, [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))], 1.5, 2.0)
    # a pass takes no block twice, and passes begin one after the other
    assert len({s[1:] for s in slots}) == len(slots)
    for src, (n, g) in enumerate(zip(sizes, goal)):
        blocks = -(-n // block)
        turns = Counter(t for _, s, t, _ in slots if s == src)
        assert all(0 <= b < blocks for _, s, _, b in slots if s == src)
        assert sum(turns.values()) == (min(2 * blocks, round(g * blocks / n)) if n else 0)
        assert all(turns[t] == blocks for t in range(max(turns, default=0)))
    per_shard = Counter(s[0] for s in slots)
    assert all(per_shard[k] == slots_per_shard for k in range(max(per_shard))) and sum(per_shard.values()) == len(slots)
    # documents lie end to end in their source; what the slots take of each
    at = mix.sources.collect()
    start = {(r.source, r.bucket): (r.src, r.bucket_start, r.source_size, r.target) for r in at}
    uses = Counter((s, b) for _, s, _, b in slots)
    want, spans = [], {}
    for r in mix.placed.collect():
        src, before, size, target = start[(r.source, r.bucket)]
        first = before + r.before
        spans.setdefault(src, []).append((first, first + r["size"]))
        assert size == sizes[src] and abs(target - goal[src]) < 1e-6
        want.append((r.doc_id, r["size"], size, sum(uses[(src, w // block)] for w in range(first, first + r["size"]))))
    for src, parts in spans.items():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] == sizes[src] and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    got = [(r.doc_id, r["size"], r.source_size, r.taken) for r in mixing.taken(mix).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_draws_are_the_same_from_any_task():
    quota = np.array([1000, 3000, 0, 61])
    whole = [(k, f.tolist(), c.tolist()) for k, f, c in mixing.shard_draws(quota, 200, 3)]
    assert [c for *_, c in whole] == [c.tolist() for k in range(len(whole)) for *_, c in mixing.shard_draws(quota, 200, 3, k, k + 1)]
    assert [sum(c) for *_, c in whole[:-1]] == [200] * (len(whole) - 1) and list(mixing.shard_draws(quota * 0, 200, 3)) == []


def test_mix_of_columns_named_like_its_own(spark, edge_docs):
    docs = edge_docs.select("doc_id", "text", "source", *(edge_docs["n_chars"].alias(c) for c in ("_mix_size", "_mix_key", "_mix_bucket", "_mix_before", "_mix_src", "_mix_spans", "c1", "block")))
    plain = edge_docs.select("doc_id", "text", "source")
    got = mixing.mixed_documents(docs, mixing.draw(docs))
    assert got.columns == docs.columns
    want = mixing.mixed_documents(plain, mixing.draw(plain))
    assert sorted(map(str, got.select("doc_id", "text", "source").collect())) == sorted(map(str, want.collect()))
    assert all(r._mix_key == r._mix_size == r.block for r in got.collect())
