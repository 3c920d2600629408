"""Periodic runs against brute force, and the Z-functions and tiles they are made of."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tandem.llm import queries as q
from tandem.llm import runs
from tests.llm.conftest import doc_rows

WORD = re.compile("[^\\x20\\x09-\\x0d]+")


def brute(words):
    """All runs by comparing the words with themselves shifted, period by period; a stretch's least period counts."""
    n, out = len(words), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if length >= max(6, 4 * p) and not any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, p)):
                out.append((i, p, length))
            i = max(j, i + 1)
    return sorted(out)


def collapse(words, found):
    gone = {i for s, p, n in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 6))
def test_z_function(s, times):
    a = np.array(s * times, dtype=np.int32)
    want = [next((k for k in range(len(a) - i) if a[k] != a[i + k]), len(a) - i) for i in range(len(a))]
    assert runs.z_function(a).tolist() == want


def solved(words):
    """Runs of one text through the tiles, stitched by hand."""
    codes = np.unique(np.array(words, dtype=object), return_inverse=True)[1].astype(np.int32) if words else np.zeros(0, np.int32)
    parts = {}
    for octave, _, at in runs.live_tiles(codes, np.array([0, len(codes)])):
        spread = max(4 * octave, runs._SPREAD)
        for tile in np.unique(at // spread):
            own = at[at // spread == tile]
            low = max(0, int(own[0]) - octave)
            for p, a, b in zip(*runs.solve_tile(codes[low : int(own[-1]) + 4 * octave], octave, own - low)):
                parts.setdefault(int(p), []).append((int(a) + low, int(b) + low))
    out = []
    for p, spans in parts.items():
        spans.sort()
        joined = [list(spans[0])]
        for a, b in spans[1:]:
            if a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        out += [(a, p, b - a + p) for a, b in joined if b - a + p >= max(6, 4 * p)]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_tiles_find_all_runs(data):
    words = []
    for _ in range(data.draw(st.integers(1, 4))):
        block = data.draw(st.lists(st.sampled_from("ab c"), min_size=1, max_size=data.draw(st.sampled_from([2, 5, 40]))))
        words += block * data.draw(st.integers(1, 9))
    words = words[data.draw(st.integers(0, 5)) :]
    assert solved(words) == brute(words)


@pytest.mark.parametrize("period", [1, 2, 15, 16, 17, 31, 32, 33, 100, 128, 257, 700])
def test_long_periods_with_neighbours(period):
    rng = random.Random(period)
    block = [rng.randrange(50 if period > 4 else 3) for _ in range(period)]
    other = [rng.randrange(50) for _ in range(300)]
    words = [str(x) for x in [*other, *(block * 6)[: 5 * period + period // 2], -1, *(block * 4), -2, *(block * 4)[:-1], *other]]
    assert solved(words) == brute(words)


def test_long_texts_of_few_words():
    """Sampled checks of what brute force cannot reach: one word, two words, a fibonacci word."""
    a = ["a"] * 60_000
    assert solved(a) == [(0, 1, 60_000)]
    b = ["a", "b"] * 20_000 + ["a"]
    assert solved(b) == [(0, 2, 40_001)]
    x, y = "a", "ab"
    while len(y) < 700:
        x, y = y, y + x
    assert solved(list(y)) == brute(list(y))


def texts():
    rng = random.Random(3)
    rows = [(i, t) for i, t, *_ in doc_rows() if len(t or "") < 5000]
    for i in range(100, 140):
        block = [rng.choice(["x", "y", "zebra", "ünï"]) for _ in range(rng.choice([1, 2, 3, 7, 20, 45]))]
        words = [*(rng.choice("uvw") for _ in range(rng.randrange(30))), *(block * rng.randrange(2, 9))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows


def want_rows(rows):
    out = []
    for i, t in rows:
        words = WORD.findall(t or "")
        found = brute(words)
        out.append((i, len(words), found, collapse(words, found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("spread", [512, 1])
def test_runs_over_hard_rows(spark, monkeypatch, spread):
    monkeypatch.setattr(runs, "_SPREAD", spread)
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, kind int, body string, row int").repartition(3)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(docs).collect()), key=str)
    assert got == want_rows(rows)


def test_no_documents(spark, no_docs):
    assert runs.periodic_runs(no_docs).count() == 0
    assert runs.with_repeated_tails(no_docs).count() == 0


def test_words_that_clash_by_shape(spark):
    """Two words of 1,024 letters in the Thue-Morse order are different words."""
    bits = [i.bit_count() & 1 for i in range(1024)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    words = [a, b] * 4
    (row,) = runs.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(0, 2, 8)] and row.collapsed == f"{a} {b}"


def test_a_text_longer_than_a_slice(spark):
    words = [f"w{i}" for i in range(150_000)] + [f"v{i % 9001}" for i in range(50_000)] + ["end"]
    (row,) = runs.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(150_000, 9001, 50_000)]
    assert row.collapsed == collapse(words, [(150_000, 9001, 50_000)])


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_repeated_tails(spark):
    rows = [(i, t) for i, t in enumerate(["", None, " a ", "one two three four five six seven"] * 30)] + [(None, "x y")]
    got = runs.with_repeated_tails(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), WORD.findall(r.text or "")) for r in got) == sorted((str(i), planted(i, t)) for i, t in rows)


def test_query_over_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in q.op13_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    seen = 0
    for d in docs:
        words = planted(d.doc_id, d.text)
        if len(words) > 1500:
            continue
        found = brute(words)
        r = got[d.doc_id]
        best = min(found, key=lambda x: (-Fraction(x[2], x[1]), x[0], x[1]), default=None)
        lines = "".join(f"{s},{n},{p}\n" for s, p, n in found)
        assert r.n_runs == len(found)
        assert (r.start, r.period, r.length) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[2] // best[1])
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(words, found).encode()).hexdigest()
        seen += bool(found)
    assert seen > 5
