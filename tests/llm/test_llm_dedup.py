"""Components, near-duplicate texts and vectors, fingerprints: against brute force."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tandem.llm import components, embed, minhash, spotsigs
from tests.llm.conftest import doc_rows


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components_equal_union_find(spark, edges):
    got = {r.vertex: r.component for r in components.connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == union(real, {x for e in real for x in e})


def test_a_long_path_is_one_component(spark):
    n = 60
    got = components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")).collect()
    assert len(got) == n + 1 and {r.component for r in got} == {0}


def word_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    sets = [word_set(t, k) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    comp = union(pairs, range(len(rows)))
    least = {}
    for i, c in comp.items():
        if rows[i][0] is not None:
            least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    return sorted((str(rows[i][0]), len(sets[i]), str(least.get(comp[i]) if sets[i] else rows[i][0])) for i in range(len(rows)))


def near_rows():
    """Chains and groups of near copies whose members are not all alike, and unrelated texts."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(4000)]
    rows, n = [], 0
    for group in (1, 2, 3, 40):
        base = [rng.choice(vocab) for _ in range(120)]
        for _ in range(group):
            w = list(base)
            for _ in range(rng.randrange(0, 8)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((n, " ".join(w)))
            n += 1
    w = [rng.choice(vocab) for _ in range(100)]
    for _ in range(12):  # a chain: each a few words from the last
        w = list(w)
        for _ in range(5):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((n, " ".join(w)))
        n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rows = near_rows()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=k).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_few_bands_still_lose_no_link_in_a_bucket(spark):
    """With one row a band, buckets hold many unrelated texts: stars go on until all is settled."""
    rows = [(i, f"common phrase here {i} {i + 1} x{i}") for i in range(25)] + near_rows()[:20]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2, bands=30, rows=1).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 2)


def test_near_duplicates_of_hard_rows(edge_docs, no_docs):
    rows = [(r[0], r[1]) for r in doc_rows()]
    got = minhash.near_duplicates(edge_docs, words=2).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 2)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_one_row_of_each_group_stays(edge_docs, no_docs):
    left = minhash.drop_near_duplicates(edge_docs, words=2)
    assert left.columns == edge_docs.columns
    ids = [r.doc_id for r in left.collect()]
    # 10 (twice) and 11 and 12 are one group; the rest have texts of their own or no shingles
    assert sorted(map(str, ids)) == sorted(map(str, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, -5, None, None]))
    assert minhash.drop_near_duplicates(no_docs).count() == 0


def vectors():
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for label in (1, 2, None):
        for _ in range(30):
            base = rng.standard_normal(16)
            for noise in (0, 0, 0.05, 0.12, 0.3):
                rows.append((n, [float(x) for x in np.float32(base + noise * rng.standard_normal(16))], label))
                n += 1
    same = [float(x) for x in np.float32(rng.standard_normal(16))]
    rows += [(n + i, same, 1) for i in range(200)]
    n += 200
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] * 16, [1.0, 2.0], [1.0, 2.0]]
    return rows + [(n + i, v, 1) for i, v in enumerate(odd)] + [(None, same, 1)]


def test_vectors_equal_brute_force(spark):
    rows = vectors()
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    pairs = []
    for i in ok:
        for j in ok:
            if j < i and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                    pairs.append((i, j))
    comp, links = union(pairs, range(len(rows))), [0] * len(rows)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    least = {}
    for i, c in comp.items():
        if rows[i][0] is not None:
            least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    want = sorted((str(r[0]), links[i], str(least.get(comp[i]))) for i, r in enumerate(rows))
    got = embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == want
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, class string")
    assert embed.near_duplicates(empty).count() == 0


def test_tables_reach_the_recall_they_promise():
    rng = np.random.default_rng(1)
    a = embed.unit(rng.standard_normal((3000, 64)))
    b = rng.standard_normal((3000, 64))
    b = embed.unit(b - np.einsum("ij,ij->i", a, b)[:, None] * a)
    c = 0.93 * a + np.sqrt(1 - 0.93**2) * b  # cosine exactly at the threshold
    args = (embed.TABLES, embed.HASHES, embed.WIDTH, embed.SEED)
    met = (embed.table_keys(a, *args) == embed.table_keys(c, *args)).any(axis=1)
    assert met.mean() > 0.99


def test_fingerprints_of_hard_rows(edge_docs, no_docs):
    rows = spotsigs.edited_fingerprints(edge_docs).collect()
    assert len(rows) == len(doc_rows()) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.fingerprint for r in [*by[10], *by[11]]} == {by[10][0].fingerprint}
    assert by[2][0].fingerprint == "" == by[3][0].fingerprint and by[5][0].fingerprint != ""
    assert spotsigs.edited_fingerprints(no_docs).count() == 0
    one = spotsigs.edited_fingerprints(edge_docs.filter("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_neighbours_by_descending_id(spark):
    rng = random.Random(2)
    rows = [(i * 7 - 300, f"t{i} " * rng.randrange(0, 5)) for i in range(200)]
    got = {r.doc_id: r.next_text for r in spotsigs.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    rows.sort(reverse=True)
    assert got == {i: rows[(k + 1) % len(rows)][1] for k, (i, _) in enumerate(rows)}


def test_matches_equal_brute_force(spark):
    rows = near_rows()
    prints = spotsigs.fingerprints(spark.createDataFrame([(i, t.replace("w1", "the ")) for i, t in rows], "doc_id long, text string"))
    sets = {}
    for r in prints.collect():
        sets.setdefault(tuple(r.signatures), []).append(r.doc_id)
    ids = {min(v): set(k) for k, v in sets.items()}
    want = {(a, b) for a in ids for b in ids if a < b and ids[a] and ids[b] and len(ids[a] & ids[b]) >= 0.8 * len(ids[a] | ids[b])}
    got = {(r.a, r.b) for r in spotsigs.matches(prints).collect()}
    assert got == want


@pytest.mark.parametrize("text", ["one", "two words", "three short words", "now four short words"])
def test_a_table_of_one_short_text_at_five_words(spark, text):
    docs = spark.createDataFrame([(7, text)], "doc_id long, text string")
    row = minhash.near_duplicates(docs, words=5).first()
    assert (row.n_shingles, row.component_id, row.kept) == (1, 7, True)
    assert [tuple(r) for r in minhash.drop_near_duplicates(docs, words=5).collect()] == [(7, text)]


def test_matches_under_repeated_and_null_ids(spark):
    rows = [(1 if i % 3 else None if i % 2 else i, t.replace("w1", "the ")) for i, t in near_rows()]
    prints = spotsigs.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    names = {}
    for r in prints.collect():
        names.setdefault(frozenset(r.signatures), []).append(r.doc_id)
    big = 1 << 60
    ids = {s: min(big if i is None else i for i in v) for s, v in names.items() if s}
    sets = list(ids)
    alike = [(x, y) for k, x in enumerate(sets) for y in sets[:k] if len(x & y) >= 0.8 * len(x | y)]
    want = sorted(tuple(sorted((ids[x], ids[y]))) for x, y in alike)
    got = sorted((big if r.a is None else r.a, big if r.b is None else r.b) for r in spotsigs.matches(prints).collect())
    assert got == want and any(a == b == 1 for a, b in want) and any(b == big for _, b in want)


def test_texts_of_words_that_clash_by_shape(spark):
    """Words in the Thue-Morse order and their complements, which every polynomial hash modulo 2^64 confuses."""
    bits = [i.bit_count() & 1 for i in range(2048)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    rows = [(1, f"{a} x {a} y {a} z"), (2, f"{b} x {b} y {b} z"), (3, f"{a} x {a} y {a} z"), (4, a), (5, b)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), words=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {1: (5, 1), 2: (5, 2), 3: (5, 1), 4: (1, 4), 5: (1, 5)}
