"""The prefix trie of rebuilt conversations against brute force."""

import hashlib
import random
import zlib

import pytest

from tandem.llm import prefix_trie

DDL = "conv_id long, turn long, role string, text string, depth int, ord long, size string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"0:{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    nodes = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        seq = tuple(own.get(base, [])[:h] + ts[h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append((c, d == len(seq)))
    out = {}
    for seq, members in nodes.items():
        ends = ",".join(str(c) for c, e in sorted(members) if e)
        out[seq] = dict(conv_id=min(c for c, _ in members), depth=len(seq), n_convs=len(members), ends=hashlib.sha256(ends.encode()).hexdigest(), n_children=0, n_leaves=0, saved=0, parent=None)
    for seq in out:
        if seq:
            out[seq[:-1]]["n_children"] += 1
            out[seq]["parent"] = out[seq[:-1]]["conv_id"]
    for seq, n in out.items():
        for d in range(len(seq) + 1):
            out[seq[:d]]["n_leaves"] += n["n_children"] == 0
            out[seq[:d]]["saved"] += (n["n_convs"] - 1) * len(seq[-1][1].encode()) if seq else 0
    return sorted((n["conv_id"], n["depth"], -1 if n["parent"] is None else n["parent"], n["n_convs"], n["n_children"], n["n_leaves"], n["saved"], n["ends"]) for n in out.values())


def found(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], DDL).repartition(parts)
    got = prefix_trie.trie(df).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got)


def conversations(seed, n=60):
    """Conversations that share beginnings, copies, and hard rows."""
    rng = random.Random(seed)
    rows = []
    for c in range(-7, n):
        for t in range(rng.choice([0, 1, 3, 9, 14])):
            shared = t < 9 and rng.random() < 0.8
            rows.append((c, t, ["user", "assistant"][t % 2], f"s{t}" if shared else f"own {rng.randrange(3)} é"))
    rows += [(None, 1, "user", "nobody"), (3, None, "user", "first of all"), (4, None, None, None), (5, 2, None, ""), (5, 2, "", None), (5, 2, "", None), (n + 3, None, None, None)]
    rows += [(c, 0, "user", "") for c in (10**18, -(10**18))]
    rows += [(2, 4, "user", "tie a"), (2, 4, "user", "tie b"), (2, 4, "us", "er" + "tie a")]
    return rows


@pytest.mark.parametrize("seed,parts", [(1, 3), (2, 1)])
def test_nodes_equal_brute_force(spark, seed, parts):
    rows = conversations(seed)
    assert found(spark, rows, parts) == brute(rows)


def test_one_conversation_over_many_partitions(spark, monkeypatch):
    """A long conversation, its copies and a long line of chains; blocks and chunks of a few rows."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 2)
    rows = [(c, t, "user", f"{t % 7}") for c in (0, 5, 10, 11) for t in range(400)]
    rows += [(c, t, "user", "x" if t < c else f"end of {c}") for c in range(20, 60) for t in range(c + 1)]
    assert found(spark, rows, 5) == brute(rows)


def test_sums_of_blocks(spark):
    df = spark.createDataFrame([(k, d, d + k) for k in (1, 2) for d in range(3, 40)], "k int, d long, v long")
    got = {(r.k, r.d): r.v for r in prefix_trie.suffix_sums(df, "k", "d", ["v"], block=4).collect()}
    assert got == {(k, d): sum(x + k for x in range(d, 40)) for k in (1, 2) for d in range(3, 40)}


def test_a_clash_is_seen_and_answered_by_other_maps(spark, monkeypatch):
    """With all turns of the first attempt under one map, nodes of different turns meet; the second attempt is right."""
    plain, tried = prefix_trie._members, []

    def members(conversations, attempt):
        tried.append(attempt)
        if attempt:
            return plain(conversations, 0)
        return plain(conversations, 0).withColumns({"a": prefix_trie.F.lit(7).cast("long"), "b": prefix_trie.F.lit(9).cast("long")})

    monkeypatch.setattr(prefix_trie, "_members", members)
    rows = conversations(3, n=12)
    assert found(spark, rows) == brute(rows) and tried == [0, 1]


def test_no_conversations(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []


def test_query_equals_its_sql(spark):
    import duckdb

    from tandem.llm.oracle import oracles
    from tandem.llm.queries import op11_prefix_trie

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    res = con.execute(oracles()["op11_prefix_trie"])
    names = [d[0] for d in res.description]
    df = op11_prefix_trie(spark, sf)
    assert sorted(df.columns) == sorted(names)
    key = lambda t: tuple(map(str, t))
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=key) == sorted(res.fetchall(), key=key)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()) == brute(rows)
