"""Prefix trie of rebuilt conversations, by composable fingerprints.

Conversation c is rebuilt as a head of another conversation (its base) and its
own turns after its own head; no rebuilt text is ever made. A turn stands for
an affine map modulo 2^61 - 1, drawn from the SHA-256 of its role and text; a
sequence of turns is the product of its maps, so the fingerprint of a rebuilt
prefix is composed symbolically: base head, undone own head, own prefix.
Prefixes of one depth and fingerprint are a node. Every member row also carries
the fingerprint of its parent and the SHA-256 of the turn it refers to; a node
whose members differ in either would be two nodes under one fingerprint, in
which case all is done again with other maps, so by induction over the depth
the members of a node have equal turns.

The smallest member of a node owns it, and a conversation owns the nodes of one
stretch of depths: its chain. A chain hangs under a node of its parent chain.
Subtree sums are sums over chains (by doubling the distance to the ancestors,
so their number of rounds is logarithmic) and over the deeper part of a chain
(by blocks of ``BLOCK`` depths).

Turns are sorted by range partitions and scanned where they lie; a conversation
over several partitions is continued by one row per partition, so none is
gathered in a task. A node's list of ending members is hashed as a stream of
chunks that were made in parallel.

Results by case: a null role or text counts as empty; turns are ordered by
turn, null first, equal ones by the SHA-256 of role and text (so repeated rows
are turns of their own); rows without conv_id belong to no conversation;
a conversation is known if it has a row; other columns are not read; no rows
give no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandem.llm import textops as tx
from tandem.llm.tables import land

PRIME = (1 << 61) - 1
HEAD = 8  # longest head that a rebuilt conversation takes
BLOCK = 4096  # depths of a chain that one window sums
CHUNK = 1 << 16  # conversation ids in a chunk of a list
_DIGEST = ["d1", "d2", "d3", "d4"]
_KEY = ["depth", "a", "b"]
_TURN = f"conv_id long, ord long, pa long, pb long, a long, b long, {', '.join(f'{d} long' for d in _DIGEST)}, n_bytes long"
_SCANNED = f"part int, opening long, {_TURN}"
_HEAD_ITEM = ["ord", "pa", "pb", "a", "b", *_DIGEST, "n_bytes"]
_MEMBER = f"conv_id long, depth long, pa long, pb long, a long, b long, {', '.join(f'{d} long' for d in _DIGEST)}, n_bytes long, ends boolean"


def rebuilt_head(conv_id: Column) -> tuple[Column, Column]:
    """(base conversation, turns of its head) that a conversation is rebuilt from: c - c % 5 and crc32(decimal c) % 9."""
    return conv_id - conv_id % 5, F.crc32(conv_id.cast("string").cast("binary")) % (HEAD + 1)


def _turns(conversations: DataFrame, attempt: int) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.lit(f"{attempt}:"), F.octet_length(role).cast("string"), F.lit(":"), role, text)
    found = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.sha2(named, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("digest").asc()]
    return found.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "n_bytes")


def _batch(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    n = len(next(iter(columns.values())))
    arrays = [pa.array(columns[name], kinds[kind]) if name in columns else pa.nulls(n, kinds[kind]) for name, kind in fields]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of the turns of each conversation, as far as they lie in this partition.

    The last row (ord 0) names the partition's first conversation and repeats the product of its last.
    """
    part = TaskContext.get().partitionId()
    opening = now = None
    a, b, k = 1, 0, 0
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        conv = batch.column(0).to_pylist()
        digest = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=">u8").reshape(n, 4)
        scale = (digest[:, 0] % np.uint64(PRIME - 1) + np.uint64(1)).tolist()
        shift = (digest[:, 1] % np.uint64(PRIME)).tolist()
        if opening is None:
            opening = conv[0]
        at = []
        for c, s, t in zip(conv, scale, shift):
            if c != now:
                now, a, b, k = c, 1, 0, 0
            before = a, b
            a, b, k = a * s % PRIME, (b * s + t) % PRIME, k + 1
            at.append((k, *before, a, b))
        columns = dict(zip(("ord", "pa", "pb", "a", "b"), np.array(at, dtype=np.int64).T))
        parts = digest.astype("<u8").view("<i8")
        yield _batch(_SCANNED, part=np.full(n, part, np.int32), conv_id=conv, n_bytes=batch.column(2), **columns, **{d: parts[:, i] for i, d in enumerate(_DIGEST)})
    if opening is not None:
        yield _batch(_SCANNED, part=[part], opening=[opening], conv_id=[now], ord=[0], pa=[k], a=[a], b=[b])


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per partition, ascending: what its first conversation brings from the partitions before."""
    held = None
    for batch in batches:
        for part, opening, conv, k, a, b in zip(*(batch.column(i).to_pylist() for i in range(6))):
            brought = held[1:] if held and held[0] == opening else None
            if brought:
                yield _batch("part int, conv_id long, k0 long, a0 long, b0 long", part=[part], conv_id=[opening], k0=[brought[0]], a0=[brought[1]], b0=[brought[2]])
            if brought and conv == opening:
                k, a, b = brought[0] + k, brought[1] * a % PRIME, (brought[2] * a + b) % PRIME
            held = conv, k, a, b


def _compose(a1: np.ndarray, b1: np.ndarray, a2: np.ndarray, b2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The map of (a1, b1) followed by (a2, b2)."""
    a1, b1, a2, b2 = (x.astype(np.uint64) for x in (a1, b1, a2, b2))
    return tx.mul61(a1, a2).astype(np.int64), tx.fold61(tx.mul61(b1, a2) + b2).astype(np.int64)


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}


def _continued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = _columns(batch)
        for x, y in (("pa", "pb"), ("a", "b")):
            c[x], c[y] = _compose(c["a0"], c["b0"], c[x], c[y])
        c["ord"] = c["ord"] + c["k0"]
        yield _batch(_TURN, **{k: v for k, v in c.items() if k not in ("k0", "a0", "b0")})


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members from own turns: the conversation's map (ga, gb), then the own prefix."""
    for batch in batches:
        c = _columns(batch)
        pa_, pb = _compose(c["ga"], c["gb"], c["pa"], c["pb"])
        a, b = _compose(c["ga"], c["gb"], c["a"], c["b"])
        depth = c["head"] + c["ord"] - c["skip"]
        yield _batch(_MEMBER, conv_id=c["conv_id"], depth=depth, pa=pa_, pb=pb, a=a, b=b, n_bytes=c["n_bytes"], ends=depth == c["size"], **{d: c[d] for d in _DIGEST})


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation: the map that leads from its own prefixes to its rebuilt ones."""
    for batch in batches:
        c = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        ga, gb = [], []
        for ba, bb, oa, ob in zip(c["base_a"], c["base_b"], c["own_a"], c["own_b"]):
            undo = pow(oa, -1, PRIME)  # (oa, ob) undone: x -> (x - ob) / oa
            ga.append(ba * undo % PRIME)
            gb.append((bb - ob) * undo % PRIME)
        yield _batch("conv_id long, skip long, head long, size long, ga long, gb long", conv_id=c["conv_id"], skip=c["skip"], head=c["head"], size=c["size"], ga=ga, gb=gb)


def _members(conversations: DataFrame, attempt: int) -> DataFrame:
    """A row for every rebuilt conversation and depth."""
    scanned = land(_turns(conversations, attempt).mapInArrow(_scan, _SCANNED), "trie_turns")
    borders = scanned.filter("ord = 0").select("part", "opening", "conv_id", F.col("pa").alias("k"), "a", "b")
    carry = land(borders.repartition(1).sortWithinPartitions("part").mapInArrow(_carry, "part int, conv_id long, k0 long, a0 long, b0 long"), "trie_carry")
    # at most one row per partition of the sort
    brought = scanned.filter("ord > 0").drop("opening").join(F.broadcast(carry), ["part", "conv_id"], "left").drop("part")
    brought = brought.withColumns({"k0": F.coalesce("k0", F.lit(0)), "a0": F.coalesce("a0", F.lit(1)), "b0": F.coalesce("b0", F.lit(0))})
    turns = brought.mapInArrow(_continued, _TURN)

    first = F.array_sort(F.collect_list(F.when(F.col("ord") <= HEAD, F.struct(*_HEAD_ITEM))))  # at most HEAD items
    known = land(turns.groupBy("conv_id").agg(F.max("ord").alias("n"), first.alias("items")), "trie_heads")
    base, skip = rebuilt_head(F.col("conv_id"))
    bases = known.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("items").alias("base_items"))
    head = F.least(F.col("skip"), F.coalesce("base_n", F.lit(0)))
    size = F.col("head") + F.greatest(F.col("n") - F.col("skip"), F.lit(0))
    rebuilt = known.withColumns({"base": base, "skip": skip}).join(bases, "base", "left").withColumn("head", head).withColumn("size", size)

    def product(items: str, n: Column, part: str, none: int) -> Column:
        return F.coalesce(F.get(F.col(items), (n - 1).cast("int"))[part], F.lit(none))

    own_n = F.least(F.col("skip"), F.col("n"))
    ends = rebuilt.select(
        "conv_id", "skip", "head", "size", product("base_items", F.col("head"), "a", 1).alias("base_a"), product("base_items", F.col("head"), "b", 0).alias("base_b"), product("items", own_n, "a", 1).alias("own_a"), product("items", own_n, "b", 0).alias("own_b")
    )
    maps = ends.filter("size > head").mapInArrow(_heads, "conv_id long, skip long, head long, size long, ga long, gb long")
    own = turns.join(maps, "conv_id").filter(F.col("ord") > F.col("skip")).mapInArrow(_own, _MEMBER)
    item = F.explode(F.slice("base_items", 1, F.col("head").cast("int"))).alias("item")
    heads = rebuilt.filter("head > 0").select("conv_id", "size", item).select("conv_id", F.col("item.ord").alias("depth"), *(f"item.{c}" for c in _HEAD_ITEM[1:]), (F.col("item.ord") == F.col("size")).alias("ends"))
    zero = F.lit(0).cast("long")
    roots = rebuilt.select("conv_id", zero.alias("depth"), zero.alias("pa"), zero.alias("pb"), F.lit(1).cast("long").alias("a"), zero.alias("b"), *(zero.alias(d) for d in _DIGEST), zero.alias("n_bytes"), (F.col("size") == 0).alias("ends"))
    return own.unionByName(heads).unionByName(roots)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node joined by commas, at most ``CHUNK`` at a time; rows come sorted."""
    key, held = None, []

    def out() -> pa.RecordBatch:
        return _batch("depth long, a long, b long, least long, ids string", depth=[key[0]], a=[key[1]], b=[key[2]], least=[held[0]], ids=[",".join(map(str, held))])

    for batch in batches:
        for *k, conv in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if held and (k != key or len(held) == CHUNK):
                yield out()
                held = []
            key = k
            held.append(conv)
    if held:
        yield out()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks, which come in order."""
    key, state = None, None

    def out() -> pa.RecordBatch:
        return _batch("depth long, a long, b long, ends_sha256 string", depth=[key[0]], a=[key[1]], b=[key[2]], ends_sha256=[state.hexdigest()])

    for batch in batches:
        for *k, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if k != key:
                if key is not None:
                    yield out()
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if key is not None:
        yield out()


def _nodes(members: DataFrame) -> tuple[DataFrame, bool]:
    """Nodes of all members, and whether each holds equal turns."""
    checked = ["pa", "pb", *_DIGEST, "n_bytes"]
    found = members.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.min(c).alias(c) for c in checked), *(F.max(c).alias(f"{c}_max") for c in checked))
    clash = F.lit(False)
    for c in checked:
        clash = clash | (F.col(c) != F.col(f"{c}_max"))
    nodes = land(found.select(*_KEY, "conv_id", "n_convs", "pa", "pb", "n_bytes", clash.alias("clash")), "trie_nodes")
    return nodes.drop("clash"), nodes.filter("clash").isEmpty()


def suffix_sums(df: DataFrame, key: str, order: str, columns: list[str], block: int = BLOCK) -> DataFrame:
    """Each column summed over the rows of the key with this or a greater ``order`` (unique in a key).

    A window sees ``block`` consecutive numbers, and one row of every block of a key.
    """
    marked = df.withColumn("_block", F.floor(F.col(order) / block))
    totals = marked.groupBy(key, "_block").agg(*(F.sum(c).alias(f"_after_{c}") for c in columns))
    after = W.partitionBy(key).orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(key, "_block", *(F.coalesce(F.sum(f"_after_{c}").over(after), F.lit(0)).alias(f"_after_{c}") for c in columns))
    inside = W.partitionBy(key, "_block").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    summed = marked.join(totals, [key, "_block"])
    return summed.select(*(c for c in df.columns if c not in columns), *((F.sum(c).over(inside) + F.col(f"_after_{c}")).alias(c) for c in columns))


def _chain_totals(chains: DataFrame, root: int) -> DataFrame:
    """chain, leaves, saved with those of all chains below; one round for every doubling of the longest line of ancestors."""
    now = chains.select("conv_id", F.col("up").alias("over"), "leaves", "saved")
    while not now.filter("over is not null").isEmpty():
        below = now.filter("over is not null").groupBy(F.col("over").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        farther = now.select(F.col("conv_id").alias("over"), F.col("over").alias("next"))
        # nothing is above the root's chain, under which most chains may hang: their rows need no join
        moved = now.filter(F.col("over") != root).join(farther, "over").select("conv_id", "next", "leaves", "saved")
        still = now.filter(F.col("over").isNull() | (F.col("over") == root)).select("conv_id", F.lit(None).cast("long").alias("next"), "leaves", "saved")
        step = moved.unionByName(still).join(below, "conv_id", "left")
        more = step.select("conv_id", F.col("next").alias("over"), *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")))
        now = land(more, "trie_chains")
    return now.drop("over")


def trie(conversations: DataFrame) -> DataFrame:
    """Nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role and text. n_leaves and
    saved_tokens (each node's members but one times the bytes of its last
    text) are sums over the node's subtree, itself included.
    """
    attempt, right = 0, False
    while not right:
        members = land(_members(conversations, attempt), "trie_members")
        nodes, right = _nodes(members)
        attempt += 1
    order = [F.col(c).asc() for c in (*_KEY, "conv_id")]
    ending = members.filter("ends").select(*_KEY, "conv_id").repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = ending.mapInArrow(_chunks, "depth long, a long, b long, least long, ids string")
    lists = chunks.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_KEY).sortWithinPartitions(*_KEY, "least").mapInArrow(_hashed, "depth long, a long, b long, ends_sha256 string")

    of_parent = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    below = nodes.filter("depth > 0")
    children = below.groupBy(*of_parent).agg(F.count("*").alias("n_children"))
    root = nodes.filter("depth = 0").select("conv_id").collect()  # one row, or none
    if not root:
        return nodes.select("conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("n_children"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.lit("").alias("ends_sha256"))
    top = root[0][0]
    parents = nodes.filter("depth > 0").select(F.col("depth").alias("pd"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    # the root is the parent of all first turns, however many: no join for these
    deep = nodes.filter("depth > 1").withColumn("pd", F.col("depth") - 1).join(parents, ["pd", "pa", "pb"]).drop("pd")
    shallow = nodes.filter("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(top)))
    linked = deep.unionByName(shallow).join(children, _KEY, "left").join(lists, _KEY, "left")
    linked = land(
        linked.select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
        ),
        "trie_linked",
    )
    heads = linked.filter("depth = 0 or parent_conv_id <> conv_id").select("conv_id", F.col("parent_conv_id").alias("up"), (F.col("depth") - 1).alias("place"))
    sums = linked.groupBy("conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    chains = land(heads.join(sums, "conv_id"), "trie_chain")
    totals = _chain_totals(chains, top)
    hung = chains.filter("up is not null").select("conv_id", "up", "place").join(totals, "conv_id").groupBy(F.col("up").alias("conv_id"), F.col("place").alias("depth")).agg(F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    whole = linked.join(hung, ["conv_id", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"hung_{c}", F.lit(0)) for c in ("leaves", "saved")}).drop("hung_leaves", "hung_saved")
    out = suffix_sums(whole, "conv_id", "depth", ["leaves", "saved"])
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")
