"""Near-duplicate classes by one-permutation MinHash with optimal densification.

Each text's distinct word shingles are hashed once; the least hash in each of
``bands * rows`` equal ranges is its sketch, and an empty range copies the value
of a range chosen by a universal hash of (range, attempt). Bands of the sketch
name buckets. Texts with equal shingle sets are one class. Within a bucket,
candidate edges form a star around the class that meets the most others over
all its buckets; every edge is confirmed on the full sets. So a large group of
copies costs one edge per copy and bucket, not all pairs.

A star alone would lose a link between two members that its centre does not
reach. The classes of every bucket that the stars leave in several components
are therefore compared by their rarest shingles: two sets of similarity t share
one of the (1 - t) share of each other's rarest, counted among these classes.
A text whose own shingles make up more than that share has no such key and
pairs with nothing, however common the passages that it holds, and a pair whose
first common key stands too late for the threshold is left out. The others are
confirmed on the full sets too, so no link that a bucket shows is lost.

At the default 40 bands of 5, a pair of similarity 0.8 misses every bucket with
probability 1.3e-7. Results by case: null or blank texts have no shingles, are
linked with nothing and kept; a text of fewer words than a shingle has one
shingle, the whole sequence; rows that repeat share a class; a null id joins a
class but never names it. Class ids are 64-bit hashes of the whole set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm import textops as tx
from tandem.llm.components import component_of, connected_components, merge_components
from tandem.llm.tables import land

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending: (flat, offsets)."""
    h, first = tx.word_hashes(buf, offs)
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    acc = h.copy()
    for k in range(1, words):
        m = max(len(h) - k, 0)  # fewer words than a shingle in all the documents
        nxt = np.zeros_like(h)
        nxt[:m] = h[k:]
        same = np.zeros(len(h), dtype=bool)
        same[:m] = doc[k:] == doc[:m]
        # a position whose shingle would leave the document keeps the words it has
        acc = np.where(same, tx.mix(acc * _STEP + nxt), acc)
    left = np.repeat(first[1:], size) - np.arange(len(h))
    begin = np.arange(len(h)) == np.repeat(first[:-1], size)
    use = (left >= words) | (begin & (np.repeat(size, size) < words))
    acc, doc = acc[use], doc[use]
    order = np.lexsort((acc, doc))
    acc, doc = acc[order], doc[order]
    if len(acc):
        new = np.concatenate([[True], (acc[1:] != acc[:-1]) | (doc[1:] != doc[:-1])])
        acc, doc = acc[new], doc[new]
    return acc, np.searchsorted(doc, np.arange(len(size) + 1))


def sketch(flat: np.ndarray, offs: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation sketch of each non-empty set, densified; empty sets give zeros."""
    n = len(offs) - 1
    out = np.zeros((n, bins), dtype=np.uint64)
    doc = np.repeat(np.arange(n), np.diff(offs))
    at = ((flat >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    if len(flat):
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
        out[doc[new], at[new]] = flat[new]
    full = np.zeros((n, bins), dtype=bool)
    full[doc, at] = True
    d, i = np.nonzero(~full & (np.diff(offs) > 0)[:, None])
    attempt = 0
    while len(d):
        attempt += 1
        probe = tx.mix(i.astype(np.uint64) * _STEP + np.uint64(attempt))
        j = (probe >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)
        j = j.astype(np.int64)
        hit = full[d, j]
        out[d[hit], i[hit]] = out[d[hit], j[hit]]
        d, i = d[~hit], i[~hit]
    return out


def band_keys(sk: np.ndarray, bands: int) -> np.ndarray:
    rows = sk.shape[1] // bands
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, (len(sk), bands)).copy()
    for r in range(rows):
        acc = tx.mix(acc * _STEP + sk[:, r::rows][:, :bands])
    return acc


def _set_key(piece: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(piece.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketches(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = tx.buffers(batch.column(1))
            for i, j, data, cuts in tx.slices(buf, offs):
                flat, ends = shingle_sets(data, cuts, words)
                keys = band_keys(sketch(flat, ends, bands * rows), bands).view(np.int64)
                cut = ends.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(np.diff(ends), pa.int64()),
                        pa.array([_set_key(flat[a:b]) if b > a else None for a, b in zip(cut, cut[1:])], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * bands), pa.array(keys.ravel())),
                    ],
                    names=["id", "n_shingles", "class", "keys"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = tx.buffers(batch.column(1))
            for i, j, data, cuts in tx.slices(buf, offs):
                flat, ends = shingle_sets(data, cuts, words)
                cut = ends.tolist()
                rows = [(_set_key(flat[a:b]), flat[a:b].tobytes()) for a, b in zip(cut, cut[1:]) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["class", "members"])

    return run


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, members, component) to one row per shingle."""
    for batch in batches:
        cls, component = (batch.column(k).to_numpy() for k in (0, 2))
        for lo in range(0, batch.num_rows, 256):
            sets = [np.frombuffer(v.as_buffer(), dtype=np.int64) for v in batch.column(1).slice(lo, 256)]
            size = np.array([len(x) for x in sets])
            cols = [np.repeat(c, size) for c in (cls[lo : lo + 256], component[lo : lo + 256], size)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.concatenate(sets))], names=["class", "component", "n", "shingle"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    ok.append(False)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """Per row: id, n_shingles, class (null without shingles), component_id (least id reachable) and kept."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    marked = land(d.mapInArrow(tx.tidy(_sketches(words, bands, rows)), "id long, n_shingles long, class long, keys array<long>"), "oph")
    real = marked.filter("class is not null")
    classes = land(real.groupBy("class").agg(F.first("keys").alias("keys")), "oph_sketches")  # read twice
    members = classes.select("class", F.explode("keys").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("met")).filter("met > 1")
    met = land(members.join(shared, "bucket"), "oph_met")
    # the class that meets the most others over all its buckets is the centre of a bucket's star
    weight = met.groupBy("class").agg(F.sum("met").alias("weight"))
    met = land(met.drop("met").join(weight, "class"), "oph_weighed")
    hub = met.groupBy("bucket").agg(F.max_by("class", F.struct("weight", "class")).alias("hub"))
    buckets = land(met.join(hub, "bucket"), "oph_buckets")
    component = _link(d, marked, buckets, words, percent)
    # least id of each component, told to the classes that need it
    least = real.groupBy("class").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    named = land(component_of(component, least, "class", "component"), "oph_classes")
    many = named.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("size")).filter("size > 1")
    many = named.join(many, "component").select("class", "component_id", "component")
    out = marked.select("id", "n_shingles", "class").join(many, "class", "left")
    out = out.withColumns({"component_id": F.coalesce("component_id", "id"), "component": F.coalesce("component", "class")})
    return out.select(F.col("id").alias(id_col), "n_shingles", "class", "component", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def with_class(docs: DataFrame, text_col: str = "text", words: int = 5, class_col: str = "_oph_class") -> DataFrame:
    """All columns of ``docs`` and the class of the text's shingle set (null without shingles)."""
    cols, at = docs.columns, docs.columns.index(text_col)
    schema = T.StructType([*(T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)), T.StructField("s", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = tx.buffers(batch.column(at))
            keys = []
            for _, _, data, cuts in tx.slices(buf, offs):
                flat, ends = shingle_sets(data, cuts, words)
                cut = ends.tolist()
                keys += [_set_key(flat[a:b]) if b > a else None for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*(f"c{k}" for k in range(batch.num_columns)), "s"])

    return docs.toDF(*[f"c{k}" for k in range(len(cols))]).mapInArrow(tx.tidy(run), schema).toDF(*cols, class_col)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that of the least id; rows without shingles all stay.

    A null id counts as the largest; of rows equal in id and shingle set one stays.
    """
    found = land(near_duplicates(docs, id_col, text_col, words, percent).select(F.col(f"`{id_col}`").alias("id"), "class", "component").filter("class is not null"), "oph_found")
    chosen = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "class")).alias("best")).select("best.id", "best.class")
    copies = found.groupBy("id", "class").agg(F.count("*").alias("n")).withColumnsRenamed({"id": "_id", "class": "_c"})
    chosen = chosen.join(copies, chosen["id"].eqNullSafe(copies["_id"]) & (chosen["class"] == copies["_c"])).select("id", "class", "n")
    p = "_oph"
    while any(c.startswith(p) for c in docs.columns):
        p = "_" + p
    cls, keep_id, keep_class, n = (p + x for x in ("_class", "_keep_id", "_keep_class", "_n"))
    chosen = land(chosen.toDF(keep_id, keep_class, n), "oph_chosen")
    marked = with_class(docs, text_col, words, cls)
    same = marked[f"`{id_col}`"].cast("long").eqNullSafe(chosen[keep_id]) & (marked[cls] == chosen[keep_class])
    kept = marked.join(chosen, same, "left").filter(F.col(cls).isNull() | F.col(keep_class).isNotNull())
    once = kept.filter(F.col(cls).isNull() | (F.col(n) == 1)).drop(cls, keep_id, keep_class, n)
    if chosen.filter(F.col(n) > 1).isEmpty():
        return once
    repeated = kept.filter(F.col(n) > 1).dropDuplicates([keep_id, keep_class]).drop(cls, keep_id, keep_class, n)
    return once.unionByName(repeated)


def _link(d: DataFrame, marked: DataFrame, buckets: DataFrame, words: int, percent: int) -> DataFrame:
    """Components of the classes by confirmed edges (a class without any is left out)."""
    involved = buckets.select("class").distinct()
    owners = marked.join(involved, "class", "left_semi").groupBy("class").agg(F.min("id").alias("id")).filter("id is not null")
    # a class known only by rows without id is read by its text all the same
    nameless = marked.filter("id is null and class is not null").limit(1).count() > 0
    texts = d.join(owners.select("id").distinct(), "id", "left_semi")
    if nameless:
        texts = texts.unionByName(d.filter("id is null"))
    sets = texts.select("id", "text").mapInArrow(tx.tidy(_sets(words)), "class long, members binary").dropDuplicates(["class"])
    sets = land(sets.join(involved, "class", "left_semi"), "oph_sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("class").alias("a"), F.col("members").alias("x"))
        right = sets.select(F.col("class").alias("b"), F.col("members").alias("y"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
        return land(both.mapInArrow(tx.tidy(_confirm(percent)), "a long, b long"), "oph_links")

    star = buckets.filter("class <> hub").select(F.greatest("class", "hub").alias("a"), F.least("class", "hub").alias("b")).distinct()
    links = confirmed(star)
    component = land(connected_components(links), "oph_components")
    # classes of buckets that the stars left in several components
    placed = component_of(component, buckets, "class", "component")
    split = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo <> hi and n > 2").select("bucket")
    rest = land(placed.join(split, "bucket").select("class", "component").distinct(), "oph_rest")
    # two sets that reach the threshold share one of each other's rarest shingles
    each = land(sets.join(rest, "class").mapInArrow(tx.tidy(_explode), "class long, component long, n long, shingle long"), "oph_shingles")
    often = each.groupBy("shingle").agg(F.count("*").alias("often")).filter("often > 1")
    shares = each.join(often, "shingle")
    lone = each.groupBy("class").agg(F.count("*").alias("n")).join(shares.groupBy("class").agg(F.count("*").alias("met")), "class").select("class", (F.col("n") - F.col("met")).alias("lone"))
    prefix = shares.join(lone, "class").withColumn("place", F.row_number().over(W.partitionBy("class").orderBy("often", "shingle")) + F.col("lone"))
    prefix = prefix.filter(F.expr(f"100 * (place - 1) <= {100 - percent} * n"))
    prefix = land(prefix.select("shingle", "class", "component", "n", "place"), "oph_prefix")
    other = prefix.select("shingle", F.col("class").alias("c"), F.col("component").alias("k"), F.col("n").alias("m"), F.col("place").alias("at"))
    # the first key in common has nothing before it in common, which bounds the intersection
    able = f"{100 + percent} * (1 + least(n - place, m - at)) >= {percent} * (n + m)"
    pairs = prefix.join(other, "shingle").filter(f"class > c and component <> k and 100 * least(n, m) >= {percent} * greatest(n, m) and {able}")
    pairs = land(pairs.select(F.col("class").alias("a"), F.col("c").alias("b")).distinct().join(star, ["a", "b"], "left_anti"), "oph_pairs")
    found = confirmed(pairs)
    if not found.isEmpty():
        component = merge_components(component, found)
    return component
