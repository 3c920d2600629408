"""Periodic runs of words, and texts with their repetitions collapsed.

A run is a maximal stretch of consecutive words with smallest period q (words q
apart are identical) and at least max(6, 4 q) words. Words are the parts
``[^\\x20\\x09-\\x0D]+`` of a text, numbered from 0 and compared exactly.

Periods are handled by octave, B <= q < 2 B for every power of two B. A document
is laid out in tiles of boundaries B words apart, overlapping by the reach of
a period. Where a run has period q, the B words at a boundary inside it recur
q words later, and so they do at the next boundary; tiles without two such
boundaries (told by rolling hashes) hold nothing of a run and are not
exploded. The others are dealt over all tasks, and each is solved by itself:
the Z-function of the words from a boundary on gives how far every period of
the octave holds ahead, that of the reversed words how far back (periods below
``DIRECT`` compare the shifted tile at once, which is the same). What is found
goes by (document, period) to one place, where overlapping and touching
fragments are stitched; a stitched stretch of sufficient length is a run.

Each row of the input is a document of its own. Results by case: null or empty
texts and texts without words have no runs and collapse to the empty string;
null and repeated ids, repeated rows and ties change nothing, as rows are told
apart by their place; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandem.llm import textops as tx
from tandem.llm.tables import land

LEAST_WORDS, LEAST_PERIODS = 6, 4
DIRECT = 32  # periods below: a tile is compared with itself, shifted
_SPREAD = 512  # words of boundaries in a tile, at least
_GROWTH = 0xD6E8FEB86659FD93
_MADE, _LIVE, _TILE = 0, 1, 2
_DDL = "kind byte, row long, doc_id long, n_words long, body string, octave int, place long, live binary, codes binary"
_SCHEMA = pa.schema([("kind", pa.int8()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("body", pa.string()), ("octave", pa.int32()), ("place", pa.int64()), ("live", pa.binary()), ("codes", pa.binary())])
_FRAGMENT = "row long, period long, low long, high long"


def z_function(s: np.ndarray) -> np.ndarray:
    """z[i]: how many entries from i on equal those from 0 on; z[0] = len(s)."""
    n = len(s)
    z = np.zeros(n, dtype=np.int64)
    if n == 0:
        return z
    z[0] = n
    starts = np.flatnonzero(s[1:] == s[0]) + 1
    at, left, right = 0, 0, 0  # s[left:right] equals the beginning
    while at < len(starts):
        i = int(starts[at])
        if i < right:
            inside, step = int(np.searchsorted(starts, right)), 64
            while at < inside:  # copied from the beginning while the copy ends before the box does
                here = starts[at : min(at + step, inside)]
                value = z[here - left]
                beyond = np.flatnonzero(value >= right - here)
                k = int(beyond[0]) if len(beyond) else len(here)
                z[here[:k]] = value[:k]
                at, step = at + k, 2 * step
                if len(beyond):
                    break
            if at >= inside:
                continue
            i = int(starts[at])
        right = max(right, i)
        right += _common(s, right, right - i)
        z[i], left, at = right - i, i, at + 1
    return z


def _common(s: np.ndarray, i: int, j: int) -> int:
    """Length of the longest common prefix of s[i:] and s[j:], j < i."""
    n, at, step = len(s) - i, 0, 16
    while at < n:
        differ = np.flatnonzero(s[i + at : i + at + step] != s[j + at : j + at + min(step, n - at)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


def live_tiles(codes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(octave, documents, boundaries) that may lie in a run; ``first`` marks the documents in ``codes``.

    A run of period q holds at least n = max(3 q, 6 - q) words that recur q words
    later, so the windows of at least floor((n + 1) / B) - 1 boundaries in a row recur. Boundaries
    from which a stretch of a shorter period reaches 3 B words ahead are left
    out: whatever recurs there is a multiple of that period. Such stretches are
    confirmed word by word, windows by hash only (a tile decides).
    Boundaries are word numbers inside their document, ascending by document.
    """
    size = np.diff(first)
    doc = np.flatnonzero(size >= LEAST_WORDS)
    words, _ = tx.expand(codes, first, doc)
    window = tx.mix(words.astype(np.uint64) + np.uint64(1))
    start = np.concatenate([[0], np.cumsum(size[doc])])
    reach = np.zeros(len(words), dtype=np.int64)  # end of a confirmed stretch that holds this word
    octave, growth = 1, _GROWTH
    while len(doc):
        rows = len(window) // octave
        grid = window[: rows * octave].reshape(rows, octave)
        recur = grid[1:] == grid[:-1, :1]  # boundary j: the window recurs octave + column words later
        if octave > 1:
            at = np.arange(rows - 1) * octave
            recur[reach[at] >= at + 3 * octave] = False
        hit = np.flatnonzero(recur[:-1] & recur[1:])
        order = np.lexsort((hit // octave, hit % octave))
        j, period = (hit // octave)[order], (hit % octave)[order] + octave
        owner = np.searchsorted(start, j * octave, side="right") - 1
        inside = (j + 2) * octave + period <= start[owner + 1]
        j, period, owner = j[inside], period[inside], owner[inside]
        new = np.flatnonzero(np.concatenate([[True], (period[1:] != period[:-1]) | (j[1:] != j[:-1] + 1) | (owner[1:] != owner[:-1])])) if len(j) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(j)))
        least = np.maximum((LEAST_PERIODS - 1) * period[new], LEAST_WORDS - period[new])
        enough = count + 1 >= (least + 1) // octave - 1
        new, count = new[enough], count[enough]
        if len(new):
            rows_of = np.repeat(j[new] - (np.cumsum(count + 1) - (count + 1)), count + 1) + np.arange(int((count + 1).sum()))
            found = np.unique(rows_of) * octave
            owner = np.searchsorted(start, found, side="right") - 1
            yield octave, doc[owner], found - start[owner]
            for a, n, q in zip((j[new] * octave).tolist(), count.tolist(), period[new].tolist()):
                b = a + (n + 1) * octave + q
                if reach[a] < b and np.array_equal(words[a : b - q], words[a + q : b]):
                    np.maximum(reach[a:b], b, out=reach[a:b])
        # windows twice as long, in the documents that can hold a longer period four times
        longer = np.zeros_like(window)
        longer[: len(window) - octave] = window[: len(window) - octave] * np.uint64(growth) + window[octave:]
        octave, growth = 2 * octave, growth * growth & 0xFFFFFFFFFFFFFFFF
        keep = np.flatnonzero(np.diff(start) >= LEAST_PERIODS * octave)
        window, moved = tx.expand(longer, start, keep)
        words, _ = tx.expand(words, start, keep)
        shift = np.repeat(start[keep] - (np.cumsum(moved) - moved), moved)
        reach = tx.expand(reach, start, keep)[0] - shift
        doc = doc[keep]
        start = np.concatenate([[0], np.cumsum(size[doc])])


def solve_tile(codes: np.ndarray, octave: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, low, high): for i in low..high-1, words i and i + period of the tile are equal.

    Only for primitive periods (the repeated block is no power of a shorter
    one); fragments are as long as the tile shows them at its boundaries.
    """
    if octave < DIRECT:
        found = [(q, a, b) for q in range(octave, 2 * octave) for a, b in _shifted(codes, q) if b - a >= 2 * octave and not _power(codes[a : a + q])]
        return tuple(np.array(x, dtype=np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    period, low, high = [], [], []
    for x in live.tolist():
        ahead = z_function(codes[x : x + 4 * octave])
        q = np.flatnonzero(ahead[octave : 2 * octave] >= octave) + octave
        if len(q):
            reach = np.maximum.accumulate(np.arange(1, len(ahead)) + ahead[1:])
            shortest = np.searchsorted(reach, q) + 1  # of the block of q words
            q = q[(shortest >= q) | (q % shortest != 0)]
        if len(q):
            past = codes[max(0, x - octave) : x][::-1]
            ahead_back = codes[x : x + 2 * octave][::-1]
            back = z_function(np.concatenate([past, [-1], ahead_back]))[len(past) + 1 + len(ahead_back) - q]
            period.append(q)
            low.append(x - back)
            high.append(x + np.minimum(ahead[q], 2 * octave))
    if not period:
        return (np.zeros(0, np.int64),) * 3
    return _joined(np.concatenate(period), np.concatenate(low), np.concatenate(high))


def _shifted(codes: np.ndarray, q: int) -> list[tuple[int, int]]:
    """Maximal stretches in which words q apart are equal."""
    edge = np.diff(np.concatenate([[0], (codes[:-q] == codes[q:]).astype(np.int8), [0]])) if len(codes) > q else np.zeros(0, np.int8)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _power(block: np.ndarray) -> bool:
    q = len(block)
    return any(q % d == 0 and np.array_equal(block[d:], block[:-d]) for d in range(1, q // 2 + 1))


def _joined(period: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching fragments of one period made one."""
    order = np.lexsort((high, low, period))
    period, low, high = period[order], low[order], high[order]
    width = int(high.max()) + 2
    reach = np.maximum.accumulate(period * width + high)  # runs over each period by itself
    new = np.flatnonzero(np.concatenate([[True], (period[1:] != period[:-1]) | (period[1:] * width + low[1:] > reach[:-1])]))
    last = np.append(new[1:], len(low)) - 1
    return period[new], low[new], reach[last] - period[new] * width


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without a live tile as they are; the others with their tiles."""
    pack = zstandard.ZstdCompressor(level=1).compress
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        buf, offs = tx.buffers(batch.column(1))
        for i, j, data, cuts in tx.slices(buf, offs):
            start, end, first = tx.word_spans(data, cuts)
            _, codes = tx.distinct_spans(data, start, end, tx.span_hashes(data, start, end))
            codes = codes.astype(np.int32)
            live = np.zeros(j - i, dtype=bool)
            tiles: dict[str, list] = {k: [] for k in ("row", "octave", "place", "live", "codes")}
            for octave, doc, at in live_tiles(codes, first):
                live[doc] = True
                spread = max(4 * octave, _SPREAD)
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] // spread != at[:-1] // spread)]))
                for a, b in zip(new.tolist(), [*new[1:].tolist(), len(at)]):
                    d = int(doc[a])
                    low = max(0, int(at[a]) - octave)
                    high = min(int(first[d + 1] - first[d]), int(at[b - 1]) + 4 * octave)
                    tiles["row"].append(row + d)
                    tiles["octave"].append(octave)
                    tiles["place"].append(low)
                    tiles["live"].append(pack((at[a:b] - low).astype("<i8").tobytes()))
                    tiles["codes"].append(pack(codes[first[d] + low : first[d] + high].astype("<i4").tobytes()))
            n = j - i
            body, ends = _joined_words(data, cuts, end, first)
            text = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends), pa.py_buffer(body)]).cast(pa.string())
            ids = batch.column(0).slice(i, n)
            yield _rows(n, kind=pa.array(np.where(live, _LIVE, _MADE).astype(np.int8)), row=pa.array(row + np.arange(n)), doc_id=ids, n_words=pa.array(np.diff(first)), body=text)
            if tiles["row"]:
                yield _rows(len(tiles["row"]), kind=pa.array(np.full(len(tiles["row"]), _TILE, np.int8)), **{k: pa.array(v, _SCHEMA.field(k).type) for k, v in tiles.items()})
            row += n


def _rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _SCHEMA], schema=_SCHEMA)


def _joined_words(buf: np.ndarray, offs: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with one space between words: bytes and offsets."""
    keep = ~tx.is_space(buf)
    last = first[1:][first[1:] > first[:-1]] - 1
    between = np.delete(end, last)  # the byte after a word that another follows is white space
    out = buf.copy()
    out[between] = 32
    keep[between] = True
    ends = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum(keep, out=ends[1:])
    return out[keep], ends[offs]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for row, octave, place, live, codes in zip(*(batch.column(k).to_pylist() for k in range(5))):
            period, low, high = solve_tile(np.frombuffer(unpack(codes), "<i4"), octave, np.frombuffer(unpack(live), "<i8"))
            if len(period):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(period), row)), pa.array(period), pa.array(low + place), pa.array(high + place)], names=["row", "period", "low", "high"])


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words that repeat: of every run, only the first period stays."""
    for batch in batches:
        out = []
        for body, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            words = body.split(" ")
            depth = np.zeros(len(words) + 1, dtype=np.int64)
            for run in runs:
                depth[run["start"] + run["period"]] += 1
                depth[run["start"] + run["length"]] -= 1
            out.append(" ".join([w for w, d in zip(words, np.cumsum(depth).tolist()) if d == 0]) if runs else body)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


RUNS = "array<struct<start: long, period: long, length: long>>"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, period, length; ascending) and the collapsed text of every row.

    Documents are read once and landed; only tiles and documents with live
    tiles are shuffled. One document's runs are gathered in one row.
    """
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    made = land(d.mapInArrow(_explode, _DDL), "runs_tiles", compression="zstd")
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = made.filter(F.col("kind") == _TILE).select("row", "octave", "place", "live", "codes").repartition(n, "row", "octave", "place")
    fragments = tiles.mapInArrow(_solve, _FRAGMENT)
    runs = stitch(fragments).groupBy("row").agg(F.sort_array(F.collect_list("run")).alias("runs"))
    texts = made.filter(F.col("kind") == _LIVE).select("row", "doc_id", "n_words", "body")
    none = F.array().cast(RUNS)
    joined = texts.join(runs, "row", "left").select("doc_id", "n_words", "body", F.coalesce("runs", none).alias("runs"))
    collapsed = joined.mapInArrow(_collapse, f"doc_id long, n_words long, runs {RUNS}, collapsed string")
    plain = made.filter(F.col("kind") == _MADE).select("doc_id", "n_words", none.alias("runs"), F.col("body").alias("collapsed"))
    return plain.unionByName(collapsed)


def stitch(fragments: DataFrame) -> DataFrame:
    """row and run (start, period, length): maximal stretches of each (row, period) that are long enough."""
    of = W.partitionBy("row", "period").orderBy("low", "high")
    before = F.max("high").over(of.rowsBetween(W.unboundedPreceding, -1))
    marked = fragments.withColumn("opens", F.when(before >= F.col("low"), 0).otherwise(1))
    numbered = marked.withColumn("stretch", F.sum("opens").over(of.rowsBetween(W.unboundedPreceding, 0)))
    whole = numbered.groupBy("row", "period", "stretch").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    length = F.col("high") - F.col("low") + F.col("period")
    return whole.filter(length >= F.greatest(F.lit(LEAST_WORDS), LEAST_PERIODS * F.col("period"))).select("row", F.struct(F.col("low").alias("start"), F.col("period").alias("period"), length.alias("length")).alias("run"))


def longest_by_period(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties: the smallest start, then period."""

    def better(best: Column, run: Column) -> Column:
        mine, other = run["length"] * best["period"], best["length"] * run["period"]
        return F.when(best.isNull() | (mine > other), run).otherwise(best)  # runs ascend, so the first stays in a tie

    return F.reduce(runs, F.lit(None).cast("struct<start: long, period: long, length: long>"), better)


def with_repeated_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts whose id has crc32(decimal id) % 10 = 0 with their words from a on repeating with period p.

    With g = floor(crc32 / 10) and n words: a = g % n, p = 1 + floor((n - a) / (3 + g % 8)), and
    each word i >= a becomes word a + (i - a) % p. Other texts (also of null ids) stay as they are.
    """
    h = F.crc32(F.col(f"`{id_col}`").cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    # one expression per step, so that Catalyst computes the words once
    cut = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.when(h % 10 == 0, words).alias("words"), g.alias("g"))
    n = F.size("words").cast("long")
    a = F.when(n > 0, F.col("g") % n)
    step = cut.select("doc_id", "text", "words", "g", n.alias("n"), a.alias("a"))
    p = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    step = step.select("doc_id", "text", "words", "n", "a", p.cast("long").alias("p"))
    index = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    moved = F.transform(index, lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return step.select("doc_id", F.when(F.col("n") > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))
