"""Reading one large JSON array in parallel.

A JSON array has no line structure, and whether a brace ends a record depends
on everything before it. Spark's text source splits the file by bytes at
closing braces; three passes over these pieces give whole records:

1. every split reports, for itself alone, whether it holds an odd number of
   quotes and how far braces and brackets nest in it, both if it began inside
   a string and if it began outside;
2. a prefix over the splits of a file (one row each) tells each split in which
   state it really begins;
3. every split cuts its records at the closing braces of the array's level; a
   record over several splits leaves pieces, at most two per split, which are
   joined.

No task reads more than its splits, and no record depends on where they lie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_SPLITS = 1_000_000  # rows of the broadcast prefix: one per split (128 MB by default, so 128 TB)

_ESCAPE = re.compile(r"\\.", re.DOTALL)
_FIRST = re.compile(r"[ \t\r\n]*\[[ \t\r\n]*")
_NEXT = re.compile(r"[ \t\r\n]*,[ \t\r\n]*")
_END = re.compile(r"[ \t\r\n]*\][ \t\r\n]*")
_EMPTY = re.compile(r"[ \t\r\n]*\[[ \t\r\n]*\][ \t\r\n]*")
_BLANK = re.compile(r"[ \t\r\n]*")


def _level(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def _segments(piece: str) -> list[str]:
    """The piece cut at its quotes (escaped ones are none): every other part lies inside strings."""
    return (_ESCAPE.sub("", piece) if "\\" in piece else piece).split('"')


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: odd quotes, the change of level if it begins outside / inside a string, and its bytes."""
    now, odd, outside, inside, size = None, False, 0, 0, 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"_f": [now[0]], "_s": [now[1]], "odd": [int(odd)], "outside": [outside], "inside": [inside], "size": [size], "file_size": [now[2]]}, schema=_SPLIT)

    for batch in batches:
        for piece, f, s, file_size in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if now is None or (f, s) != now[:2]:
                if now is not None:
                    yield out()
                now, odd, outside, inside, size = (f, s, file_size), False, 0, 0, 0
            size += len(piece.encode()) + 1
            parts = _segments(piece)
            levels = _level("".join(parts[0::2])), _level("".join(parts[1::2]))
            flip = len(parts) % 2 == 0
            # the brace that ends the piece lies in its last part
            ends = [0, 0]
            ends[(len(parts) - 1) % 2] = 1
            a, b = levels[0] - ends[0], levels[1] - ends[1]
            outside, inside = (outside + b, inside + a) if odd else (outside + a, inside + b)
            odd ^= flip
    if now is not None:
        yield out()


_SPLIT = pa.schema([("_f", pa.string()), ("_s", pa.int64()), ("odd", pa.int32()), ("outside", pa.int64()), ("inside", pa.int64()), ("size", pa.int64()), ("file_size", pa.int64())])
_CUT = "kind int, _f string, _s long, _m long, text string"
_CUT_SCHEMA = pa.schema([("kind", pa.int32()), ("_f", pa.string()), ("_s", pa.int64()), ("_m", pa.int64()), ("text", pa.string())])
_RECORD, _HEAD, _TAIL = 0, 1, 2  # whole; continues a record of an earlier split; is continued


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and pieces of records of every split; anything between records that is no array is an error."""
    now, string, level, held, count, continued = None, False, 0, [], 0, False
    rows: list[tuple] = []

    def broken(piece: str) -> ValueError:
        return ValueError(f"not a JSON array of records: {now[0]} near {piece[:80]!r}")

    def flush() -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CUT_SCHEMA)], schema=_CUT_SCHEMA)
            rows.clear()

    def close() -> None:
        """What is left at the end of a split: a record that the next one continues."""
        if held:
            rows.append((_HEAD if continued else _TAIL, *now, -1 if continued else count, "".join(held)))

    for batch in batches:
        for piece, f, s, in_string, at_level in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (f, s) != now:
                if now is not None:
                    close()
                now, string, level, held, count = (f, s), bool(in_string), at_level, [], 0
                continued = string or level > 1
            if not string and level <= 1 and not held:
                m = (_FIRST if level == 0 else _NEXT).match(piece)
                if not m or not piece.startswith("{", m.end()):
                    whole = _EMPTY.fullmatch(piece) or _BLANK.fullmatch(piece) if level == 0 else _END.fullmatch(piece)
                    if not whole or level < 0:
                        raise broken(piece)
                    level = -1  # nothing may follow
                    continue
                if level < 0:
                    raise broken(piece)
                piece, level = piece[m.end() :], 1
            held.append(piece + "}")
            parts = _segments(piece)
            start = 1 if string else 0
            string ^= len(parts) % 2 == 0
            level += _level("".join(parts[start::2])) - (0 if string else 1)
            if not string and level == 1:
                rows.append((_HEAD if continued else _RECORD, *now, -1 if continued else count, "".join(held)))
                count, continued, held = count + (not continued), False, []
            elif not string and level < 1:
                raise broken(piece)
        yield from flush()
    if now is not None:
        close()
        yield from flush()


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.col("_metadata.file_size").alias("_n"))


def split_states(pieces: DataFrame) -> DataFrame:
    """``_f, _s, in_string, at_level``: how every split begins. Windows hold one row per split of a file.

    A file must end outside strings, with all brackets closed, and not by a
    brace (the text source takes the last piece for one that a brace ended).
    """
    summed = pieces.mapInArrow(_summaries, "_f string, _s long, odd int, outside long, inside long, size long, file_size long")
    file = W.partitionBy("_f")
    before = file.orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    begun = summed.withColumn("in_string", F.coalesce(F.sum("odd").over(before) % 2, F.lit(0)).cast("int"))
    begun = begun.withColumn("change", F.when(F.col("in_string") == 1, F.col("inside")).otherwise(F.col("outside")))
    ends = (F.sum("odd").over(file) % 2 == 0) & (F.sum("change").over(file) == -1) & (F.sum("size").over(file) == F.col("file_size") + 1)
    broken = F.raise_error(F.concat(F.lit("not a JSON array: "), F.col("_f"))).cast("long")
    level = F.when(ends, F.coalesce(F.sum("change").over(before), F.lit(0))).otherwise(broken)
    return begun.select("_f", "_s", "in_string", level.alias("at_level"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``_f, _s, _m, text``: every record of the arrays in ``path`` as JSON text, with the file, split and
    position at which it begins. A file that is not one JSON array of records is an error."""
    from tandem.sinks.writers import land

    pieces = _pieces(spark, path)
    states = land(split_states(pieces), "json-array-splits")
    n = states.count()
    if n > MAX_SPLITS:
        raise ValueError(f"{n} splits: raise spark.sql.files.maxPartitionBytes")
    # at most MAX_SPLITS rows; a shuffled join would lose the order inside a split
    begun = pieces.join(F.broadcast(states), ["_f", "_s"]).select("value", "_f", "_s", "in_string", "at_level")
    cut = land(begun.mapInArrow(_cut, _CUT), "json-array-records")
    parts = cut.where(F.col("kind") != _RECORD)
    order = W.partitionBy("_f").orderBy("_s", F.col("kind"))
    # a tail opens a record; the heads after it belong to it
    numbered = parts.withColumn("_record", F.sum(F.when(F.col("kind") == _TAIL, 1).otherwise(0)).over(order))
    first = F.min(F.struct("_s", "kind", "_m"))
    joined = numbered.groupBy("_f", "_record").agg(F.array_sort(F.collect_list(F.struct("_s", "kind", "text"))).alias("_parts"), first.alias("_first"))
    # a record's pieces: bounded by the record
    stitched = joined.select("_f", F.col("_first._s").alias("_s"), F.col("_first._m").alias("_m"), F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("text"))
    return cut.where(F.col("kind") == _RECORD).select("_f", "_s", "_m", "text").unionByName(stitched)


def parse_records(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Records typed by ``schema``; text that is no such record is an error."""
    parsed = records.withColumn("_r", F.from_json("text", schema, {"mode": "FAILFAST"}))
    return parsed.select("_f", "_s", "_m", "_r.*")
