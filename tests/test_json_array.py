"""One JSON array read by byte ranges: exact records and positions wherever the splits lie."""

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tandem.sources import corpus, json_array
from tandem.sources.corpus import read_json_array_corpus

EXTRA = T.StructType([T.StructField("a", T.ArrayType(T.IntegerType())), T.StructField("b", T.StringType())])
SCHEMA = T.StructType([T.StructField("text_id", T.StringType()), T.StructField("english", T.StringType()), T.StructField("derived_from", T.ArrayType(T.StringType())), T.StructField("extra", EXTRA)])


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def read(spark, path):
    df = json_array.parse_records(json_array.read_records(spark, str(path)), SCHEMA)
    return [r.asDict(True) for r in corpus._file_ordered(df).orderBy("ord").collect()]


TEXTS = ["plain", "", "a}b", '{"x": [', "quote \" }", "back\\slash\\", "\\\"}", "line\nbreak }\r\n{", "ünï 中 😀 }", "]", "[}{]", "}" * 30, '"' * 7, "\\" * 9, "w " * 60]


def records(seed, n):
    rng = random.Random(seed)
    return [{"text_id": f"t{i}", "english": rng.choice(TEXTS) + rng.choice(TEXTS), "derived_from": rng.choice([None, [], ["a}", '"']]), "extra": rng.choice([None, {"a": [1, 2], "b": "}{"}, {"a": [], "b": None}])} for i in range(n)]


@pytest.mark.parametrize("indent,ascii_only", [(None, True), (2, False)])
def test_records_over_many_splits(spark, tmp_path, small_splits, indent, ascii_only):
    want = records(1, 60)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_bytes(json.dumps(want, indent=indent, ensure_ascii=ascii_only).encode())
    assert json_array._pieces(spark, str(tmp_path / "a")).rdd.getNumPartitions() > 10
    got = read(spark, tmp_path / "a")
    assert [r["ord"] for r in got] == list(range(len(want)))
    assert [{k: v for k, v in r.items() if k != "ord"} for r in got] == want


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.builds(dict, text_id=st.text(alphabet='ab"\\}{[]:,é\n', max_size=40), english=st.text(alphabet='"\\}', max_size=12)), max_size=8))
def test_any_texts(spark, tmp_path_factory, small_splits, rows):
    folder = tmp_path_factory.mktemp("any")
    (folder / "x.json").write_text(json.dumps(rows))
    assert [(r["text_id"], r["english"]) for r in read(spark, folder)] == [(r["text_id"], r["english"]) for r in rows]


def test_several_files_and_blank_ones(spark, tmp_path, small_splits):
    for name, rows in (("b.json", records(2, 9)), ("a.json", records(3, 5)), ("d.json", [])):
        (tmp_path / name).write_text(json.dumps(rows))
    (tmp_path / "c.json").write_bytes(b"\r\n")
    (tmp_path / "e.json").write_bytes(b"")
    got = read(spark, tmp_path)
    assert [r["english"] for r in got] == [r["english"] for r in records(3, 5) + records(2, 9)]


@pytest.mark.parametrize("text", ['{"text_id": "a"}', "[1, 2]", '[{"text_id": "a"} {"text_id": "b"}]', '[{"text_id": "a"}] tail', '[{"text_id": "a"}', '[{"text_id": "a"}]]', '[[{"text_id": "a"}]]', '[null]', '"x"', '[{"text_id": "a"},]', '[{"text_id": "a}]', '[{"text_id": "a"}][{"text_id": "b"}]', '[{"text_id": "a"}]}', '[]}', "[", "]"])
def test_what_is_no_array_of_records_is_an_error(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception):
        read(spark, tmp_path)


def test_pairs_of_a_corpus_file(spark, tmp_path):
    rows = [{"text_id": f"k_s{i}", "luganda": f"l{i}", "english": f"e{i}", "dataset_origin": "k", "is_synthetic": False, "derived_from": None, "seed_group": None, "more": {"x": 1}} for i in range(5)]
    (tmp_path / "c.json").write_text(json.dumps(rows, indent=2))
    got = read_json_array_corpus(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.ord, r.text_id, r.src_text, r.tgt_text) for r in got] == [(i, f"k_s{i}", f"l{i}", f"e{i}") for i in range(5)]


def test_arrays_grow_in_number_and_their_readers_share_a_file(spark, small_splits, tmp_path):
    """No task writes, and none meets again, more than its array: the writer deals ranges, the file index shuffles nothing."""
    from pyspark.sql import functions as F

    from tandem.sinks import writers

    texts = [f'line {i}\n"}}],[{{' + "x" * (i % 90) for i in range(60)]
    df = spark.createDataFrame([(i, f"d{i}", t) for i, t in enumerate(texts)], "ord long, text_id string, tgt_text string")
    df = df.select("ord", "text_id", F.lit("s").alias("src_text"), "tgt_text", F.lit("o").alias("origin"), F.lit(False).alias("is_synthetic"), F.lit(None).cast("array<string>").alias("derived_from"), F.lit(None).cast("long").alias("seed_group"))
    n = writers.write_json_arrays(df.repartition(5), str(tmp_path / "a"), array_bytes=2500)
    files = sorted((tmp_path / "a").glob("part-*"))
    assert n == len(files) > 3
    assert [r["text_id"] for f in files for r in json.loads(f.read_text(encoding="utf-8"))] == [f"d{i}" for i in range(60)]
    assert max(f.stat().st_size for f in files) < 6_000
    back = read_json_array_corpus(spark, str(tmp_path / "a"))
    assert [(r["ord"], r["text_id"], r["tgt_text"]) for r in back.orderBy("ord").collect()] == [(i, f"d{i}", t) for i, t in enumerate(texts)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = corpus._with_file_index(df.select("ord", F.lit("f").alias("_f")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plan


def test_no_records_are_no_array_or_an_empty_one(spark, tmp_path):
    from tandem.schema import PAIR
    from tandem.sinks import writers

    none = spark.createDataFrame([], T.StructType([T.StructField("ord", T.LongType()), *[f for f in PAIR.fields if f.name != "ord"]]))
    writers.write_json_arrays(none, str(tmp_path / "a"))
    assert read_json_array_corpus(spark, str(tmp_path / "a")).count() == 0
