"""Lineage checks (N3, N6, V1, V2) and readers / writers."""

import json
import os
import tempfile

from tandem.operators import lineage
from tandem.schema import PAIR, RESPONSE
from tandem.sinks import writers
from tandem.sources import corpus, registry


def _pairs(spark, items):
    return spark.createDataFrame(items, PAIR)


SEEDS = [(f"kim_s{i:05d}", f"l{i}", f"E{i}", "kimrichies2023", False, None, None) for i in range(20)]


def test_lineage_checks(spark):
    syn = [
        ("gem5_s000001", "x", "e3", "gemini_synthetic", True, [f"kim_s{i:05d}" for i in range(15)], 1),
        ("gem5_s000002", "y", "new", "gemini_synthetic", True, ["kim_s00001", "kim_s99999"] + [f"kim_s{i:05d}" for i in range(2, 14)], 1),
        ("gem5_s000003", "", "z", "gemini_synthetic", True, [f"kim_s{i:05d}" for i in range(15)], 0),
    ]
    seeds = _pairs(spark, SEEDS)
    recs = _pairs(spark, syn)
    edges = lineage.lineage_edges(recs)
    assert edges.count() == 44
    assert edges.where("text_id = 'gem5_s000002' AND seed_rank = 2").first().seed_id == "kim_s99999"
    usage = {r.seed_id: r.uses for r in lineage.seed_usage(recs).collect()}
    assert usage["kim_s00001"] == 3 and usage["kim_s99999"] == 1
    assert [r.seed_id for r in lineage.orphan_edges(recs, seeds).collect()] == ["kim_s99999"]
    # 'e3' equals seed 3's target 'E3' after lower/strip, and seed 3 was shown to row 1
    assert [tuple(r) for r in lineage.copied_examples(recs, seeds).collect()] == [("gem5_s000001", "kim_s00003")]
    rep = {r.check: r.violations for r in lineage.invariant_report(seeds.unionByName(recs), seeds, 15).collect()}
    assert rep["synthetic_rows_bad_lineage_size"] == 1  # 14 seeds
    assert rep["synthetic_rows_bad_seed_group"] == 1
    assert rep["lineage_ids_not_in_seeds"] == 1
    assert rep["empty_text"] == 1
    assert rep["human_rows_with_lineage"] == 0 and rep["duplicate_ids"] == 0 and rep["bad_id_format"] == 0


def test_split_checks(spark):
    corpus_df = spark.createDataFrame([(f"t{i}",) for i in range(10)], "text_id string")
    splits = spark.createDataFrame([("t1", "training"), ("t1", "test"), ("t2", "test"), ("zz", "test")],
                                   "text_id string, split string")
    got = {r.check: r.violations for r in lineage.split_checks(splits, corpus_df, expected_total=5).collect()}
    assert got == {"ids_in_several_splits": 1, "split_ids_not_in_corpus": 1, "split_total_off_by": 1}


def test_json_array_corpus_read_keeps_order_and_defaults(spark):
    d = tempfile.mkdtemp(prefix="tandem-test-")
    recs = [{"text_id": f"kim_s{i:05d}", "luganda": f"l{i}", "english": f"e{i}", "dataset_origin": "k",
             "extra": 1} for i in (5, 2, 9)]
    recs[1]["is_synthetic"] = False
    with open(os.path.join(d, "a.json"), "w", encoding="utf-8") as f:
        json.dump(recs, f, ensure_ascii=False, indent=2)
    with open(os.path.join(d, "b.json"), "w") as f:
        f.write("\r\n")  # empty corpus stub: no rows, no error
    df = corpus.read_json_array_corpus(spark, d)
    got = [(r.ord, r.text_id, r.derived_from, r.seed_group) for r in df.orderBy("ord").collect()]
    assert got == [(0, "kim_s00005", None, None), (1, "kim_s00002", None, None), (2, "kim_s00009", None, None)]
    assert df.schema["derived_from"].dataType == PAIR["derived_from"].dataType


def test_jsonl_write_keeps_nulls_and_reads_back_in_order(spark):
    d = tempfile.mkdtemp(prefix="tandem-test-") + "/out"
    items = [(f"kim_s{i:05d}", f"l{i}", f"é{i}", "k", False, None, None) for i in range(50)]
    writers.write_corpus_json(spark.createDataFrame(items, PAIR).coalesce(3), d)
    line = open(sorted(p for p in (os.path.join(d, x) for x in os.listdir(d)) if p.endswith(".json"))[0],
                encoding="utf-8").readline()
    rec = json.loads(line)
    assert rec["derived_from"] is None and "seed_group" in rec and rec["english"].startswith("é")
    back = corpus.read_json_lines_corpus(spark, d)
    got = [r.text_id for r in back.orderBy("ord").collect()]
    assert got == [t[0] for t in items]


def test_read_landed_absent_gives_empty(spark):
    df = corpus.read_landed(spark, "/tmp/tandem-does-not-exist-xyz", RESPONSE)
    assert df.count() == 0 and df.schema == RESPONSE


def test_registry_lookup(spark):
    df = spark.createDataFrame([("llama3",), ("nllb",)], "model string")
    reg = registry.registry(spark)
    got = {r.model: r.path for r in registry.lookup_models(df, reg).collect()}
    assert got == {"llama3": "/models/Llama-3.1-8B", "nllb": None}
    assert [r.model for r in registry.unknown_models(df, reg).collect()] == ["nllb"]


def test_write_batches_overwrites_only_its_batch(spark):
    d = tempfile.mkdtemp(prefix="tandem-test-") + "/b"
    a = spark.createDataFrame([(0, "a"), (1, "b")], "batch_id long, v string")
    writers.write_batches(a, d)
    writers.write_batches(spark.createDataFrame([(1, "c")], "batch_id long, v string"), d)
    assert sorted((r.batch_id, r.v) for r in spark.read.parquet(d).collect()) == [(0, "a"), (1, "c")]


def test_text_artifact_keeps_line_order(spark):
    from tandem.operators import reports

    summ = spark.createDataFrame(
        [("lora_5x", "LoRA", "5x", 0.4741, 16, "complete"), ("lora_1x", "LoRA", "1x", 0.48, 16, "complete")],
        "condition string, method string, data string, comet_mean double, examples long, status string")
    d = tempfile.mkdtemp(prefix="tandem-test-") + "/summary"
    writers.write_text_artifact(reports.summary_lines(summ), d)
    files = sorted(f for f in os.listdir(d) if f.startswith("part-"))
    assert len(files) == 1
    lines = open(os.path.join(d, files[0]), encoding="utf-8").read().splitlines()
    assert lines[0].startswith("Condition  |") and lines[2].startswith("lora_1x    |") and lines[3].startswith("lora_5x")


def test_jsonl_order_survives_file_splits(spark):
    d = tempfile.mkdtemp(prefix="tandem-test-")
    n = 0
    want = []
    for f in ("a.json", "b.json"):  # two files, each split into many tasks
        with open(os.path.join(d, f), "w", encoding="utf-8") as fh:
            for _ in range(400):
                fh.write(json.dumps({"text_id": f"kim_s{n:05d}", "english": "é" * (n % 7), "luganda": "x"}) + "\n")
                want.append(f"kim_s{n:05d}")
                n += 1
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        assert spark.read.json(d).rdd.getNumPartitions() > 4  # the scan really splits the files
        back = corpus.read_json_lines_corpus(spark, d)
        got = [r.text_id for r in back.orderBy("ord").collect()]
        ords = sorted(r.ord for r in back.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want and ords == list(range(800))


def test_combined_corpus_parquet_gets_pair_defaults(spark):
    d = tempfile.mkdtemp(prefix="tandem-test-") + "/combined"
    spark.createDataFrame([("kimrichies2023", "kim_s00001", "hello", "gyebale")],
                          "dataset_origin string, text_id string, english string, luganda string").write.parquet(d)
    r = corpus.read_combined_corpus(spark, d).first()
    assert (r.text_id, r.src_text, r.tgt_text, r.origin) == ("kim_s00001", "gyebale", "hello", "kimrichies2023")
    assert r.is_synthetic is False and r.derived_from is None and r.seed_group is None


def test_malformed_corpus_files_are_errors(spark, tmp_path):
    import pytest

    from tandem.sources import corpus

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "bad.json").write_text('[{"text_id": "x"}, {"text')
    with pytest.raises(Exception):
        corpus.read_json_array_corpus(spark, str(tmp_path / "a")).collect()
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "object.json").write_text('{"text_id": "x"}')
    with pytest.raises(Exception):
        corpus.read_json_array_corpus(spark, str(tmp_path / "o")).collect()
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "bad.jsonl").write_text('{"text_id": "x"}\n{"text_id":\n')
    with pytest.raises(Exception):
        corpus.read_json_lines_corpus(spark, str(tmp_path / "l")).collect()
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "stub.json").write_text("\r\n")
    assert corpus.read_json_array_corpus(spark, str(tmp_path / "e")).count() == 0


def test_csv_keeps_edge_blanks_empty_and_null_texts(spark, tmp_path):
    from tandem.sinks import writers
    from tandem.sources import corpus

    rows = [("o", "a_s0001", " lead", "trail \t"), ("o", "a_s0002", "", 'q " , \n"x"'), (None, "a_s0003", None, "x")]
    df = spark.createDataFrame(rows, "origin string, text_id string, tgt_text string, src_text string").coalesce(1)
    writers.write_combined_csv(df, str(tmp_path / "c"))
    back = corpus.read_combined_corpus(spark, str(tmp_path / "c"), fmt="csv").orderBy("ord").collect()
    assert [(r.origin, r.text_id, r.tgt_text, r.src_text) for r in back] == rows and [r.ord for r in back] == [0, 1, 2]
    from tandem.plans import corpus_prep

    again = corpus.read_combined_corpus(spark, str(tmp_path / "c"), fmt="csv")
    assert sorted(r.ord for r in corpus_prep.combine(again, again).collect()) == [0, 1, 2, 3, 4, 5]


def test_best_epoch_and_early_stop_with_gaps(spark):
    from tandem.operators import metrics

    h = spark.createDataFrame([("c", 1, 2.0), ("c", 3, 2.5), ("c", 5, 1.0), ("c", 7, None), ("c", 9, 3.0), ("d", 1, None)],
                              "condition string, epoch int, eval_loss double")
    assert [tuple(r) for r in metrics.best_epoch(h).collect()] == [("c", 5, 1.0)]
    assert {r.condition: (r.stop_epoch, r.stopped_early) for r in metrics.early_stop(h).collect()} == {"c": (9, True), "d": (1, False)}
