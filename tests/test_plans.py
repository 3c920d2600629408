"""End-to-end plans: corpus prep, synthetic production, evaluation; observe counts; callable ids."""

import json

from pyspark.sql import functions as F

from tandem.operators import metrics, model_ops
from tandem.plans import corpus_prep, evaluation, synthetic
from tandem.schema import PAIR, RESPONSE


def _corpus(spark, prefix, n, dup_every=0):
    rows = []
    for i in range(n):
        tgt = f"shared {i % dup_every}" if dup_every and i % 2 else f"{prefix} text {i}"
        rows.append((i, f"{prefix}_s{i:05d}", f"src {prefix} {i}", tgt, prefix, False, None, None))
    return spark.createDataFrame(rows, "ord long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PAIR.fields))


def test_corpus_prep(spark):
    a, b = _corpus(spark, "kim", 300, dup_every=7), _corpus(spark, "har", 100, dup_every=7)
    prep = corpus_prep.prepare(a, b, seed=42)
    combined = prep.combined.collect()
    assert sorted(r.ord for r in combined) == list(range(400))
    # every 'shared k' text survives once, from the first corpus (first wins)
    shared = prep.deduped.where(F.col("tgt_text").startswith("shared")).collect()
    assert len(shared) == 7 and all(r.origin == "kim" for r in shared)
    n = prep.deduped.count()
    assert prep.splits.count() == n // 2
    assert {r.check: r.violations for r in prep.checks.collect()}["ids_in_several_splits"] == 0


def test_synthetic_end_to_end_with_resume_base(spark):
    seeds = _corpus(spark, "kim", 90)
    run = synthetic.plan_requests(spark, seeds, multiplier=1, seed=42)
    assert run.total == 90 and run.plan.count() == 3
    reply = lambda b: json.dumps([{"english": f"E{b}-{i}", "luganda": f"L{b}-{i}"} for i in range(40)])
    resp = spark.createDataFrame([(b, 1, reply(b), None) for b in range(3)], RESPONSE)
    run = synthetic.ingest_replies(run, resp, id_format=lambda n: F.format_string("gem5_s%06d", n), base=0)
    recs = run.records.orderBy("ord").collect()
    assert len(recs) == 90 and recs[0].text_id == "gem5_s000001" and recs[-1].text_id == "gem5_s000090"
    assert recs[0].seed_group == 1 and len(recs[0].derived_from) == 15
    # over-delivery (40 per batch) stops at the target inside batch 2
    assert {r.seed_group for r in recs} == {1, 2, 3} and sum(r.seed_group == 3 for r in recs) == 10
    run.final.write.format("noop").mode("overwrite").save()
    assert synthetic.progress(run) == {"requested": 90, "generated": 90, "removed": 0, "saved": 90}
    sf = {r.batch_id: (r.requested, r.delivered) for r in synthetic.shortfall(run).collect()}
    assert sf == {0: (30, 40), 1: (30, 40), 2: (30, 40)}


def test_observe_counts(spark):
    df = spark.range(100)
    df2, obs = metrics.observe_counts(df, "progress", even=(F.col("id") % 2 == 0))
    df2.write.format("noop").mode("overwrite").save()
    assert obs.get == {"rows": 100, "even": 50}


def test_evaluation_plan_and_conditions(spark):
    pairs = spark.createDataFrame(
        [(i, f"t{i}", f"w{i} x", f"x w{i}", "kim" if i % 3 else "har", c)
         for i in range(30) for c in ("lora_1x", "lora_5x")],
        "ord long, text_id string, src_text string, tgt_text string, origin string, condition string")
    res = evaluation.evaluate(pairs, model_ops.make_echo_model(), tuned=False, run_col="condition", limit=None)
    r = {(x.condition, x.origin): (x.n, x.mean) for x in res.rollup.collect()}
    assert r[("lora_1x", None)] == (30, 1.0)  # the reversed source holds the reference's tokens
    conds = spark.createDataFrame([("lora_1x", "LoRA", "1x", None), ("lora_5x", "LoRA", "5x", None),
                                   ("lora_9x", "LoRA", "9x", "CUDA OOM")],
                                  "condition string, method string, data string, train_error string")
    st = {x.condition: x.status for x in evaluation.condition_summary(res, conds).collect()}
    assert st == {"lora_1x": "complete", "lora_5x": "complete", "lora_9x": "failed"}
    keys = {x.key for x in res.run_metrics.collect()}
    assert {"comet_mean", "comet_mean_kim", "comet_mean_har"} <= keys


def test_same_eval_set(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "2"), ("c", "1"), ("c", "3")],
                               "system string, text_id string")
    got = {r.system: (r.shared, r.extra, r.missing) for r in evaluation.same_eval_set(df, "a").collect()}
    assert got == {"c": (1, 1, 1)}


def test_empty_inputs(spark):
    seeds = _corpus(spark, "kim", 0)
    run = synthetic.plan_requests(spark, seeds)
    assert run.total == 0 and run.plan.count() == 0 and run.sample.count() == 0
    run = synthetic.ingest_replies(run, spark.createDataFrame([], RESPONSE))
    assert run.final.count() == 0 and synthetic.shortfall(run).count() == 0
    prep = corpus_prep.prepare(_corpus(spark, "kim", 0), seed=42)
    assert prep.splits.count() == 0 and prep.crosstab.count() == 0


def test_compare_systems_strict(spark):
    import pytest

    rows = [("a", "1", "o", 0.5), ("a", "2", "o", 0.7), ("b", "1", "o", 0.6), ("b", "2", "o", 0.9)]
    df = spark.createDataFrame(rows, "system string, text_id string, origin string, score double")
    d = {(r.system, r.is_total): r.delta for r in evaluation.compare_systems(df, "a", strict=True).collect()}
    assert d[("b", True)] == 0.15
    bad = df.union(spark.createDataFrame([("b", "3", "o", 1.0)], df.schema))
    with pytest.raises(ValueError):
        evaluation.compare_systems(bad, "a", strict=True)
    assert evaluation.compare_systems(bad, "a").count() == 2


def test_clear_landed_removes_this_applications_tables(spark):
    from tandem.session import clear_landed, exists, landing_path

    # a folder of its own application id: the other tests' landed tables stay
    import tandem.session as session

    own = landing_path(spark, "x").rsplit("/", 1)[0] + "-own"
    before, session._landing_root = session._landing_root, lambda s: own
    try:
        path = landing_path(spark, "gone")
        spark.range(3).write.parquet(path)
        assert exists(spark, path)
        clear_landed(spark)
        assert not exists(spark, path)
    finally:
        session._landing_root = before


def test_results_file_takes_an_evaluation(spark, tmp_path):
    from tandem.sinks import writers

    pairs = spark.createDataFrame([(0, "a_s0001", "w x", "x w", "har", False, None, None)],
                                  "ord long, text_id string, src_text string, tgt_text string, origin string, is_synthetic boolean, derived_from array<string>, seed_group long")
    res = evaluation.evaluate(pairs, model_ops.make_echo_model(), tuned=True)
    writers.write_results_jsonl(res.hypotheses, str(tmp_path / "h"), score_col=None)
    writers.write_results_jsonl(res.scored, str(tmp_path / "s"))
    row = spark.read.json(str(tmp_path / "s")).first().asDict()
    assert set(row) == {"text_id", "luganda", "english", "dataset_origin", "is_synthetic", "derived_from", "seed_group", "hypothesis", "comet"}
    assert row["comet"] == 0.8 and spark.read.json(str(tmp_path / "h")).count() == 1
