"""Models and scorers that raise: errors as data, per run."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.operators import model_ops, reports
from tandem.plans import evaluation


def _models():
    """Functions made here travel to the workers by value."""

    def upper():
        def predict(texts):
            if any(t == "bad" for t in texts):
                raise ValueError("bad text")
            return [t.upper() for t in texts]

        return predict

    def unloadable():
        raise OSError("no weights")

    def short():
        return lambda texts: [t for t in texts][:-1]

    def scorer_that_refuses():
        score = model_ops.make_f1_scorer()()

        def predict(src, mt, ref):
            if any("w7 " in s for s in src):
                raise ValueError("refused")
            return score(src, mt, ref)

        return predict

    return upper, unloadable, short, scorer_that_refuses


upper, unloadable, short, scorer_that_refuses = _models()


def test_a_batch_that_raises_costs_its_rows_only(spark):
    rows = [(i, "bad" if i in (3, 8) else f"t{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "i int, t string").coalesce(1)
    for size in (1, 4):
        got = {r.i: (r.value, r.why) for r in model_ops.apply_caught(df, upper, ("t",), "value", "why", batch_size=size).collect()}
        hit = {i for i in range(12) if any(b // size == i // size for b in (3, 8))}
        assert got == {i: (None, "ValueError('bad text')") if i in hit else (t.upper(), None) for i, t in rows}


def test_batches_never_mix_runs(spark):
    rows = [(i, ["a", "b", "c", None][i % 4], "bad" if i % 4 == 1 else f"t{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "i int, run string, t string").coalesce(1)
    got = {r.i: (r.value, r.error) for r in model_ops.apply_caught(df, {"a": upper, "b": upper, "c": unloadable, None: short}, ("t",), "value", batch_size=3, run_col="run").collect()}
    for i, run, t in rows:
        want = {"a": (t.upper(), None), "b": (None, "ValueError('bad text')"), "c": (None, "OSError('no weights')"), None: (None, got[i][1])}[run]
        assert got[i] == want
    assert all("outputs for" in got[i][1] for i, run, _ in rows if run is None)


def test_no_rows(spark):
    df = spark.createDataFrame([], "i int, t string")
    assert model_ops.apply_caught(df, unloadable, ("t",), "v", return_type=T.DoubleType()).count() == 0


def test_one_failed_condition_leaves_the_others(spark, tmp_path):
    runs = ("lora_1x", "lora_2x", "lora_3x", "lora_5x")
    pairs = spark.createDataFrame(
        [(i, f"t{i}", f"w{i} x", f"x w{i}", "kim" if i % 3 else "har", c) for i in range(30) for c in runs],
        "ord long, text_id string, src_text string, tgt_text string, origin string, condition string").repartition(3)
    echo, f1 = model_ops.make_echo_model(), model_ops.make_f1_scorer()
    res = evaluation.evaluate(
        pairs, {"lora_1x": echo, "lora_2x": echo, "lora_3x": unloadable, "lora_5x": echo},
        {"lora_1x": f1, "lora_2x": scorer_that_refuses, "lora_3x": f1, "lora_5x": f1},
        run_col="condition", catch_errors=True, results_dir=str(tmp_path))
    about = [(c, "LoRA", c[5:], "stopped" if c == "lora_9x" else None, 30) for c in (*runs, "lora_9x")]
    conditions = spark.createDataFrame(about, "condition string, method string, data string, train_error string, examples long")
    got = {r.condition: (r.status, r.comet_mean, r.examples, r.error) for r in evaluation.condition_summary(res, conditions).collect()}
    assert got == {
        "lora_1x": ("complete", 1.0, 30, None), "lora_5x": ("complete", 1.0, 30, None),
        "lora_2x": ("trained_eval_failed", None, 30, "ValueError('refused')"),
        "lora_3x": ("failed", None, 30, "OSError('no weights')"), "lora_9x": ("failed", None, 30, "stopped")}
    # hypotheses of the run that could not be scored stay; it has no metrics
    kept = {r.condition: (r.h, r.s) for r in res.scored.groupBy("condition").agg(F.count("hypothesis").alias("h"), F.count("score").alias("s")).collect()}
    assert kept == {"lora_1x": (30, 30), "lora_5x": (30, 30), "lora_2x": (30, 0)}
    assert {r.run_id for r in res.run_metrics.collect()} == {"lora_1x", "lora_5x"}
    assert spark.read.parquet(str(tmp_path / "hypotheses")).count() == 120


def test_summaries_are_collected(spark):
    one = spark.createDataFrame([("b", "LoRA", "1x", 0.5, 3, "complete", None)], "condition string, method string, data string, comet_mean double, examples long, status string, error string")
    two = one.withColumn("condition", F.lit("a"))
    both = evaluation.collect_summaries([one, two])
    assert sorted(r.condition for r in both.collect()) == ["a", "b"]
    lines = [r.line for r in reports.summary_lines(both).orderBy("line_no").collect()]
    assert lines[2].startswith("a ") and lines[3].startswith("b ") and "0.5000" in lines[3]
    with pytest.raises(ValueError):
        evaluation.collect_summaries([])


def test_a_model_per_run_needs_its_run(spark):
    df = spark.createDataFrame([(0, "t", "s", "e", "o")], "ord long, text_id string, src_text string, tgt_text string, origin string")
    with pytest.raises(ValueError):
        evaluation.evaluate(df, {"a": upper})
    with pytest.raises(ValueError):
        evaluation.evaluate(df, upper, catch_errors=True)
