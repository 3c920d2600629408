"""Score aggregates, leaderboard, deltas, run tables, status and summary, history."""

from pyspark.sql import functions as F

from tandem.operators import metrics, reports
from tandem.schema import CONDITION_SUMMARY, RUN_METRICS, RUN_PARAMS, TRAIN_HISTORY
from tandem.sinks import tracking

# Per-row scores of a 5-row zero-shot smoke run (the published recorded values).
SMOKE = [
    ("kimrichies2023", 0.2798581719), ("kimrichies2023", 0.4043230712), ("kimrichies2023", 0.3385119736),
    ("kimrichies2023", 0.3711254895), ("harvard2023", 0.2910547554),
]


def test_rollup_golden_and_null_origin(spark):
    df = spark.createDataFrame(SMOKE, "origin string, score double")
    got = {(r.origin, r.is_total): (r.n, r.mean) for r in metrics.score_rollup(df).collect()}
    assert got[(None, True)] == (5, 0.336975)
    assert got[("harvard2023", False)] == (1, 0.291055)
    assert got[("kimrichies2023", False)] == (4, 0.348455)
    # a null origin counts in the overall mean only
    df2 = spark.createDataFrame(SMOKE + [(None, 1.0)], "origin string, score double")
    got2 = {(r.origin, r.is_total): r.n for r in metrics.score_rollup(df2).collect()}
    assert got2 == {(None, True): 6, ("harvard2023", False): 1, ("kimrichies2023", False): 4}


def test_leaderboard_and_delta_golden(spark):
    # published per-origin means: zero-shot Aya vs fine-tuned 5x (one row per cell)
    cells = [("aya", "all", 0.325), ("aya", "harvard", 0.327), ("aya", "kim", 0.324), ("aya", "mak", 0.327),
             ("5x", "harvard", 0.615), ("5x", "kim", 0.610), ("5x", "mak", 0.566)]
    df = spark.createDataFrame(cells, "system string, origin string, score double")
    lb = {r.system: r for r in reports.leaderboard(df, origins=["harvard", "kim", "mak"]).collect()}
    assert lb["5x"].harvard == 0.615 and lb["aya"].mak == 0.327
    r = metrics.score_rollup(df.where(F.col("origin") != "all"), by=["system"])
    d = {(x.origin, x.is_total): x.delta for x in reports.delta_vs_baseline(r, "aya").collect()}
    assert d[("harvard", False)] == 0.288 and d[("kim", False)] == 0.286 and d[("mak", False)] == 0.239


def test_summary_table_golden(spark):
    summ = spark.createDataFrame(
        [("lora_5x", "LoRA", "5x", 0.4741, 16, "complete"), ("lora_1x", "LoRA", "1x", 0.48, 16, "complete"),
         ("lora_9x", "LoRA", "9x", None, 16, "trained_eval_failed")],
        CONDITION_SUMMARY)
    lines = [r.line for r in reports.summary_lines(summ).orderBy("line_no").collect()]
    assert lines == [
        "Condition  | Method | Data | COMET  | Examples | Status",
        "-----------|--------|------|--------|----------|--------",
        "lora_1x    | LoRA   | 1x   | 0.4800 | 16       | complete",
        "lora_5x    | LoRA   | 5x   | 0.4741 | 16       | complete",
        "lora_9x    | LoRA   | 9x   |   -    | 16       | trained_eval_failed",
    ]


def test_condition_status(spark):
    st = spark.createDataFrame(
        [("ok", "LoRA", "1x", 16, 16, 16, 0.5, None, None),
         ("noscore", "LoRA", "5x", 16, 16, 0, None, None, None),
         ("evalerr", "LoRA", "5x", 16, 16, 16, 0.4, None, "RuntimeError('x')"),
         ("trainerr", "LoRA", "5x", 16, 0, 0, None, "OOM " * 100, None)],
        "condition string, method string, data string, examples long, n_hypotheses long, n_scored long, "
        "comet_mean double, train_error string, eval_error string")
    got = {r.condition: (r.status, r.error) for r in reports.condition_status(st).collect()}
    assert got["ok"] == ("complete", None)
    assert got["noscore"][0] == "trained_eval_failed"
    assert got["evalerr"][0] == "trained_eval_failed"
    assert got["trainerr"][0] == "failed" and len(got["trainerr"][1]) == 250


def test_param_conflicts(spark):
    p = spark.createDataFrame(
        [("r1", None, "r1", "learning_rate", "0.0002"), ("r1", None, "r1", "learning_rate", "0.0002"),
         ("r1", None, "r1", "output_dir", "/a"), ("r1", None, "r1", "output_dir", "/b"),
         ("r2", None, "r2", "output_dir", "/a")],
        RUN_PARAMS)
    got = [(r.run_id, r.key, r.n_values, r.n_logs) for r in tracking.param_conflicts(p).collect()]
    assert got == [("r1", "output_dir", 2, 2)]


def test_best_epoch_and_early_stop(spark):
    h = spark.createDataFrame(
        [("tie", 1, 3.0), ("tie", 2, 2.0), ("tie", 3, 2.0), ("tie", 4, 2.5), ("tie", 5, 1.0),
         ("never", 1, 1.0), ("never", 2, 1.5), ("never", 3, 1.2), ("never", 4, 0.5),
         ("improving", 1, 3.0), ("improving", 2, 2.0), ("improving", 3, 1.0)],
        TRAIN_HISTORY)
    best = {r.condition: (r.epoch, r.eval_loss) for r in metrics.best_epoch(h).collect()}
    assert best == {"tie": (5, 1.0), "never": (4, 0.5), "improving": (3, 1.0)}
    best3 = {r.condition: r.epoch for r in metrics.best_epoch(h.where("epoch <= 3")).collect()}
    assert best3["tie"] == 2  # equal losses: the earliest epoch
    stop = {r.condition: (r.stop_epoch, r.stopped_early) for r in metrics.early_stop(h).collect()}
    # tie: 3 (no strict gain) and 4 -> stop at 4; never: 2, 3 -> stop at 3
    assert stop == {"tie": (4, True), "never": (3, True), "improving": (3, False)}
    assert {r.condition: r.stop_epoch for r in metrics.early_stop(h, epoch_budget=2).collect()}["tie"] == 2


def test_batch_delivery_running_totals(spark):
    plan = spark.createDataFrame([(0, 30), (1, 30), (2, 6)], "batch_id long, requested long")
    pairs = spark.createDataFrame([(0,)] * 30 + [(2,)] * 8, "batch_id long")
    got = [tuple(r) for r in metrics.batch_delivery(plan, pairs).orderBy("batch_id").collect()]
    assert got == [(0, 30, 30, 0, 30), (1, 30, 0, 30, 30), (2, 6, 8, -2, 38)]


def test_crosstab_and_breakdown(spark):
    df = spark.createDataFrame([("a", "training"), ("a", "test"), ("b", "training")], "origin string, split string")
    ct = {r.origin: tuple(r)[1:] for r in metrics.split_crosstab(df).collect()}
    assert ct == {"a": (1, 0, 1, 0), "b": (1, 0, 0, 0)}
    sb = {(r.origin, r.is_total): r.n for r in metrics.source_breakdown(df).collect()}
    assert sb == {("a", False): 2, ("b", False): 1, (None, True): 3}


def test_run_tables_follow_their_schemas(spark):
    df = spark.createDataFrame(SMOKE, "origin string, score double").withColumn("system", F.lit("llama3"))
    r = metrics.score_rollup(df, by=["system"])
    m = tracking.metrics_from_rollup(r)
    p = tracking.params_from_rollup(r)
    assert [(f.name, f.dataType) for f in m.schema] == [(f.name, f.dataType) for f in RUN_METRICS]
    assert [(f.name, f.dataType) for f in p.schema] == [(f.name, f.dataType) for f in RUN_PARAMS]
    got = {x.key: x.value for x in m.collect()}
    assert got["comet_mean"] == 0.336975 and got["comet_mean_harvard2023"] == 0.291055
