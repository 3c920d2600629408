"""Model application (M1, M2, K3, N1) and the resumable reply stream."""

import tempfile

from pyspark.sql import functions as F

from tandem.operators import model_ops, replies
from tandem.schema import RESPONSE
from tandem.session import ensure_conf
from tandem.streaming import resume


def test_generator_scorer_and_alignment(spark):
    pairs = spark.createDataFrame(
        [(f"t{i}", f"omu{i} a b c", f"the {i} a b") for i in range(40)], "text_id string, src_text string, tgt_text string")
    p = pairs.select("text_id", F.concat(F.lit("Translate the following from Luganda to English: "), "src_text").alias("prompt"))
    hyps = model_ops.land(model_ops.apply_generator(p, model_ops.make_echo_model(), "prompt", batch_size=8), "h")
    got = dict(hyps.select("text_id", "hypothesis").collect())
    assert got["t3"] == " c b a omu3"
    al = model_ops.align(pairs, hyps)
    s1 = model_ops.apply_scorer(al, model_ops.make_f1_scorer(), ("src", "mt", "ref"), batch_size=8)
    s2 = s1.withColumn("expr", model_ops.token_f1("mt", "ref"))
    assert all(abs(r.score - r.expr) < 1e-12 for r in s2.collect())
    assert model_ops.unmatched(pairs, hyps.where("text_id <> 't5'")).collect()[0].side == "no_hypothesis"


def test_stream_in_pieces_equals_batch(spark):
    ensure_conf(spark)
    root = tempfile.mkdtemp(prefix="tandem-stream-")
    good = lambda xs: '[' + ", ".join(f'{{"english": "{x}", "luganda": "l"}}' for x in xs) + "]"
    part1 = [(0, 1, good(["A", "b"]), None), (1, 1, "bad", None), (2, 1, None, "503")]
    part2 = [(1, 2, good(["a ", "c"]), None), (2, 2, good(["d"]), None)]
    rdir, sink, ck = root + "/replies", root + "/sink", root + "/ckpt"
    spark.createDataFrame(part1, RESPONSE).coalesce(1).write.parquet(rdir)
    resume.run_until_caught_up(spark, rdir, sink, ck)
    first = spark.read.parquet(sink).count()
    spark.createDataFrame(part2, RESPONSE).coalesce(1).write.mode("append").parquet(rdir)
    resume.run_until_caught_up(spark, rdir, sink, ck)
    keys = sorted(r.key for r in spark.read.parquet(sink).select("key").collect())
    batch = replies.accepted_pairs(replies.classify_attempts(spark.createDataFrame(part1 + part2, RESPONSE)))
    want = sorted({r.k for r in batch.select(F.md5(F.lower(F.trim("tgt"))).alias("k")).collect()})
    assert first == 2 and keys == want  # 'a ' duplicates 'A' across the restart
    # a third run with no new files adds nothing
    resume.run_until_caught_up(spark, rdir, sink, ck)
    assert spark.read.parquet(sink).count() == len(want)
    assert sorted(r.batch_id for r in resume.landed_batches(spark, sink).collect()) == [0, 1, 2]


def test_bootstrap_from_partial_marks_batches_done(spark):
    from tandem.plans import synthetic
    from tandem.schema import PAIR

    root = tempfile.mkdtemp(prefix="tandem-boot-")
    partial = spark.createDataFrame(
        [("gem5_s000001", "l", "e", "g", True, ["a"], 1), ("gem5_s000002", "l2", "e2", "g", True, ["a"], 3)], PAIR)
    resume.bootstrap_from_partial(partial, root + "/sink")
    landed = spark.read.parquet(root + "/sink").select((F.col("batch_id") + 1).alias("seed_group"))
    plan = spark.createDataFrame([(b, 30) for b in range(4)], "batch_id long, requested long")
    pending = sorted(r.batch_id for r in synthetic.pending_batches(plan, landed).collect())
    assert pending == [1, 3]


def test_bootstrap_query_takes_half_of_the_batches(spark, monkeypatch):
    from tandem.plans.queries import all_queries
    from tests.conftest import SF_SMALL

    taken, real = [], resume.bootstrap_from_partial

    def keep(partial, path):
        taken.append({r.seed_group for r in partial.select("seed_group").distinct().collect()})
        real(partial, path)

    monkeypatch.setattr(resume, "bootstrap_from_partial", keep)
    got = all_queries()["bootstrap_resume"](spark, SF_SMALL)
    want = all_queries()["synthetic_records"](spark, SF_SMALL)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    from tandem.sources import bindings

    top = bindings.responses(spark, SF_SMALL).agg(F.max("batch_id")).first()[0]
    assert top >= 16 and max(taken[0]) > top // 2 - 3
