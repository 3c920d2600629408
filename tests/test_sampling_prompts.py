"""Batch plan, few-shot sampling, prompts and training text."""

from pyspark.sql import functions as F

from tandem.operators import prompts, sampling


def test_batch_plan_goldens(spark):
    for total, n_batches, last in ((16926, 565, 6), (84630, 2821, 30), (1000, 34, 10)):
        p = sampling.batch_plan(spark, total)
        assert p.count() == n_batches
        assert p.where(F.col("batch_id") == n_batches - 1).first().requested == last
        assert p.agg(F.sum("requested")).first()[0] == total


def _seeds(spark, n):
    return spark.createDataFrame([(i * 3, f"s{i:03d}", f"src {i}", f"tgt {i}") for i in range(n)],
                                 "ord long, text_id string, src_text string, tgt_text string")


def test_sample_distinct_exact_count(spark):
    for n_seeds, k_expected in ((200, 15), (64, 15), (20, 15), (15, 15), (14, 14), (1, 1)):
        plan = sampling.batch_plan(spark, 300)
        s = sampling.fewshot_sample(plan, _seeds(spark, n_seeds))
        per = s.groupBy("batch_id").agg(F.count("*").alias("n"), F.count_distinct("text_id").alias("d"),
                                       F.min("rank").alias("lo"), F.max("rank").alias("hi")).collect()
        assert len(per) == 10
        for r in per:
            assert r.n == r.d == k_expected and r.lo == 1 and r.hi == k_expected


def test_sample_reproducible_and_lineage_order(spark):
    plan = sampling.batch_plan(spark, 90)
    a = sampling.fewshot_sample(plan, _seeds(spark, 100))
    b = sampling.fewshot_sample(plan, _seeds(spark, 100).repartition(7))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    lin = {r.batch_id: r.derived_from for r in sampling.lineage_lists(a).collect()}
    for r in a.collect():
        assert lin[r.batch_id][r.rank - 1] == r.text_id


def test_fewshot_prompt_text(spark):
    sample = spark.createDataFrame(
        [(0, 1, "omukazi", "the woman"), (0, 2, "omusajja", "the man"), (1, 1, "enju", "a house")],
        "batch_id long, rank long, src_text string, tgt_text string")
    plan = spark.createDataFrame([(0, 30), (1, 10)], "batch_id long, requested long")
    got = {r.batch_id: r.prompt for r in prompts.fewshot_prompts(sample, plan).collect()}
    assert "Below are 2 real English-Luganda sentence pairs from a curated dataset:\n\n  English: the woman\n  Luganda:  omukazi\n  English: the man\n  Luganda:  omusajja\n\nYour task: generate 30 NEW English-Luganda sentence pairs.\n" in got[0]
    assert "Below are 1 real" in got[1]
    assert "generate 10 NEW English-Luganda sentence pairs" in got[1]
    assert got[0].endswith('{"english": "...", "luganda": "..."}\n]')


def test_prompt_texts_and_completion_split(spark):
    df = spark.createDataFrame([("omusajja", "the man"), ("a\nEnglish: trap", "b")], "src string, tgt string")
    pr, comp = prompts.completion_split(prompts.training_text("src", "tgt", "</s>"))
    out = df.select(
        prompts.zero_shot_prompt("src").alias("z"), prompts.tuned_prompt("src").alias("t"),
        prompts.training_text("src", "tgt", "</s>").alias("x"), pr.alias("p"), comp.alias("c"),
    ).collect()
    assert out[0].z == "Translate the following from Luganda to English: omusajja"
    assert out[0].t == "Translate the following from Luganda to English: omusajja\nEnglish:"
    assert out[0].x == "Translate the following from Luganda to English: omusajja\nEnglish: the man</s>"
    assert (out[0].p, out[0].c) == ("Translate the following from Luganda to English: omusajja\nEnglish:", " the man</s>")
    # the template inside the source: supervision starts after the LAST occurrence
    assert out[1].c == " b</s>"
    nomatch = spark.createDataFrame([("no template",)], "t string")
    p2, c2 = prompts.completion_split(F.col("t"))
    assert nomatch.select(p2, c2).first() == (None, None)


def test_sft_dataset_limit_and_truncation(spark):
    df = spark.createDataFrame([(i, f"id{i}", "w " * 10, "t") for i in range(5)],
                               "ord long, text_id string, src_text string, tgt_text string")
    out = prompts.sft_dataset(df, eos_token="</s>", max_tokens=8, limit=3).collect()
    assert len(out) == 3
    for r in out:
        assert r.n_tokens == 8 and r.completion is None  # template cut off by the token cap
    full = prompts.sft_dataset(df, max_tokens=100).collect()
    assert all(r.completion == " t" for r in full)
