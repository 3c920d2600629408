"""Write-once params: accepted, repeated and refused rows (K8)."""

import pytest

from tandem.schema import RUN_PARAMS
from tandem.sinks import tracking


def rows(spark, *kv, order=False):
    data = [("r", "p", "run", k, v) for k, v in kv]
    df = spark.createDataFrame(data, RUN_PARAMS)
    return spark.createDataFrame([(*d, i) for i, d in enumerate(data)], "run_id string, parent_run_id string, run_name string, key string, value string, at long") if order else df


def held(spark, path):
    return sorted(((r.key, r.value) for r in spark.read.parquet(path).collect()), key=str)


def told(df):
    return sorted(((r.key, r.value, r.outcome) for r in df.collect()), key=str)


def test_a_key_keeps_its_first_value(spark, tmp_path):
    path = str(tmp_path / "params")
    assert told(tracking.commit_params(rows(spark, ("lr", "0.1"), ("lr", "0.1"), ("n", "5")), path)) == [("lr", "0.1", "new"), ("n", "5", "new")]
    second = tracking.commit_params(rows(spark, ("lr", "0.2"), ("n", "5"), ("dir", "/a")), path)
    assert told(second) == [("dir", "/a", "new"), ("lr", "0.2", "conflict"), ("n", "5", "same")]
    assert held(spark, path) == [("dir", "/a"), ("lr", "0.1"), ("n", "5")]
    # the same commit once more: nothing is new
    assert {o for *_, o in told(tracking.commit_params(rows(spark, ("n", "5"), ("dir", "/a")), path))} == {"same"}
    assert held(spark, path) == [("dir", "/a"), ("lr", "0.1"), ("n", "5")]


def test_the_first_of_one_commit_counts(spark, tmp_path):
    path = str(tmp_path / "params")
    got = tracking.commit_params(rows(spark, ("dir", "z"), ("dir", "a"), ("dir", "z"), order=True), path, order_col="at")
    assert told(got) == [("dir", "a", "conflict"), ("dir", "z", "new")] and held(spark, path) == [("dir", "z")]
    # without an order the least value
    assert told(tracking.commit_params(rows(spark, ("k", "z"), ("k", "a")), path)) == [("k", "a", "new"), ("k", "z", "conflict")]


def test_strict_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "params")
    tracking.commit_params(rows(spark, ("lr", "0.1")), path)
    with pytest.raises(ValueError):
        tracking.commit_params(rows(spark, ("lr", "0.2"), ("n", "1")), path, strict=True)
    assert held(spark, path) == [("lr", "0.1")]


def test_null_values_and_no_rows(spark, tmp_path):
    path = str(tmp_path / "params")
    assert told(tracking.commit_params(rows(spark), path)) == []
    assert told(tracking.commit_params(rows(spark, ("k", None)), path)) == [("k", None, "new")]
    assert told(tracking.commit_params(rows(spark, ("k", None), ("k", "")), path)) == [("k", "", "conflict"), ("k", None, "same")]
