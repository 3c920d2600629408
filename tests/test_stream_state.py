"""Streaming state in RocksDB, micro-batches that run again, progress per batch."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from tandem import session
from tandem.schema import RESPONSE
from tandem.sinks import writers
from tandem.streaming import resume


def reply(*targets):
    return json.dumps([{"english": t, "luganda": "l"} for t in targets])


@pytest.fixture
def dirs(tmp_path):
    return [str(tmp_path / x) for x in ("replies", "sink", "ckpt", "progress")]


def add(spark, rows, path):
    spark.createDataFrame(rows, RESPONSE).coalesce(1).write.mode("append").parquet(path)


def rows_of(spark, sink):
    return sorted((r.epoch, r.batch_id, r.tgt) for r in resume.read_pairs(spark, sink).collect())


def replay(ckpt, epoch):
    """As after a crash between a micro-batch's output and its commit."""
    for f in glob.glob(f"{ckpt}/commits/{epoch}") + glob.glob(f"{ckpt}/commits/.{epoch}.crc"):
        os.remove(f)


@pytest.mark.parametrize("dedup", [True, False])
def test_a_micro_batch_run_again_doubles_nothing(spark, dirs, dedup):
    replies, sink, ckpt, progress = dirs
    add(spark, [(0, 1, reply("A", "b"), None), (1, 1, "bad", None)], replies)
    resume.run_until_caught_up(spark, replies, sink, ckpt, dedup=dedup, progress_dir=progress)
    add(spark, [(1, 2, reply(" a", "c"), None), (2, 1, None, "503")], replies)
    resume.run_until_caught_up(spark, replies, sink, ckpt, dedup=dedup, progress_dir=progress)
    want = [(0, 0, "A"), (0, 0, "b"), *([] if dedup else [(1, 1, "a")]), (1, 1, "c")]
    assert rows_of(spark, sink) == want
    replay(ckpt, 1)
    resume.run_until_caught_up(spark, replies, sink, ckpt, dedup=dedup, progress_dir=progress)
    assert rows_of(spark, sink) == want
    plan = spark.createDataFrame([(b, 30) for b in range(3)], "batch_id long, requested int")
    got = sorted(resume.batch_progress(spark, progress, plan).collect())
    assert [tuple(r) for r in got] == [(0, 30, 0, 1, 2), (1, 30, 1, 2, 1 if dedup else 2), (2, 30, None, None, 0)]


def test_state_is_kept_in_rocksdb_across_restarts(spark, dirs):
    replies, sink, ckpt, _ = dirs
    add(spark, [(0, 1, reply("A", "b"), None)], replies)
    resume.run_until_caught_up(spark, replies, sink, ckpt)
    conf = session.state_conf(spark)
    assert all(v.endswith("RocksDBStateStoreProvider") or v == "true" for v in conf.values())
    offsets = open(f"{ckpt}/offsets/0").read()
    assert "RocksDBStateStoreProvider" in offsets
    # changelog files, not snapshots of all state
    assert glob.glob(f"{ckpt}/state/0/*/*.changelog")
    add(spark, [(1, 1, reply("B ", "a", "new"), None)], replies)
    resume.run_until_caught_up(spark, replies, sink, ckpt)
    assert rows_of(spark, sink) == [(0, 0, "A"), (0, 0, "b"), (1, 1, "new")]


def test_another_store_is_refused_on_a_cluster(spark, monkeypatch):
    class Conf(dict):
        def get(self, k, d=None):
            return dict.get(self, k, d)

        set = dict.__setitem__

    class Fake:
        def __init__(self, master, named):
            self.conf = Conf(named)
            self.sparkContext = self
            self.master, self.named = master, named

        def getConf(self):
            return self

        def contains(self, k):
            return k in self.named

    key = next(k for k in session._STATE if k.endswith("providerClass"))
    with pytest.raises(RuntimeError):
        session.state_conf(Fake("spark://x", {key: "org.example.HeapStore"}))
    assert session.state_conf(Fake("local[2]", {key: "org.example.HeapStore"}))[key] == "org.example.HeapStore"
    assert session.state_conf(Fake("spark://x", {})) == session._STATE


def test_no_replies_give_no_pairs(spark, dirs):
    replies, sink, ckpt, progress = dirs
    spark.createDataFrame([], RESPONSE).write.parquet(replies)
    resume.run_until_caught_up(spark, replies, sink, ckpt, progress_dir=progress)
    assert rows_of(spark, sink) == []
    plan = spark.createDataFrame([(0, 7)], "batch_id long, requested int")
    assert [tuple(r) for r in resume.batch_progress(spark, progress, plan).collect()] == [(0, 7, None, None, 0)]


def test_an_epoch_with_fewer_rows_replaces_all_of_its_folder(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_epoch(spark.range(10).repartition(4), path, 3)
    writers.write_epoch(spark.range(2), path, 3)
    writers.write_epoch(spark.range(5), path, 4)
    assert sorted(r["count"] for r in spark.read.parquet(path).groupBy("epoch").count().collect()) == [2, 5]
    assert spark.read.parquet(path).agg(F.sum("id")).first()[0] == 11


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_replies_are_shuffled_once_before_their_parse(spark, tmp_path, monkeypatch):
    """Rendered by batch, a wave or its parse needs no second shuffle of the texts; the waves hold every reply."""
    from tandem.operators import replies
    from tandem.plans import queries_eval
    from tandem.sources import bindings

    sf = str(tmp_path)
    spark.range(900).selectExpr("id doc_id", "'web' source", "concat('line ', id, '\\nrest') text").write.parquet(f"{sf}/documents.parquet")
    first, retries = queries_eval.reply_waves(spark, sf)
    key = lambda r: (r["batch_id"], r["attempt"], r["response_text"], r["error"])
    got = sorted((key(r) for r in first.unionByName(retries).collect()), key=repr)
    assert got == sorted((key(r) for r in bindings.responses(spark, sf).collect()), key=repr)
    landed = []
    monkeypatch.setattr(replies, "land", lambda df, name: landed.append(df) or df)
    replies.classify_attempts(queries_eval.dealt_replies(spark, sf))
    assert [_plan(df).count("Exchange") for df in (first, *landed)] == [1, 1]


def test_finalize_deals_texts_by_batch_once(spark, monkeypatch):
    """The first attempt and the repeated rows of a batch are told in one shuffle; a late or repeated row changes nothing."""
    from tandem.plans import synthetic

    rows = [(b, a, p, f"s{b}", f"t{b}.{a}.{p}", "k", 0) for b in range(4) for a in (2, 3) for p in range(3)]
    landed = spark.createDataFrame([*rows, rows[0], rows[7]], "batch_id long, attempt int, pos long, src string, tgt string, key string, epoch long")
    plans = []
    land = synthetic.land
    monkeypatch.setattr(synthetic, "land", lambda df, name: plans.append(_plan(df)) or land(df, name))
    seeds = spark.createDataFrame([(i, f"x{i}", "s", "t") for i in range(12)], "ord long, text_id string, src_text string, tgt_text string")
    run = synthetic.finalize_from_landed(synthetic.plan_requests(spark, seeds), landed)
    assert sorted(tuple(r) for r in run.pairs.collect()) == [(b, p, f"s{b}", f"t{b}.2.{p}") for b in range(4) for p in range(3)]
    wide = [x for x in plans[0].splitlines() if "Exchange hashpartitioning" in x]
    assert wide and not any("pos#" in x or "attempt#" in x for x in wide)
