"""Run a few order-dependent operators with an injected task failure (retried).

Invoked by tests/test_faults.py in a separate process: it needs its own
SparkContext with task retries (``local[4,4]``). Prints one JSON line of
results for a clean and a faulty run.
"""

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import TaskContext  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tandem.operators import dedup, ranking  # noqa: E402
from tandem.sources import bindings as B  # noqa: E402


def flaky(it):
    ctx = TaskContext.get()
    for pdf in it:
        if ctx.partitionId() == 0 and ctx.attemptNumber() == 0:
            raise RuntimeError("injected task failure")
        yield pdf


def run(spark, sf_dir, fail):
    docs = B.docs_pairs(spark, sf_dir).repartition(4, "ord")
    if fail:
        docs = docs.mapInPandas(flaky, docs.schema)
    out = {}
    out["dedup"] = sorted(r.text_id for r in dedup.dedup_first_wins(docs).collect())
    out["split"] = sorted(tuple(r) for r in ranking.exact_split(docs.select("text_id", "origin")).select("text_id", "split").collect())
    idx = ranking.global_index(docs.select("ord", "text_id"), [F.col("ord")], F.shiftright("ord", 3), out="i")
    out["index"] = sorted(tuple(r) for r in idx.select("text_id", "i").collect())
    # the whole synthetic path (sampling checkpoint, landed parses and pairs,
    # numbering, dedup) over a documents binding whose first task attempt fails
    import __spark_entry__ as E

    original = B.docs_pairs
    try:
        if fail:
            B.docs_pairs = lambda s, d: original(s, d).repartition(4, "ord").mapInPandas(flaky, original(s, d).schema)
        recs = E.queries()["synthetic_records"](spark, sf_dir)
        out["synthetic"] = sorted(tuple(r) for r in recs.collect())
    finally:
        B.docs_pairs = original
    return out


if __name__ == "__main__":
    spark = (SparkSession.builder.master(os.environ.get("FAULT_MASTER", "local[4,4]")).config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "4").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    sf = sys.argv[1]
    clean, faulty = run(spark, sf, False), run(spark, sf, True)
    print(json.dumps({"same": clean == faulty, "n": {k: len(v) for k, v in clean.items()}}))
