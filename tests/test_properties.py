"""Results do not depend on the shuffle partition count."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMOKE

KEYS = ["dedup_first_wins", "exact_split", "fewshot_sample", "synthetic_records", "batch_shortfall",
        "score_rollup", "early_stop", "corpus_prep_crosstab"]


@pytest.mark.parametrize("name", KEYS)
def test_independent_of_shuffle_partitions(spark, name):
    q = E.queries()[name]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "4", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = q(spark, SF_SMOKE)
            results.append(sorted((tuple(r) for r in df.collect()), key=lambda t: [(x is None, str(x)) for x in t]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]
