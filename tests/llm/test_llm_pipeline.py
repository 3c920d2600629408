"""The registered queries, their SQL and the pipeline's stages."""

import math

import duckdb
import pytest

import corpus_pipeline as C
from tandem.llm import mixing, oracle, quality, queries
from tests.conftest import SF_SMOKE
from tests.llm.conftest import DDL, doc_rows

TABLES = ["documents", "embeddings", "pages", "labels", "conversations"]


def norm(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(oracle.oracles()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMOKE}/{t}.parquet')")
    df = queries.queries()[name](spark, SF_SMOKE)
    cols = sorted(df.columns)
    res = con.execute(oracle.oracles()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    key = lambda t: tuple((x is None, str(x)) for x in t)
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=key)
    assert sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key) == want


def test_thirteen_operators_are_registered():
    assert [k.partition("_")[0] for k in queries.queries()] == [f"op{n}" for n in range(1, 14)]
    assert [n for n, _ in C.STAGES] == ["quality_filter", "near_dedup", "source_mix", "bpe"]


def test_stages_equal_brute_force(spark, library):
    docs = spark.read.parquet(f"{SF_SMOKE}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMOKE}/labels.parquet")
    kept = C.quality_filter(spark, docs, SF_SMOKE)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels)).collect() if r.score >= 0.3}
    kept = {r.doc_id: r for r in kept.collect()}
    assert set(kept) == good
    clean = {r.doc_id for r in labels.collect() if r.quality == 1}
    assert len(clean & set(kept)) >= 0.97 * len(clean)

    stage1 = spark.createDataFrame(list(kept.values()), docs.schema)
    alone = {r.doc_id for r in C.near_dedup(spark, stage1, SF_SMOKE).collect()}
    words = {i: r.text.encode().lower().split() for i, r in kept.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in words.items()}
    from tests.llm.test_llm_dedup import union

    ids = sorted(sets)
    comp = union([(a, b) for a in ids for b in ids if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], ids)
    assert alone == {i for i in ids if comp[i] == i}

    stage2 = spark.createDataFrame([kept[i] for i in sorted(alone)], docs.schema)
    mixed = C.source_mix(spark, stage2, SF_SMOKE)
    assert mixed.columns == docs.columns
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.encode().split())
    assert got == {r.doc_id: r.taken for r in mixing.taken(mixing.draw(stage2)).collect() if r.taken}

    stage3 = spark.createDataFrame(mixed.collect(), docs.schema)
    rows = C.encode(spark, stage3, SF_SMOKE).collect()
    texts = [r.text for r in stage3.collect()]
    want = sorted(zip(texts, map(tuple, library(texts))))
    assert sorted((r.decoded, tuple(r.ids)) for r in rows) == want and all(r.n_tokens == len(r.ids) for r in rows)


def test_pipeline_runs_end_to_end(spark):
    out = C.run(spark, SF_SMOKE)
    assert {"doc_id", "source", "ids", "n_tokens", "decoded"} <= set(out.columns) and out.count() > 100


def test_stages_take_hard_rows_and_no_rows(spark, edge_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (edge_docs, no_docs):
        docs = docs.withColumn("_quality_score", docs["size"]).withColumn("_oph_class", docs["size"])
        for name, stage in C.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), stage(spark, docs, str(tmp_path)).schema)
            if name == "quality_filter":
                assert "_quality_score" in docs.columns and docs.count() <= len(doc_rows())
    assert docs.count() == 0 and DDL
