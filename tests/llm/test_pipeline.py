"""The pipeline against a plain version of each stage, and the registered queries."""

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline as pipeline  # noqa: E402
from procyon.llm import bpe, mixing, queries, secrets, toxicity  # noqa: E402

from .test_joins import components, shingles  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = queries.table(spark, SF, "documents").select(*pipeline.COLUMNS)
    kept = docs
    for name, stage in pipeline.STAGES:
        before = kept.collect()
        kept = pipeline.save(stage(spark, kept, SF))
        after = kept.collect()
        if name != "bpe":
            assert tuple(kept.columns) == pipeline.COLUMNS
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, queries.table(spark, SF, "labels"))).where("score >= 0.3").collect()}
            assert {r.doc_id for r in after} == {r.doc_id for r in before} - bad and bad
        elif name == "near_copies":
            sets = {r.doc_id: shingles(r.text, 5) for r in before}
            edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
            label = components(sets, edges)
            assert sorted(r.doc_id for r in after) == sorted({label[i] for i in sets})
        elif name == "secrets":
            assert len(after) == len(before)
            assert not any(secrets.parts_of(r.text) and secrets.parts_of(r.text)[0][1] < 3 for r in after)
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "mixing":
            want = {r.doc_id: r.taken for r in mixing.mix_table(spark.createDataFrame(before), queries.symbol_quality()).collect()}
            got = {}
            for r in after:
                got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.encode().split())
            assert {i: n for i, n in want.items() if n} == {i: n for i, n in got.items() if n}
        else:
            model = bpe.model_of(open(queries.word_bpe()).read())
            texts = {r.doc_id: r.text for r in before}
            import numpy as np

            assert len(after) == len(before)
            for r in after[:200]:
                assert r.ids == np.frombuffer(model.encode(texts[r.doc_id]), "<u4").tolist() and r.n_tokens == len(r.ids)


@pytest.mark.parametrize("name", ["op1_merkle_audit", "op6_host_reputation", "op10_source_mix"])
def test_sql_agrees(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.sql(queries.SQL[name]).df()
    show = lambda df: sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert show(got) == show(want)
