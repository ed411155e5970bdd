"""Whitening against numpy over the whole table and over hand-made rows."""

import math

import numpy as np
import pytest

from procyon.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, key string, x string"


def plain(rows, scale=64.0, shift=1_000_000, most=16, copies=False):
    """(vec_id, component) -> row, by exact integers and one covariance of all distinct vectors."""
    used = [(i, tuple(math.floor(scale * float(np.float32(c))) + shift for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    names = sorted(set(v for _, v in used))
    weight = [sum(v == u for _, v in used) if copies else 1 for u in names]
    n = sum(weight)
    sums = [sum(w * v[d] for w, v in zip(weight, names, strict=True)) for d in range(len(names[0]))]
    y = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in names])
    cov = (y * np.array(weight)[:, None]).T @ y / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1].T[:most]
    place = {v: k for k, v in enumerate(names)}
    out = []
    for i, v in used:
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        for k, (e, u) in enumerate(zip(values, vectors, strict=True)):
            if e > 1e-12 * np.trace(cov):
                out.append((i, k + 1, n, deviation, float(y[place[v]] @ u / math.sqrt(e)), float(e / np.trace(cov))))
    return sorted(out, key=lambda r: (r[0] is None, r[:4]))


def compare(got, want):
    got = sorted(([r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained] for r in got), key=lambda r: (r[0] is None, r[:4]))
    assert [r[:4] for r in got] == [list(r[:4]) for r in want]
    for k in {r[1] for r in want}:  # the sign of a component is free, but one for all rows
        a, b = (np.array([r[4] for r in rows if r[1] == k]) for rows in (got, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6 * max(1, np.abs(b).max())
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_plain(spark, sf):
    folder = f"/root/testdata/{sf}"
    got = queries.op12_whitening(spark, folder).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    compare(got, plain(rows))
    assert {r.identity_error for r in got} and max(r.identity_error for r in got) < 1e-9


def odd_rows():
    rng = np.random.default_rng(4)
    some = [[float(c) for c in v] for v in rng.normal(size=(40, 5))]
    rows = list(enumerate(some)) + [(100 + i, some[i % 7]) for i in range(30)] + [(i, some[3]) for i in (200, 200, None, None)]
    return rows, [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0]), (302, [float("nan")] * 5), (303, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (304, []), (305, [1.0, 2.0]), (306, [1e30, 0.0, 0.0, 0.0, 0.0])]


@pytest.mark.parametrize("weights", ["one", "copies"])
def test_odd_rows(spark, weights):
    rows, dropped = odd_rows()
    df = spark.createDataFrame([(i, v, 0, "k", "x") for i, v in rows + dropped], SCHEMA).repartition(4)
    got = whitening.whiten(df, weights=weights).collect()
    compare(got, plain(rows, copies=weights == "copies"))
    assert max(r.identity_error for r in got) < 1e-9


def test_hot_vector_counts_once(spark):
    rows, _ = odd_rows()
    once = {(r.vec_id, r.component): (r.n, r.deviation) for r in whitening.whiten(spark.createDataFrame([(i, v, 0, "", "") for i, v in rows], SCHEMA)).collect()}
    more = whitening.whiten(spark.createDataFrame([(i, v, 0, "", "") for i, v in rows + [(9, rows[9][1])] * 500], SCHEMA)).collect()
    assert all((r.n, r.deviation) == once[r.vec_id, r.component] for r in more) and len(more) == 5 * (len(rows) + 500)


def test_tables_without_components(spark):
    for rows in ([], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])], [(1, None)]):
        got = whitening.whiten(spark.createDataFrame([(i, v, 0, "", "") for i, v in rows], SCHEMA))
        assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    flat = [(i, [0.1 * i, 7.0]) for i in range(9)]  # one dimension that never varies
    compare(whitening.whiten(spark.createDataFrame([(i, v, 0, "", "") for i, v in flat], SCHEMA)).collect(), plain(flat))


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float((-1) ** i * 2**31 * (i % 5)), float(i)]) for i in range(20)]
    got = whitening.whiten(spark.createDataFrame([(i, v, 0, "", "") for i, v in rows], SCHEMA)).collect()
    want = {r[0]: r[3] for r in plain(rows)}
    assert got and all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 1 << 63 else None) for r in got)
    assert any(r.deviation is None for r in got) and any(r.deviation is not None for r in got)
