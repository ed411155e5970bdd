"""The conditional random field against sums over all labellings, and its predictions on held-out and mixed texts."""

import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from procyon.llm import language, queries


def model_of(seed, langs=("a", "b", "c")):
    rng = np.random.default_rng(seed)
    size = len(langs)
    return language.Crf(list(langs), rng.normal(size=(1 << language.BITS, size)), rng.normal(size=size), rng.normal(size=(size, size)))


def all_labellings(start, steps, scores):
    """Log-weight of every labelling of one chain."""
    out = {}
    for y in itertools.product(range(len(start)), repeat=len(scores)):
        out[y] = start[y[0]] + sum(scores[k][v] for k, v in enumerate(y)) + sum(steps[a, b] for a, b in zip(y, y[1:], strict=False))
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=6), st.integers(0, 1000))
def test_marginals_equal_sums_over_labellings(lengths, seed):
    model = model_of(seed)
    scores = np.random.default_rng(seed + 1).normal(size=(sum(lengths), 3)) * 3
    first = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    got = language.marginals(model, scores, first)
    for a, b in zip(first, first[1:], strict=False):
        if a < b:
            weight = all_labellings(model.start, model.steps, scores[a:b])
            total = np.logaddexp.reduce(list(weight.values()))
            for k in range(b - a):
                want = [sum(np.exp(w - total) for y, w in weight.items() if y[k] == v) for v in range(3)]
                assert np.allclose(got[a + k], want, atol=1e-9)


def test_long_chains_equal_a_plain_loop():
    model, rng = model_of(5), np.random.default_rng(6)
    first = np.array([0, 1, 700, 700, 3001])
    scores = rng.normal(size=(3001, 3)) * 8
    got = language.marginals(model, scores, first)
    for a, b in zip(first, first[1:], strict=False):
        ahead, behind = np.zeros((b - a, 3)), np.zeros((b - a, 3))
        for k in range(b - a):
            ahead[k] = scores[a + k] + (model.start if k == 0 else np.logaddexp.reduce(ahead[k - 1][:, None] + model.steps, 0))
        for k in range(b - a - 2, -1, -1):
            behind[k] = np.logaddexp.reduce(model.steps + (scores[a + k + 1] + behind[k + 1])[None], 1)
        if a < b:
            want = np.exp(ahead + behind - np.logaddexp.reduce(ahead + behind, 1)[:, None])
            assert np.allclose(got[a:b], want, atol=1e-8)


def test_gradient_equals_likelihood_of_labellings_and_its_slopes():
    rng = np.random.default_rng(2)
    start, steps, emission = rng.normal(size=3), rng.normal(size=(3, 3)), rng.normal(size=(2, 4, 3))
    real = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    label = np.array([[0, 2, 2, 1], [1, 1, 0, 0]])

    def loss(start, steps, emission):
        out = 0.0
        for e, y, r in zip(emission, label, real, strict=True):
            weight = all_labellings(start, steps, e[r])
            out += np.logaddexp.reduce(list(weight.values())) - weight[tuple(y[r])]
        return out

    value, node, first, pair = language.gradient(None, start, steps, emission, label, real)
    assert np.isclose(value, loss(start, steps, emission))
    for x, g in ((start, first), (steps, pair), (emission, node)):
        for at in np.ndindex(x.shape):
            up, down = x.copy(), x.copy()
            up[at] += 1e-5
            down[at] -= 1e-5
            slope = (loss(*(up if y is x else y for y in (start, steps, emission))) - loss(*(down if y is x else y for y in (start, steps, emission)))) / 2e-5
            assert np.isclose(g[at], slope, atol=1e-6)


def test_words_and_features():
    codes, start, end, first = language.words_of(["Été 12 año's", "", "...", "x", "́ ̀"])
    assert [codes[a:b].tobytes().decode("utf-32-le") for a, b in zip(start, end, strict=True)] == ["été", "año", "s", "x"]
    assert first.tolist() == [0, 3, 3, 3, 4, 4]
    codes, start, end, _ = language.words_of(["abcdef abc abcdef a"])
    word, owner, bucket = language.features_of(codes, start, end)
    assert word[0] == word[2] and len(set(word)) == 3
    # the word; 6 + 7 + 6 grams with edges, prefix and suffix of 4, which may be one
    assert [int((owner == k).sum()) for k in (word[0], word[1], word[3])] == [1 + 6 + 7 + 6 + 2, 1 + 3 + 4 + 3 + 1, 1 + 1 + 2 + 1]
    assert set(bucket[owner == word[1]]) & set(bucket[owner == word[0]])  # they share grams


def test_query_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    rows = queries.op13_language_crf(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs.index)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(docs[r.doc_id] == r.lang_pred for r in held) > 0.98 * len(held) and len({r.lang_pred for r in held}) == 4


def made(n=240):
    r = random.Random(8)
    kinds = {"xx": ["kala", "kolo", "kuka", "kiki"], "yy": ["zeta", "zota", "tazi", "zuze"]}
    return [(i, " ".join(r.choice(kinds[lang]) for _ in range(20)), lang, "clash", lang) for i in range(n) for lang in [("xx", "yy")[i % 2]]], kinds


SCHEMA = "doc_id bigint, text string, lang string, words string, lang_pred string"


def test_code_switched_words_are_labelled(spark):
    rows, _ = made()
    model = language.fit(spark.createDataFrame(rows, SCHEMA))
    text = "kala kolo kuka kolo zeta zota tazi zuze KALA, kolo-kuka!"
    (row,) = language.label_words(spark.createDataFrame([(1, text, None, None, None)], SCHEMA), model).collect()
    assert [w.lang for w in row.words] == ["xx"] * 4 + ["yy"] * 4 + ["xx"] * 3 and row.words[8].word == "kala"
    assert (np.diag(model.steps) > model.steps[[0, 1], [1, 0]]).all()


def test_held_out_labels_and_odd_rows(spark):
    rows, _ = made()
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    flipped = [(i, t, ("lie" if i in held else lang), *x) for i, t, lang, *x in rows] + [(None, "zeta", "null id", "", "")]
    a, b = (language.fit(spark.createDataFrame(r, SCHEMA)) for r in (rows, flipped))
    assert a.langs == b.langs == ["xx", "yy"] and np.array_equal(a.weights, b.weights)
    odd = [(1, None), (2, ""), (3, "12 + 3!"), (4, "kala"), (4, "kala"), (None, "zeta"), (5, "kala " * 60_000 + "zeta"), (6, "k" * 100_000)]
    got = language.identify(spark.createDataFrame([(i, t, None, None, None) for i, t in odd], SCHEMA), a).collect()
    assert [(r.doc_id, r.lang_pred) for r in got][:7] == [(1, "und"), (2, "und"), (3, "und"), (4, "xx"), (4, "xx"), (None, "yy"), (5, "xx")]
    assert all(r.score == 0 for r in got[:3]) and got[3] == got[4] and len(got) == 8


def test_repeated_ids_do_not_crowd_the_sample(spark):
    rows, _ = made()
    hot = spark.createDataFrame(rows + [rows[0]] * 3000, SCHEMA)
    got = language.sample(hot, per_lang=50).collect()
    assert len({r.doc_id for r in got}) == len(got) <= 100


@pytest.mark.parametrize("rows", [[], [(1, "kala", None, "", "")], [(1, "kala", "xx", "", ""), (3, "kolo", "xx", "", "")]])
def test_tables_with_less_than_two_languages(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = language.identify(docs, language.fit(docs)).collect()
    one = len({r[2] for r in rows} - {None}) == 1
    assert [(r.lang_pred, r.score) for r in got] == [("xx", 1.0) if one else ("und", 0.0)] * len(rows)
