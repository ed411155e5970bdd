"""Token alignment against a plain version: loops over the libraries' own tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from procyon.llm import alignment, queries

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PATHS[1])


def tokens(libraries, text):
    """((id, end byte) of A, of B), or two empty lists."""
    from procyon.llm.bpe import byte_symbols

    if not text:
        return [], []
    a, b = libraries
    byte = {c: bytes([i]) for i, c in enumerate(byte_symbols())}
    own_a = [(i, b"".join(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    own_b = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    out = []
    for own in (own_a, own_b):
        if b"".join(x for _, x in own) != f" {text}".encode():
            return [], []
        at, ends = 0, []
        for i, x in own:
            at += len(x)
            ends.append((i, at))
        out.append(ends)
    return out


def plain(libraries, texts):
    """The rows of the query but for doc_id: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    found, counts = [], Counter()
    for text in texts:
        a, b = tokens(libraries, text)
        links = [(i, j) for i, x in a for j, y in b if x == y] if len(a) < 3000 else [(i, dict((y, j) for j, y in b)[x]) for i, x in a if x in {y for _, y in b}]
        cuts = sorted({x for _, x in a} & {y for _, y in b})
        groups, at = [], 0
        for cut in cuts:
            told = [",".join(str(i) for i, x in side if at < x <= cut) for side in (a, b)]
            groups.append("|".join(told))
            at = cut
        counts.update(links)
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    highest = Counter()
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    return [(a, b, g, len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), told) for a, b, g, links, told in found]


def test_whole_result_equals_plain(spark, docs, rows, libraries, tmp_path):
    short = [r for r in rows if not r[1] or len(r[1]) < 3000]
    odd = ["▁piece", "a▁b", "  two  spaces ", "\t\n x", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語 é ﷽ ​", "\x00\x01", "🙂👩‍👩‍👧"]
    more = [(1000 + i, t, "en", "s1", len(t), "clash", "clash") for i, t in enumerate(odd)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(short + more, docs.schema).repartition(3).write.parquet(path)
    got = queries.op11_token_alignment(spark, str(tmp_path)).collect()
    want = plain(libraries, [r[1] for r in short + more])
    digest = lambda told: hashlib.sha256(told.encode()).hexdigest() if told else ""
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got)) == sorted((r[0] is None, r[0] or 0, *w[:6], digest(w[6])) for r, w in zip(short + more, want, strict=True))
    assert sum(w[0] == 0 for w in want) >= 4  # null, empty, and those that B does not give back
    told = {r.doc_id: r.groups for r in alignment.align(spark.read.parquet(path), *PATHS).collect()}
    assert all(told[r[0]] == w[6] for r, w in zip(short + more, want, strict=True))


def test_empty_table_and_long_texts(spark, nothing, libraries):
    assert alignment.align(nothing, *PATHS).collect() == []
    r = random.Random(3)
    texts = ["x" * 300_000, " " * 70_000, "".join(r.choice("abcdefgh") for _ in range(280_000)), "word " * 60_000]
    rows = {r.doc_id: r for r in alignment.align(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), *PATHS).collect()}
    for i, text in enumerate(texts):
        a, b = tokens(libraries, text)
        assert (rows[i].n_a, rows[i].n_b, rows[i].n_groups) == (len(a), len(b), len({x for _, x in a} & {y for _, y in b}))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_fast_encoder_equals_library(text):
    with open(PATHS[0], encoding="utf-8") as a, open(PATHS[1], "rb") as b:
        own, pairs, _ = alignment.vocabularies(a.read(), b.read())
    assert own.encode_a(" " + text) == own.library(" " + text)
    assert len(pairs) < 2_000_000 and (np.diff(pairs) > 0).all()


def test_unknown_file_shape_goes_to_the_library(tmp_path):
    import json

    with open(PATHS[0], encoding="utf-8") as f:
        whole = json.load(f)
    whole["pre_tokenizer"]["add_prefix_space"] = True
    with open(PATHS[1], "rb") as b:
        own = alignment.Vocabularies(json.dumps(whole), b.read())
    assert own.encode_a("Hello") == own.library("Hello") == own.library(" Hello")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=12), st.lists(st.integers(1, 4), max_size=12))
def test_groups_and_overlaps_of_intervals(a, b):
    total = max(sum(a), sum(b))
    sides = [np.array([*x, *([total - sum(x)] if total > sum(x) else [])], np.int64) for x in (a, b)]
    ends = [np.cumsum(x) for x in sides]
    starts = [e - x for e, x in zip(ends, sides, strict=True)]
    i, j = alignment.overlaps_of(starts[0], ends[0], starts[1], ends[1])
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
    cuts = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
    group = alignment.groups_of(np.concatenate(starts), np.concatenate(ends))
    assert group.tolist() == [np.searchsorted(cuts, e) for e in np.concatenate(ends)]
