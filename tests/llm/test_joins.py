"""Near duplicates, substrings, embeddings, mixing, Merkle trees and reputations against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from procyon.llm import common, fm_index, merkle, mixing, ngram_jaccard, subspace_join, substring_dedup, url_reputation

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("k", "percent", "short", "part"), [(3, 90, 4, 4096), (5, 80, 1, 3)])
def test_jaccard_join(docs, rows, monkeypatch, k, percent, short, part):
    monkeypatch.setattr(ngram_jaccard, "SHORT", short)
    monkeypatch.setattr(ngram_jaccard, "PART", part)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.components_of(docs, k, percent).collect()]
    sets = {i: shingles(t, k) for i, t, *_ in rows if i is not None}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label = components(sets, edges)
    want = [(i, len(shingles(t, k)), label.get(i)) for i, t, *_ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len(set(label.values())) < len(label) - 8


def test_keep_one(docs, rows, nothing):
    kept = ngram_jaccard.keep_one(docs)
    label = {r.doc_id: r.component_id for r in ngram_jaccard.components_of(docs).collect()}
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted({i for i, c in label.items() if i == c and i is not None})
    assert kept.where("doc_id IS NULL").count() == 1
    assert ngram_jaccard.keep_one(nothing).count() == 0


def brute_substrings(rows):
    first, out = {}, {}
    for i, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first.setdefault(tuple(w[j : j + 13]), i) < i:
                gone[j : j + 13] = [True] * 13
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def test_substrings(docs, rows, nothing):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.deduplicate(docs).collect()}
    assert got.pop(None)[1] == 0
    assert got == brute_substrings(rows)
    assert sum(v[1] for v in got.values()) > 1000
    assert substring_dedup.deduplicate(docs).count() == len(rows)
    assert substring_dedup.deduplicate(nothing).count() == 0


def test_fm_index_finds_what_a_scan_finds():
    r = np.random.default_rng(3)
    lengths = r.integers(1, 30, 40)
    codes = r.integers(0, 4, lengths.sum()).astype("<u4")
    owners = r.integers(0, 9, 40)
    index = fm_index.FmIndex(codes, lengths, owners)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    seqs = [tuple(codes[a:b]) for a, b in zip(begin, begin[1:])]
    for most in (1, 4, 6):
        ends, wins = [], []
        for s, seq in enumerate(seqs):
            for j in range(len(seq) - most + 1):
                ends.append(index.begin[s] + j + most - 1)
                wins.append(seq[j : j + most])
        length, low, high = index.matching(np.array(ends), most)
        for n, a, b, w in zip(length, low, high, wins):
            where = [s for s, q in enumerate(seqs) for j in range(len(q)) if q[j : j + most] == w]
            assert (n >= most) == (len(where) > 1)
            if n >= most:
                assert b - a == len(where)
                assert index.smallest_owner(np.array([a]), np.array([b]))[0] == min(owners[s] for s in where)


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, x) for x in range(5001, 5200)] + [(7, 7), (8, 9), (9, 8)]
    got, large = ({x.node: x.component for x in common.components(spark.createDataFrame(edges, "src bigint, dst bigint"), small).collect()} for small in (1 << 16, 4))
    assert got == large
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == components(nodes, [e for e in edges if e[0] != e[1]])
    assert common.components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_scratch_deletes_all_but_what_is_kept(spark):
    import os

    paths = lambda df: [f.removeprefix("file:") for f in df.inputFiles()]
    with common.scratch(spark):
        with common.scratch(spark):
            gone, kept = common.save(spark.range(3)), common.save(spark.range(4), keep=True)
            gone = paths(gone)
        assert not any(map(os.path.exists, gone)) and kept.count() == 4
        outer = paths(kept)
    assert not any(map(os.path.exists, outer)) and not common._scopes
    assert common.save(spark.range(2)).count() == 2


def test_embeddings(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(60, 64))
    x = np.concatenate([base, base[:20] + r.normal(size=(20, 64)) * 0.2, base[:1] + r.normal(size=(40, 64)) * 0.15, base[3:4] * 2, np.zeros((1, 64))]).astype(np.float32)
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(300, x[5].tolist(), None), (301, None, None), (302, [], None), (303, [float("nan")] * 64, None), (304, [None] * 64, None), (305, [1.0, 2.0], None), (306, [2.0, 4.0], None), (None, x[0].tolist(), None), (7, x[7].tolist(), None)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in subspace_join.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rep string")).collect()), key=str)
    good = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, edges = {n: 0 for n in range(len(good))}, []
    for a in range(len(good)):
        for b in range(len(good)):
            u, v = good[a][1], good[b][1]
            if a != b and len(u) == len(v) and u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= 0.95:
                links[a] += 1
                edges.append((good[a][0], good[b][0]))
    label = components({i for i, *_ in rows if i is not None}, edges)
    want = [(i, links[n], label[i], i == label[i]) for n, (i, _) in enumerate(good)]
    want += [(i, 0, i, True if i is not None else False) for i, v, _ in rows if i is None or not v or None in v or not np.isfinite(v).all() or not np.any(v)]
    assert got == sorted(want, key=str)


def test_mixing(spark, docs, rows, nothing):
    quality = F.when(F.col("text").contains("edit"), 0.1).otherwise(1.0)
    got = mixing.mix_table(docs, quality).collect()
    assert len(got) == len(rows) and sorted(r.size for r in got) == sorted(len(WORD.findall(t or "")) for _, t, *_ in rows)
    per = {}
    for r in got:
        per.setdefault((r.source_size, r.target), []).append(r)
    for (size, target), own in per.items():
        assert sum(r.size for r in own) % size == 0 and target <= 2 * size
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)
    assert abs(sum(t for _, t in per) - 1.5 * sum(r.size for r in got)) < 1e-6 * sum(r.size for r in got)
    assert all(r.taken <= 2 * r.size for r in got)
    again = mixing.mix_table(docs, quality).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    whole = mixing.mix(docs, quality)
    assert whole.columns == docs.columns and mixing.sizes(whole, {"doc_id": F.col("doc_id")}).agg(F.sum("size")).first()[0] == sum(r.taken for r in got)
    assert mixing.mix_table(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_targets_are_reshared(spark):
    t = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 5), (None, 0)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(t).collect()}
    assert got["a"] == 20 and got["d"] == 10 and got[None] == 0
    assert abs(sum(got.values()) - 1.5 * 2015) < 1e-6 and abs(got["b"] - 2 * got["c"]) < 1e-6


def test_merkle_audit_finds_the_planted_faults(spark):
    pages = spark.createDataFrame([(i, f"http://x{i}.example.org/", "y" * (i % 900)) for i in range(2500)] + [(None, None, None)], "page_id bigint, url string, html string")
    a = merkle.archive(pages, 700)
    b = a.where("page_id IS NULL OR page_id != 11").withColumn("digest", F.when(F.col("page_id").isin(5, 1999), F.lit("broken")).otherwise(F.col("digest")))
    out = sorted((r.page_id, r.status) for r in merkle.audit(a.where("page_id IS NULL OR page_id != 2400"), b, span=2048).collect())
    assert out == [(5, "changed"), (11, "missing"), (1999, "changed"), (2400, "extra")]
    assert merkle.audit(a, a).count() == 0
    assert merkle.audit(a.limit(0), a.limit(0)).count() == 0
    assert merkle.audit(a, a.limit(0)).count() == 2501


def test_reputation_shrinks_small_hosts(spark):
    rows = [("http://big.bad.org/a", 1)] * 60 + [("http://big.bad.org/a", 0)] * 40 + [("http://small.good.org/a", 1)] + [("http://www.good.org/a", 0)] * 200 + [("http://other.net/es/x", 0), ("HTTP://A.Example.COM/en/1", 0), ("http://www.example.com/en/", 0), ("http://example.com?x", 1), (None, 0), ("no scheme", 0), ("http://user@H.org:80/p?q#f", 0)]
    pages = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(rows)], "page_id bigint, url string, bad int")
    out = {}
    for r in url_reputation.judge(pages, pages.select(url_reputation.host_of(F.col("url")).alias("host"), "bad"), threshold=0.3).collect():
        out.setdefault(pages_url := rows[r.page_id][0], r)
    assert out["http://big.bad.org/a"].verdict == "block" and out["http://www.good.org/a"].verdict == "allow"
    assert (out["http://other.net/es/x"].rule, out["http://other.net/es/x"].verdict) == ("net/es/", "block")
    assert (out["HTTP://A.Example.COM/en/1"].host, out["HTTP://A.Example.COM/en/1"].rule) == ("a.example.com", "example.com/en/")
    assert out["http://www.example.com/en/"].verdict == "allow"
    assert (out["http://example.com?x"].path, out["http://example.com?x"].rule) == ("", None)
    assert out[None].host == out[None].path == "" and out["no scheme"].host == ""
    assert (out["http://user@H.org:80/p?q#f"].host, out["http://user@H.org:80/p?q#f"].path) == ("user@h.org:80", "/p")
    empty = pages.limit(0)
    assert url_reputation.judge(empty, empty.select(F.col("url").alias("host"), "bad")).count() == 0


def test_substrings_of_unlike_documents(spark):
    words = [f"w{i}" for i in range(2000)]
    alone = [(i, " ".join(words[i * 40 : i * 40 + 40])) for i in range(20)]
    same = " ".join(words[1000:1013])
    for rows in (alone, alone[:1], [(1, f"a b {same} c"), (2, f"d {same}")], [*alone, (50, f"x {same} y"), (51, same)]):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(len(rows))
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.deduplicate(docs).collect()}
        assert got == brute_substrings(rows)


def test_words_of_one_code_are_told_apart(spark):
    """Words whose first hash has the same lower half are different words all the same."""
    import pyarrow as pa

    twins = {}
    for word in (f"q{i}" for i in [*range(216_000, 217_000), *range(385_000, 386_500)]):
        code = common.word_hashes(*common.text_buffers(pa.array([word])), lower=False)[0][0] & np.uint64(0xFFFFFFFF)
        twins.setdefault(int(code), []).append(word)
    pairs = [w for w in twins.values() if len(w) > 1]
    assert ["q216270", "q385977"] in pairs
    shared = "a b c d e f g h i j k l m n o p".split()
    rows = []
    for k, (x, y) in enumerate(pairs):
        for place in range(13):
            rows += [(1000 * k + 2 * place, " ".join([*shared[:place], x, *shared[place:12], f"t{k}{place}"])), (1000 * k + 2 * place + 1, " ".join([*shared[:place], y, *shared[place:12], f"u{k}{place}"]))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_substrings(rows)
    one = np.array([5, 5, 3, 5], np.uint64)
    number, first = substring_dedup.numbered(one, np.array([1, 2, 9, 1], np.uint64))
    assert number.tolist() == [1, 2, 0, 1] and first.tolist() == [2, 0, 1]


def test_one_passage_in_every_document(spark):
    r = random.Random(12)
    passage = " ".join(f"w{r.randrange(50)}" for _ in range(60))
    rows = [(i, f"x{i} {passage} y{i}" + (f" {passage[:90]}" if i % 3 else "")) for i in range(400)]
    rows += [(7, f"other text of the same id {passage}"), (500, passage), (501, " ".join(passage.split()[5:30]))]
    got = sorted((x.doc_id, x.n_words, x.n_removed) for x in substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)).collect())
    first, want = {}, []
    for i, text in sorted(rows, key=lambda x: x[0]):
        w = text.split()
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    for i, text in rows:
        w, gone = text.split(), set()
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone |= set(range(j, j + 13))
        want.append((i, len(w), len(gone)))
    assert got == sorted(want)


def test_vectors_of_any_magnitude_link(spark):
    rows = [(1, [1.0, 2.0, 0.0]), (2, [1e200, 2e200, 0.0]), (3, [1e-200, 2e-200, 1e-320]), (4, [-1e300, -2e300, 0.0]), (5, [3e307, 6e307, 1e300])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in subspace_join.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1)}


def test_slabs_hold_every_near_pair(monkeypatch):
    monkeypatch.setattr(subspace_join, "SMALL", 64)
    r = np.random.default_rng(9)
    x, y = r.normal(size=(700, 8)).astype(np.float32) * 0.125, r.normal(size=(500, 8)).astype(np.float32) * 0.125
    width = 0.112 * 1.001
    far = ((x[:, None] - y[None]) ** 2).sum(2)
    want = set(zip(*np.nonzero(far <= 0.112**2), strict=True))
    seen, products = [], 0
    for i, j in subspace_join._near(x, y, width, np.arange(len(x)), np.arange(len(y)), 2):
        products += len(i) * len(j)
        seen += [(a, b) for a in i for b in j]
    assert len(seen) == len(set(seen)) and want <= set(seen)
    assert products < 0.12 * len(x) * len(y)  # six more coordinates, of which each leaves out about half


def test_vectors_are_dealt_once_a_block_however_many_tiles_they_meet(spark, monkeypatch):
    monkeypatch.setattr(subspace_join, "TILE", 64 * 8)
    r = np.random.default_rng(4)
    x = r.normal(size=(150, 64))
    x = np.concatenate([x, x[:30] + r.normal(size=(30, 64)) * 0.2, x[:1] + r.normal(size=(60, 64)) * 0.15]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    dealt = subspace_join.cells(subspace_join.distinct_vectors(df), 0.95)
    crowd = dealt.groupBy(*subspace_join.CELL).count().selectExpr(*subspace_join.CELL, "ceil(count / 8) AS tiles")
    tiles = subspace_join.packed_tiles(dealt, crowd).selectExpr("block", "tile", "length(reps) / 8 AS n").collect()
    assert max(t.tile for t in tiles) > 3 and {b: sum(t.n for t in tiles if t.block == b) for b in range(8)} == {b: len(x) for b in range(8)}
    y = x.astype(np.float64)
    near = y @ y.T / np.sqrt((y * y).sum(1))[:, None] / np.sqrt((y * y).sum(1)) >= 0.95
    got = {row.vec_id: row.n_links for row in subspace_join.near_duplicates(df).collect()}
    assert got == {i: int(near[i].sum()) - 1 for i in range(len(x))}
