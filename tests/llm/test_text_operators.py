"""Secrets, media, tokens, toxicity against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from procyon.llm import bpe, matroska, queries, secrets, toxicity

KINDS = {"assign": re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def base_spans(text):
    text = text or ""
    out = []
    for rank, (kind, p) in enumerate(KINDS.items()):
        for m in p.finditer(text):
            if (kind == "assign" and len(m[2]) >= 6) or (kind == "access" and len(m[0]) >= 20) or (kind == "hex" and len(m[0]) >= 24):
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_secrets_keep_base_and_link_parts(docs, rows):
    found = {}
    for r in secrets.find_secrets(docs).collect():
        found.setdefault(r.doc_id, (r.base, r.linked))
    for i, text, *_ in rows:
        base, linked = found[i]
        assert [tuple(p) for p in base] == base_spans(text)
        if text and "alone" in text:
            assert not linked
        if text and text.startswith("user=bob1 near"):
            assert not linked  # two identifiers and an endpoint, but no secret
        if text and "with aB3" in text:
            assert [p["kind"] for p in linked] == ["token"]


def test_weak_part_within_a_longer_one_is_linked(spark):
    token, key = "aB3" + "xY7z" * 9 + "q", "AKIA" + "ABCDEFGH" * 2
    text = f"see https://host/v-{token}.x/{key} there"
    parts = secrets.parts_of(text)
    assert [(text[a:b], kind) for a, _, kind, b in parts] == [(token, "token"), (key, "access")]
    (row,) = secrets.redact(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert row.text == "see https://host/v-[token].x/[access] there"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 15))), st.lists(st.tuples(st.integers(0, 40), st.integers(1, 15))))
def test_outside_equals_all_pairs(weak, taken):
    weak = [(a, 3, "login", a + n) for a, n in weak]
    taken = sorted((a, a + n) for a, n in taken)
    assert secrets._outside(weak, taken) == [w for w in sorted(weak) if not any(a < w[3] and b > w[0] for a, b in taken)]


def test_link_is_an_interval_join(spark):
    rows = [("a", "login", 0, 10), ("a", "hex", 266, 300), ("b", "login", 0, 10), ("b", "hex", 267, 300), ("c", "endpoint", 500, 520), ("c", "hex", 600, 700), ("c", "access", 100, 260), ("c", "login", 90000, 90010)]
    out = secrets.link(spark.createDataFrame(rows, "scope string, kind string, start bigint, `end` bigint"))
    assert sorted((r.scope, r.kind) for r in out.collect()) == [("a", "login"), ("c", "endpoint")]
    near = secrets.link(spark.createDataFrame(rows, "scope string, kind string, start bigint, `end` bigint"), gap=257)
    assert ("b", "login") in {(r.scope, r.kind) for r in near.collect()}


def test_link_equals_all_pairs_on_random_parts(spark):
    import random

    r = random.Random(6)
    rows = sorted({(f"s{r.randrange(12)}", r.choice(secrets.KINDS), a, a + r.choice([3, 40, 700])) for a in (r.randrange(3000) for _ in range(400))})
    for gap in (1, 50, 256):
        got = {tuple(x) for x in secrets.link(spark.createDataFrame(rows, "scope string, kind string, start bigint, `end` bigint").repartition(3), gap).collect()}
        want = set()
        for s, kind, a, b in rows:
            near = {secrets.ROLE[k] for s2, k, a2, b2 in rows if s2 == s and a2 <= b + gap and b2 >= a - gap}
            if kind in secrets.KINDS[3:] and set(secrets.NEEDS[secrets.ROLE[kind]]) <= near:
                want.add((s, kind, a, b))
        assert got == want and want


def test_addresses_are_identifiers(spark):
    texts = ['bob@x.example.org token = "0a1b2c3d4e"', "bob@x.example.org alone", "user=bob@x.example.org password: hunter22", "a@b " * 9 + "x" * 300 + "@y.org", "k" * 100_000 + "@x.org secret=abcdef", "bob@x.example.org" + " pad" * 80 + " token: 123456"]
    found = [[(text[a:b], kind) for a, rank, kind, b in secrets.parts_of(text) if rank >= 3] for text in texts]
    assert found == [[("bob@x.example.org", "mail")], [("bob@x.example.org", "mail")], [("user=bob@x.example.org", "login")], [], [], [("bob@x.example.org", "mail")]]
    out = {r.id: r.text for r in secrets.redact(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id").collect()}
    assert out[0] == '[mail] [assign]"' and out[1] == texts[1] and out[2] == "[login] [assign]" and out[5].startswith("bob@")


def test_the_tables_hold_linked_parts(spark):
    rows = queries.op2_secret_linking(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.n_linked for r in rows) > 0 and all(("mail" in r.spans) <= (r.n_linked > 0) for r in rows)


def test_redaction_takes_effect_and_keeps_the_rest(docs, nothing):
    out = {r.doc_id: r for r in secrets.redact(docs).collect()}
    before = {r.doc_id: r for r in docs.collect()}
    assert secrets.redact(docs).columns == docs.columns and secrets.redact(docs).count() == docs.count()
    for i, r in out.items():
        if not base_spans(before[i].text) and "user" not in (before[i].text or "") and "AKIA" not in (before[i].text or ""):
            assert r.text == before[i].text
        assert not base_spans(r.text)
    assert secrets.redact(nothing).count() == 0


def test_media_round_trip(docs, rows, nothing):
    media = matroska.mux_texts(docs)
    got = {}
    for r in matroska.media_features(media, keep=("n_bytes",)).collect():
        got[r.doc_id] = r
    for i, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    packets = matroska.packet_table(media).where("doc_id = 87 OR doc_id = 88").collect()
    assert all(p.size <= matroska.FRAME and p.track == 1 for p in packets)
    assert matroska.media_features(matroska.mux_texts(nothing)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=70_000))
def test_mux_and_parse_are_inverse(data):
    file = matroska.mux(data)
    packets, cues = matroska.parse(file)
    assert b"".join(file[o : o + n] for _, _, o, n, *_ in packets) == data
    times = [p[1] for p in packets]
    assert times == [i * matroska.FRAME * 10**9 // matroska.HERTZ for i in range(len(times))]
    assert [file[c[2] : c[2] + 4] for c in cues] == [b"\x1f\x43\xb6\x75"] * len(cues)


def test_other_lacings_and_broken_files():
    def el(i, b):
        return matroska._el(i, b)

    xiph = b"\x81\x00\x05\x02" + bytes([2, 255, 1, 3]) + b"a" * 256 + b"bbb" + b"cc"
    group = el(matroska.GROUP, el(matroska.BLOCK, b"\x82\x00\x07\x00" + b"dddd"))
    unknown = b"\x1f\x43\xb6\x75\x01\xff\xff\xff\xff\xff\xff\xff" + el(matroska.TIME, b"\x0a") + el(matroska.SIMPLE, xiph) + group
    file = el(matroska.EBML, b"") + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + unknown
    packets, _ = matroska.parse(file)
    assert [(p[0], p[1], p[3], p[6]) for p in packets] == [(1, 15_000_000, 256, "xiph"), (1, 15_000_000, 3, "xiph"), (1, 15_000_000, 2, "xiph"), (2, 17_000_000, 4, "none")]
    assert matroska.parse(file[:-2])[0] == packets[:3]
    assert matroska.parse(b"junk") == ([], []) and matroska.parse(None) == ([], [])


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_bpe())


def test_bpe_equals_the_library(docs, rows, library, nothing):
    got = {}
    for r in bpe.encode_texts(docs, queries.word_bpe(), decoded=True).collect():
        got[r.doc_id] = r
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)
    back = bpe.decode_ids(bpe.encode_texts(docs, queries.word_bpe()), queries.word_bpe())
    assert {r.doc_id: r.text for r in back.collect()} == {i: r.decoded for i, r in got.items()}
    assert bpe.encode_texts(nothing, queries.word_bpe()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_bpe_on_any_text(library, text):
    model = bpe.model_of(open(queries.word_bpe()).read())
    assert np.frombuffer(model.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_forced_cuts_lie_in_no_token():
    model = bpe.model_of(open(queries.word_bpe()).read())
    pieces = model.pieces("zqxjkvbwfq")
    assert len(pieces) > 1
    for a, b in zip(pieces, pieces[1:]):
        assert (a[-1], b[0]) not in model.inside


def test_toxicity_learns_and_leaves_held_out_rows_alone(spark, nothing):
    import random

    r = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        words = [r.choice(["kara", "lovo", "mixi", "nezu", "suthe"]) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            words.insert(r.randrange(60), r.choice(["scumbag", "moronic"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, "scumbag scumbag"), (1000, None), (1001, "")], "doc_id bigint, text string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, lab)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    wrong = [i for i in range(400) if (got[i] >= 0.3) != (i % 5 == 0)]
    assert not wrong and all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    kept = toxicity.keep_clean(docs, model)
    assert kept.count() == 322 and kept.columns == docs.columns
    held = {r.doc_id for r in docs.where(toxicity.held_out()).collect()}
    assert held == {i for i, _ in [*rows, (1000, ""), (1001, "")] if zlib.crc32(str(i).encode()) % 4 == 2}
    assert toxicity.score(nothing, model).count() == 0
    blank = toxicity.fit(docs, lab.where("false"))
    assert toxicity.score(docs, blank).where("score > 0.001").count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_tokenizer_files_give_the_library_s_ids(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        model = bpe.Bpe(f.read())
    library = Tokenizer.from_file(path)
    assert model.quick == (name == "word_bpe_49k.json")
    for text in ["Hello World 123", "  two  spaces\n\n\tand It's", "é日本 <|endoftext|> x", "", "ǅ ÀÉ ½ ² ª", "a" * 300 + " " * 9]:
        ids = np.frombuffer(model.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert model.decode(model.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_files_with_what_is_not_built_are_refused():
    import json

    from procyon.llm.queries import word_bpe

    with open(word_bpe(), encoding="utf-8") as f:
        whole = json.load(f)
    for change in ({"model": whole["model"] | {"ignore_merges": True}}, {"added_tokens": [whole["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError, match="not built"):
            bpe.Bpe(json.dumps(whole | change))


def test_blocks_that_refer_to_others_are_no_keyframes():
    el = matroska._el
    block = lambda n: el(matroska.BLOCK, b"\x82\x00\x07\x00" + bytes([n]))
    simple = el(matroska.SIMPLE, b"\x82\x00\x08\x80" + b"s")
    after, before, alone = (el(matroska.GROUP, x) for x in (block(1) + el(matroska.REFERENCE, b"\xff"), el(matroska.REFERENCE, b"\xff") + block(2), block(3)))
    file = el(matroska.EBML, b"") + el(matroska.SEGMENT, el(matroska.CLUSTER, el(matroska.TIME, b"\x01") + simple + after + before + alone + simple))
    assert [p[4] for p in matroska.parse(file)[0]] == [True, False, False, True, True]
