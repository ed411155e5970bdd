"""Substring deduplication: a compressed FM-index per shard, matching statistics of streamed documents against it.

A window is 13 consecutive words. Every word covered by a window that also starts in a document of a smaller id goes.
Shards are by content, not by document, so that no document is streamed to every shard: a window's key is the rarest
6-gram in it (by a count sketch of fixed size over all documents, then by hash), consecutive windows of one key are a
segment, and equal windows always have equal keys.

1. Sketch of 6-grams, whose sum also gives the number of shards: each stands for a fixed number of words.
2. Keys: each segment's key is dealt by its hash; keys seen in two documents are shared. Only these go on.
3. Segments with shared keys are dealt to shards by key. Equal segments are one, owned by the smallest id. A shard
   builds an FM-index of its segments and searches all their windows backwards; a matching statistic of 13 whose range
   holds a smaller owner is reported as an interval of removed words.
4. Rows with intervals are cut; the others keep the digest of all their words.

Words are compared by 128 bits, two hashes of 64 bits by unrelated numbers, in the index and in the digests by which
equal segments are one; 64 of them choose keys and shards, which only bring candidates together.

Keys or segments that recur within one task's chunk are settled there, and only one of them is dealt on, so a passage
that a third of all documents hold reaches a shard once per chunk.

Edge cases: null and empty texts have no words; a null id neither removes nor is removed from; rows of one id are one
document, with windows judged in each of its texts; windows do not cross rows; extra columns are ignored; an empty
table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, map_batches, mix, save, sketch, text_buffers, text_chunks, word_hashes, word_spans
from .fm_index import FmIndex
from .ngram_jaccard import SKETCH_BITS, rarity

WINDOW, GRAM, STEPS = 13, 6, 5.5
SHARD_WORDS, DEALT_BYTES = 1 << 19, 4 << 20


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(len(a.tobytes()) for a in arrays)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, "<i8", len(kinds) + 1)[1:]
    at = 8 * (len(kinds) + 1) + np.concatenate([[0], np.cumsum(sizes)])
    return [np.frombuffer(raw[a:b], k) for a, b, k in zip(at, at[1:], kinds, strict=False)]


def deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0)


def changes(*columns: np.ndarray) -> np.ndarray:
    """For each row whether it is the first or differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def numbered(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's pair among the distinct pairs, in their order; where each distinct pair is first found)."""
    _, first, number = np.unique(one, return_index=True, return_inverse=True)
    if (two[first][number] == two).all():
        return number, first
    order = np.lexsort((two, one))
    new = changes(one[order], two[order])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


class Segments:
    """The segments of a chunk's rows: key, row, first word (in the row) and in the chunk, number of windows."""

    def __init__(self, chunk: pa.RecordBatch, order: np.ndarray):
        self.words, first = word_hashes(*text_buffers(chunk.column("text")), lower=False)
        ids = chunk.column("doc_id")
        usable = np.asarray(ids.is_valid()) if len(ids) else np.zeros(0, bool)
        self.doc = np.asarray(ids.fill_null(0)).astype(np.int64)
        self.check = np.asarray(chunk.column("check"))
        grams = gram_hashes(self.words, GRAM)
        low = order[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(58) | mix(grams) >> np.uint64(6)
        for step in (1, 2, 4):  # the smallest of 8 consecutive grams
            low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        count = np.where(usable, np.maximum(np.diff(first) - WINDOW + 1, 0), 0)
        starts = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        rows = np.repeat(np.arange(len(count)), count)
        key = low[starts]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (rows[1:] != rows[:-1])
        at = np.flatnonzero(new)
        self.key, self.row, self.at = mix(key[at]), rows[at], starts[at]
        self.windows = np.diff(np.append(at, len(key)))
        self.place = self.at - first[self.row]
        self.first = first


def shard_count(docs: DataFrame, words: int) -> int:
    """A shard for each SHARD_WORDS words of all documents, and enough for the tasks of a shuffle."""
    return max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words // SHARD_WORDS))


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about `limit` bytes: what recurs within a chunk is settled there."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _dealt(docs: DataFrame, order: np.ndarray, buckets: int, emit: Callable) -> DataFrame:
    """(bucket, kind, blob): emit(chunk, segments of the chunk, number of buckets) gives the rows of a chunk."""
    shared = docs.sparkSession.sparkContext.broadcast(order)  # 2^20 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(_gathered(batches, DEALT_BYTES), limit=DEALT_BYTES):
            rows = list(emit(chunk, Segments(chunk, shared.value), buckets))
            if rows:
                bucket, kind, blob = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "kind", "blob"])

    return map_batches(docs, run, "bucket int, kind int, blob binary")


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each value of bucket; nothing for an empty array."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
        yield int(bucket[order[a]]), order[a:b]


def gram_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket of 6-grams occurs, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        held = np.zeros(1 << SKETCH_BITS, np.int64)
        for chunk in text_chunks(batches):
            words = word_hashes(*text_buffers(chunk.column("text")), lower=False)[0]
            np.add.at(held, (gram_hashes(words, GRAM) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        return held

    return sketch(docs.select("text"), 1 << SKETCH_BITS, run)


def base_pass(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, check, n_words, digest): what becomes of a row from which nothing is removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            words = [t.encode().split() for t in chunk.column("text").to_pylist()]
            digest = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("check"), pa.array([len(w) for w in words], pa.int64()), pa.array(digest)], ["doc_id", "check", "n_words", "digest"])

    return map_batches(docs, run, "doc_id bigint, check bigint, n_words bigint, digest string")


def shared_keys(docs: DataFrame, order: np.ndarray, shards: int) -> DataFrame:
    """(doc_id, check, keys): the keys of each row's segments that are in another document too, 32 bits of each."""

    def emit(chunk: pa.RecordBatch, s: Segments, buckets: int) -> Iterator[tuple[int, int, bytes]]:
        if not len(s.key):
            return
        by = np.lexsort((s.doc[s.row], s.key))
        key, row = s.key[by], s.row[by]
        doc = s.doc[row]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(key)) - 1
        several = doc[head] != doc[last]
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        k32 = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
        bucket = (key >> np.uint64(32)).astype(np.int64) % buckets
        # Kind 0: to be matched, one for each key that several documents here have, all rows of the others.
        for b, i in _slices(np.where((several[group] & ~new) | ~once, -1, bucket)):
            if b >= 0:
                i = i[np.argsort(row[i], kind="stable")]
                yield b, 0, pack(deltas(doc[i]).astype("<i8"), s.check[row[i]].astype("<i8"), k32[i], several[group[i]].astype("u1"))
        # Kind 1: settled here, dealt out evenly by row.
        i = np.flatnonzero(several[group] & once)
        for b, j in _slices(mix(row[i].astype(np.uint64) + key[i[:1]].sum()).astype(np.int64) % buckets):
            own = i[j][np.argsort(row[i[j]], kind="stable")]
            yield b, 1, pack(deltas(doc[own]).astype("<i8"), s.check[row[own]].astype("<i8"), k32[own], np.ones(len(own), "u1"))

    def match(t: pa.Table) -> pa.Table:
        out = []
        for kind in (0, 1):
            blobs = [unpack(b.as_py(), "<i8", "<i8", "<u4", "u1") for b, k in zip(t["blob"], t["kind"].to_pylist(), strict=True) if k == kind]
            if not blobs:
                continue
            doc = np.concatenate([np.cumsum(b[0]) for b in blobs])
            check, k32, several = (np.concatenate([b[c] for b in blobs]) for c in (1, 2, 3))
            if kind == 0:
                by = np.argsort(k32, kind="stable")
                doc, check, k32, several = doc[by], check[by], k32[by], several[by]
                head = np.flatnonzero(np.diff(k32.astype(np.int64), prepend=-1))
                size = np.diff(np.append(head, len(k32)))
                low, high, flag = np.minimum.reduceat(doc, head), np.maximum.reduceat(doc, head), np.maximum.reduceat(several, head)
                keep = np.repeat((low != high) | (flag > 0), size) & (several == 0)
                doc, check, k32 = doc[keep], check[keep], k32[keep]
            out.append((doc, check, k32))
        doc, check, k32 = (np.concatenate([o[c] for o in out]) for c in range(3))
        by = np.lexsort((check, doc))
        doc, check, k32 = doc[by], check[by], k32[by].astype(np.int64)
        head = np.flatnonzero(changes(doc, check))
        lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(doc)), pa.int32()), pa.array(k32))
        return pa.table([pa.array(doc[head]), pa.array(check[head]), lists], ["doc_id", "check", "keys"])

    dealt = _dealt(docs, order, shards, emit)
    found = dealt.groupBy("bucket").applyInArrow(match, "doc_id bigint, check bigint, keys array<bigint>")
    return found.groupBy("doc_id", "check").agg(F.flatten(F.collect_list("keys")).alias("keys"))


def shared_spans(docs: DataFrame, order: np.ndarray, shards: int) -> DataFrame:
    """(doc_id, check, starts, lengths): the runs of words to remove from each row. docs: with keys, see shared_keys."""

    def emit(chunk: pa.RecordBatch, s: Segments, buckets: int) -> Iterator[tuple[int, int, bytes]]:
        lists = chunk.column("keys")
        where = np.asarray(lists.offsets)
        rows = np.repeat(np.arange(len(lists), dtype=np.int64), np.diff(where))
        wanted = np.sort((rows << 32) | np.asarray(lists.flatten()))
        mine = (s.row << 32) | (s.key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = np.searchsorted(wanted, mine)
        hit = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == mine) if len(wanted) else np.zeros(0, np.int64)
        if not len(hit):
            return
        key, row, begin, windows, place = s.key[hit], s.row[hit], s.at[hit], s.windows[hit], s.place[hit]
        size = windows + WINDOW - 1
        doc = s.doc[row]
        raw = text_buffers(chunk.column("text"))
        second, (starts, ends, _) = word_hashes(*raw, lower=False, second=True)[0], word_spans(*raw)
        one, two = _digests(s.words, begin, size), _digests(second, begin, size)
        by = np.lexsort((doc, two, one))
        new = changes(one[by], two[by])
        least = np.empty(len(by), np.int64)
        least[by] = doc[by][np.flatnonzero(new)][np.cumsum(new) - 1]
        bucket = (key >> np.uint64(32)).astype(np.int64) % buckets
        # Kind 0: segments of the smallest id here; the words once for each, all its places.
        own = np.flatnonzero(doc == least)
        for bucket_id, i in _slices(bucket[own]):
            i = own[i]
            i = i[np.lexsort((two[i], one[i]))]
            heads = i[changes(one[i], two[i])]
            low, high = starts[begin[heads]], ends[begin[heads] + size[heads] - 1]
            words = np.concatenate([raw[0][a:b] for a, b in zip(low, high, strict=True)])
            yield bucket_id, 0, pack(doc[i], s.check[row[i]].astype("<i8"), place[i].astype("<u4"), changes(one[i], two[i]).astype("u1"), (high - low).astype("<u4"), words)
        # Kind 1: the others go as a whole; settled here, dealt out evenly.
        i = np.flatnonzero(doc != least)
        for b, j in _slices(mix(row[i].astype(np.uint64) + key[:1].sum()).astype(np.int64) % buckets):
            j = i[j]
            yield b, 1, pack(doc[j], s.check[row[j]].astype("<i8"), place[j].astype("<u4"), size[j].astype("<u4"))

    def search(t: pa.Table) -> pa.Table:
        spans: list[tuple[np.ndarray, ...]] = []
        blobs = []
        for b, kind in zip(t["blob"], t["kind"].to_pylist(), strict=True):
            if kind:
                doc, check, place, size = unpack(b.as_py(), "<i8", "<i8", "<u4", "<u4")
                spans.append((doc, check, place.astype(np.int64), size.astype(np.int64)))
            else:
                blobs.append(tuple(unpack(b.as_py(), "<i8", "<i8", "<u4", "u1", "<u4", "u1")))
        if blobs:
            spans += _search(blobs)
        doc, check, place, size = (np.concatenate([s[c] for s in spans]) for c in range(4)) if spans else [np.zeros(0, np.int64)] * 4
        return pa.table([doc, check, place, size], ["doc_id", "check", "start", "length"])

    dealt = _dealt(docs, order, shards, emit)
    found = dealt.groupBy("bucket").applyInArrow(search, "doc_id bigint, check bigint, start bigint, length bigint")
    return found.groupBy("doc_id", "check").agg(F.collect_list("start").alias("starts"), F.collect_list("length").alias("lengths"))


def _digests(words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of words."""
    out = size.astype(np.uint64)
    for step in range(int(size.max())):
        live = size > step
        out[live] = mix(out[live] * np.uint64(0xD6E8FEB86659FD93) + words[begin[live] + step])
    return out


def _search(blobs: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """The removed runs of a shard's entries: what the FM-index of its distinct segments finds for smaller owners."""
    doc, check, place, new, taken, data = (np.concatenate([b[c] for b in blobs]) for c in range(6))
    raw = data, np.concatenate([[0], np.cumsum(taken.astype(np.int64))])
    (words, begin), (second, _) = word_hashes(*raw, lower=False), word_hashes(*raw, lower=False, second=True)
    size = np.diff(begin)
    segment, at = numbered(_digests(words, begin[:-1], size), _digests(second, begin[:-1], size))  # each segment's words, once
    which = segment[np.cumsum(new.astype(np.int64)) - 1]
    codes, _ = numbered(words, second)
    owner = np.full(len(at), np.iinfo(np.int64).max)
    np.minimum.at(owner, which, doc)
    out = []
    place = place.astype(np.int64)
    length = size[at]
    other = doc > owner[which]
    out.append((doc[other], check[other], place[other], length[which[other]]))
    words = np.concatenate([codes[begin[a] : begin[a + 1]] for a in at])
    index = FmIndex(words, length, owner)
    windows = length - WINDOW + 1
    seg = np.repeat(np.arange(len(at)), windows)
    inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    ends = index.begin[seg] + inside + WINDOW - 1
    matched, low, high = index.matching(ends, WINDOW)
    hit = np.flatnonzero(matched >= WINDOW)
    least = index.smallest_owner(low[hit], high[hit])
    hit = hit[least < owner[seg[hit]]]
    if not len(hit):
        return out
    # runs of consecutive windows of a segment
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (seg[hit[1:]] != seg[hit[:-1]])
    head = np.flatnonzero(new)
    run_seg, run_at, run_size = seg[hit[head]], inside[hit[head]], np.diff(np.append(head, len(hit))) + WINDOW - 1
    mine = np.flatnonzero(doc == owner[which])
    lo, hi = np.searchsorted(run_seg, which[mine]), np.searchsorted(run_seg, which[mine], "right")
    n = hi - lo
    entry = np.repeat(mine, n)
    run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    out.append((doc[entry], check[entry], place[entry] + run_at[run], run_size[run]))
    return out


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row; kept words are joined by one space."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("check", F.xxhash64("text"))
    counts = gram_counts(rows)
    order, shards = rarity(counts, STEPS), shard_count(docs, int(counts.sum()))
    keys = save(shared_keys(rows, order, shards))
    some = save(rows.join(keys, ["doc_id", "check"]).select("doc_id", "check", "text", "keys"))
    spans = save(shared_spans(some, order, shards))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            removed, digest = [], []
            for text, starts, lengths in zip(chunk.column("text"), chunk.column("starts"), chunk.column("lengths"), strict=True):
                words = text.as_py().encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                a = np.asarray(starts.values)
                np.add.at(edge, a, 1)
                np.add.at(edge, a + np.asarray(lengths.values), -1)
                keep = np.cumsum(edge[:-1]) == 0
                removed.append(int((~keep).sum()))
                digest.append(hashlib.sha256(b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])).hexdigest())
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("check"), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "check", "n_removed", "kept"])

    cut_rows = map_batches(some.select("doc_id", "check", "text").join(spans, ["doc_id", "check"]), cut, "doc_id bigint, check bigint, n_removed bigint, kept string")
    done = cut_rows.dropDuplicates(["doc_id", "check"])
    return base_pass(rows).join(save(done), ["doc_id", "check"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept", "digest").alias("kept_sha256"))
