"""Cross-tokenizer alignment: the tokens of two vocabularies over one text, in groups that share no byte with others.

Tokens are byte intervals. All A and B tokens of a chunk are lexsorted by start and their ends accumulated by maximum; a
group breaks where a start reaches that running maximum, which is where tokens of both kinds end. Within a group the
overlaps of A and B tokens are expanded (at most n_a + n_b of them, as each kind tiles the text); an overlap whose two
tokens end together is a link.

Linked tokens end at one byte, so the shorter is a suffix of the longer. The pairs that can ever be linked are therefore
a list that the two vocabularies alone give (`Vocabularies.pairs`), a few per token, whatever the corpus. Links carry
places in that list, and the corpus-wide counts are one array of its length: summed in each task, then by a shuffle, and
broadcast. A text is tokenised once; what the second pass needs of it is saved.

A: a byte-level BPE file of the tokenizers library, its special tokens being plain text. If its ids are its merge order
(checked), tiktoken encodes with the ranks read from that file, which gives the same ids several times faster; texts
beyond LONG and other files go through the tokenizers library itself. B: a sentencepiece model, which adds the space.

Edge cases: null and empty texts, and texts that A's or B's tokens do not give back byte by byte, have no tokens: counts
of 0, empty groups and links. Null ids and repeated rows are rows like others (a repeated row counts its links again);
extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import LANES, map_batches, sketch, text_chunks

LONG = 1 << 18
CHUNK_BYTES = 1 << 18
#: Fixed value: how the byte-level pre-tokenizer splits a text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and the pairs of tokens that can end together."""

    def __init__(self, source_a: str, source_b: bytes):
        from sentencepiece import SentencePieceProcessor

        whole = json.loads(source_a)
        byte = {c: i for i, c in enumerate(byte_symbols())}
        names = whole["model"]["vocab"] | {t["content"]: t["id"] for t in whole["added_tokens"]}
        bytes_a = {i: bytes(byte[c] for c in t) for t, i in names.items() if all(c in byte for c in t)}
        self.a = [bytes_a.get(i, b"") for i in range(max(names.values()) + 1)]
        self.encode_a = self._fast(whole, bytes_a) or self._library(source_a)
        self.library = self._library(source_a)
        self.piece = SentencePieceProcessor(model_proto=source_b)
        self.b = [self._piece_bytes(i) for i in range(self.piece.get_piece_size())]
        self.length_a, self.length_b = (np.array([len(x) for x in v], np.int64) for v in (self.a, self.b))

    @staticmethod
    def _fast(whole: dict, bytes_a: dict[int, bytes]):  # noqa: ANN205
        """tiktoken's encoder, if the file is what it presumes: bytes first, then one id for each merge in order."""
        import tiktoken

        model, pre = whole["model"], whole["pre_tokenizer"] or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        plain = whole["normalizer"] is None and pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": pre.get("trim_offsets"), "use_regex": True}
        plain &= not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        plain &= len(model["vocab"]) == 256 + len(merges) and all(model["vocab"].get(x + y) == 256 + i for i, (x, y) in enumerate(merges))
        if not plain or sorted(bytes_a[i] for i in range(256)) != [bytes([i]) for i in range(256)]:
            return None
        ranks = {bytes_a[i]: i for i in model["vocab"].values()}
        return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def _library(source: str):  # noqa: ANN205
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(source)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        tokenizer.encode_special_tokens = True
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def _piece_bytes(self, i: int) -> bytes:
        if self.piece.is_byte(i):
            return bytes([int(self.piece.id_to_piece(i)[1:-1], 16)])
        if self.piece.is_control(i) or self.piece.is_unknown(i):
            return b""
        return self.piece.id_to_piece(i).replace("▁", " ").encode()

    @property
    def pairs(self) -> np.ndarray:
        """a * size of B + b of all token pairs of which one's bytes end with the other's, sorted."""
        named: list[dict[bytes, list[int]]] = []
        for side in (self.a, self.b):
            by = defaultdict(list)
            for i, x in enumerate(side):
                if x:
                    by[x].append(i)
            named.append(by)
        found = set()
        for long, short, flip in ((*named, False), (*named[::-1], True)):
            for x, own in long.items():
                for at in range(len(x)):
                    for j in short.get(x[at:], ()):
                        found.update((j * len(self.b) + i) if flip else (i * len(self.b) + j) for i in own)
        return np.array(sorted(found), np.int64)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's and B's ids of each text, A's with a space before it; none where they do not give the text's bytes."""
        all_a, all_b = [], self.piece.encode(texts, num_threads=1) if texts else []
        for k, text in enumerate(texts):
            own = (self.encode_a if len(text) < LONG else self.library)(" " + text) if text else []
            raw = f" {text}".encode()
            if b"".join([self.a[i] for i in own]) != raw or b"".join([self.b[i] for i in all_b[k]]) != raw:
                own, all_b[k] = [], []
            all_a.append(own)
        return all_a, all_b


@lru_cache(maxsize=1)
def vocabularies(source_a: str, source_b: bytes) -> tuple[Vocabularies, np.ndarray, np.ndarray]:
    """The tokenizers of a worker, the pairs that can be linked, and the digits of the ids that groups are told with."""
    own = Vocabularies(source_a, source_b)
    most = max(len(own.a), len(own.b))
    width = len(str(most))
    digits = np.array([f"{i}".rjust(width, "\0") for i in range(most)], f"S{width}").view(np.uint8).reshape(most, width)
    return own, own.pairs, digits


def groups_of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The group of each interval: groups break where a start reaches the running maximum of the ends before it."""
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    new = np.ones(len(order), bool)
    new[1:] = start[order[1:]] >= reach[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def overlaps_of(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) of which A's interval i and B's j share a byte; each side's intervals are in order and disjoint."""
    low, high = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    n = high - low
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)


def _told(ids: np.ndarray, kind: np.ndarray, group: np.ndarray, doc: np.ndarray, rows: int, digits: np.ndarray) -> pa.Array:
    """For each row `a1,a2|b1;a3|b2,b3`: ids in decimal, A's before B's in each group."""
    order = np.argsort(group * 2 + kind, kind="stable")
    kind, group, doc = kind[order], group[order], doc[order]
    width = digits.shape[1]
    cells = np.empty((len(order), width + 1), np.uint8)
    cells[:, :width] = digits[ids[order]]
    last = np.ones(len(order), bool)
    last[:-1] = (kind[1:] != kind[:-1]) | (group[1:] != group[:-1])
    cells[:, width] = np.where(last, np.where(kind == 0, ord("|"), ord(";")), ord(","))
    final = np.ones(len(order), bool)
    final[:-1] = doc[1:] != doc[:-1]
    cells[final, width] = 0
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, (cells != 0).sum(1), rows))]).astype(np.int32)
    flat = cells.ravel()
    return pa.StringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(flat[flat != 0]))


def _aligned(texts: list[str], own: Vocabularies, pairs: np.ndarray, digits: np.ndarray) -> list[pa.Array]:
    rows = len(texts)
    lists = own.encode(texts)
    ids, doc, start, end = [], [], [], []
    for side, length in zip(lists, (own.length_a, own.length_b), strict=True):
        n = np.array([len(x) for x in side], np.int64)
        ids.append(np.fromiter(chain.from_iterable(side), np.int64, n.sum()))
        doc.append(np.repeat(np.arange(rows), n))
        end.append(np.cumsum(length[ids[-1]]))
        start.append(end[-1] - length[ids[-1]])
    kind = np.repeat(np.array([0, 1]), [len(ids[0]), len(ids[1])])
    group, both = groups_of(np.concatenate(start), np.concatenate(end)), np.concatenate(doc)
    new = np.flatnonzero(np.diff(group[: len(ids[0])], prepend=-1))  # a group's first A token
    i, j = overlaps_of(start[0], end[0], start[1], end[1])
    met = np.flatnonzero(end[0][i] == end[1][j])
    links = np.searchsorted(pairs, ids[0][i[met]] * len(own.b) + ids[1][j[met]])
    count = lambda d: np.bincount(d, minlength=rows)
    n_links = count(doc[0][i[met]])
    offsets = np.concatenate([[0], np.cumsum(n_links)]).astype(np.int32)
    told = _told(np.concatenate(ids), kind, group, both, rows, digits)
    numbers = [pa.array(x.astype(np.int64)) for x in (count(doc[0]), count(doc[1]), count(doc[0][new]), count(doc[0][i]))]
    return [*numbers, told, pa.ListArray.from_arrays(pa.array(offsets), pa.array(links.astype(np.int32)))]


def _files(df: DataFrame, path_a: str, path_b: str):  # noqa: ANN202
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        return df.sparkSession.sparkContext.broadcast((a.read(), b.read()))


COLUMNS = ["n_a", "n_b", "n_groups", "n_overlaps", "groups", "links"]


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_overlaps, groups, links) of each row.

    groups: `a1,a2|b1;a3|b2,b3`, the decimal ids of each group in order. links: a place in `Vocabularies.pairs` for each
    pair of tokens that end together, in order.
    """
    files = _files(docs, path_a, path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pairs, digits = vocabularies(*files.value)
        for chunk in text_chunks(batches, limit=CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays([chunk.column("id"), *_aligned(chunk.column("text").to_pylist(), own, pairs, digits)], ["id", *COLUMNS])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_overlaps bigint, groups string, links array<int>"
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema).withColumnRenamed("id", id_col)


def link_counts(aligned: DataFrame, n_pairs: int) -> np.ndarray:
    """How many links of all rows hold each pair; n_pairs numbers, a bound that the vocabularies give."""
    length = -(-n_pairs // LANES) * LANES

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        held = np.zeros(length, np.int64)
        for batch in batches:
            held += np.bincount(batch.column("links").flatten().to_numpy(zero_copy_only=False), minlength=length)
        return held

    return sketch(aligned.select("links"), length, run)[:n_pairs]


def score_links(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """aligned (saved, as it is read twice) with n_links, n_best and count_sum in place of links.

    A pair's count is the number of links of all rows that hold it. n_best: links whose count is the highest of their B
    token; count_sum: the sum of the counts of the row's links.
    """
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        own, pairs, _ = vocabularies(a.read(), b.read())
    counts = link_counts(aligned, len(pairs))
    token = pairs % len(own.b)
    highest = np.zeros(len(own.b), np.int64)
    np.maximum.at(highest, token, counts)
    shared = aligned.sparkSession.sparkContext.broadcast((counts, counts == highest[token]))  # len(pairs) entries
    names = [c for c in aligned.columns if c != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for batch in batches:
            lists = batch.column("links")
            n = np.diff(np.asarray(lists.offsets))
            flat, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)
            total = np.zeros(len(n), np.int64)
            np.add.at(total, row, counts[flat])
            new = [n.astype(np.int64), np.bincount(row, best[flat], len(n)).astype(np.int64), total]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(x) for x in new], [*names, "n_links", "n_best", "count_sum"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name != "links")
    return map_batches(aligned, run, f"{kinds}, n_links bigint, n_best bigint, count_sum bigint")
