"""BPE encoding and decoding with forced boundaries.

Two neighbouring byte symbols that stand side by side in no token of the vocabulary can never be merged into one token:
between them a cut is certain. A word is split at such places, its fragments are merged independently (and remembered,
as they recur far more often than words), and their ids are put together. The tokenizer's file is read by the driver
and sent to the tasks as one broadcast of fixed size; no tokenizer is trained.

Texts go through the tokenizers library's own normaliser and word splitter, so that its rules hold for any file of a
BPE model. Where a file's normaliser and splitter are those of NORMAL and SPLIT (checked), texts of plain Latin-1
characters are normalised and split here instead, which is faster. Models with options that change the merging, and
special tokens that take in what is beside them, are refused with an error. Special tokens in a text are taken as such.

Edge cases: null and empty texts have no ids and decode to an empty text; null ids keep their rows; repeated rows give
equal rows; words of any length are merged in n log n; extra columns are ignored; empty tables give none.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_chunks

REMEMBERED = 200_000

#: The normaliser and the splitter of a tokenizer's file that the quick way below was written for.
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
#: What a model may have; anything else changes how symbols are merged.
PLAIN = {"type": ("BPE",), "dropout": (None, 0, 0.0), "unk_token": (None, "<|endoftext|>"), "continuing_subword_prefix": (None, ""), "fuse_unk": (False, None), "byte_fallback": (False, None), "ignore_merges": (False, None)}

_LETTERS = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[" + _LETTERS + rb"]+|[0-9]|[^\s" + _LETTERS + rb"0-9]+")
_PLAIN = bytes(b for b in (*b"\t\n\r", *range(0x20, 0x7F), *range(0xA1, 0x100)) if b not in b"\xb2\xb3\xb9\xbc\xbd\xbe")
_LOWER = bytes(b + 32 if 65 <= b <= 90 or 0xC0 <= b <= 0xDE and b != 0xD7 else b for b in range(256))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Remembered(dict):
    """A dict that computes what it lacks. When it is half full it becomes the old half; what is used comes back."""

    def __init__(self, compute):  # noqa: ANN001
        super().__init__()
        self.compute, self.old = compute, {}

    def __missing__(self, key):  # noqa: ANN001, ANN204
        if len(self) >= REMEMBERED // 2:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        self[key] = value = self.compute(key) if value is None else value
        return value


class Bpe:
    """A byte-level BPE model with an end-of-word suffix, read from a tokenizers file's JSON."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        whole = json.loads(source)
        model = whole["model"]
        odd = [k for k, may in PLAIN.items() if model.get(k, may[0]) not in may]
        odd += [t["content"] for t in whole["added_tokens"] if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")]
        if odd:
            raise ValueError(f"this tokenizer's file has what is not built here: {', '.join(odd)}")
        self.quick = whole["normalizer"] == NORMAL and whole["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": SPLIT}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.special_starts = {t[0] for t in self.special}
        self.codes = {t: i.to_bytes(4, "little") for t, i in self.vocab.items()}
        self.strings = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        library = Tokenizer.from_str(source)
        self.normal, self.split, self.library = library.normalizer, library.pre_tokenizer, library if whole["decoder"] else None
        self.symbols = byte_symbols()
        self.inside = {p for t in self.vocab for p in self._pairs(self.units(t[: -len(self.suffix)], True) if self.suffix and t.endswith(self.suffix) else list(t))}
        self.fragments = Remembered(self._merge)
        self.words = Remembered(self._word)
        latin = {c: "".join(self.symbols[b] for b in chr(c).encode()) for c in range(256)}
        self.plain = Remembered(lambda w: self._word(w.decode("latin-1").translate(latin)))

    @staticmethod
    def _pairs(units: list[str]) -> Iterator[tuple[str, str]]:
        return zip(units, units[1:], strict=False)

    def units(self, word: str, ended: bool) -> list[str]:
        units = list(word)
        if ended and units:
            units[-1] += self.suffix
        return units

    def pieces(self, word: str) -> list[tuple[str, ...]]:
        """A word's fragments between its forced boundaries."""
        units, inside = self.units(word, True), self.inside
        cuts = [i for i, p in enumerate(zip(units, units[1:], strict=False), 1) if p not in inside]
        if not cuts:
            return [tuple(units)]
        return [tuple(units[a:b]) for a, b in zip([0, *cuts], [*cuts, len(units)], strict=True)]

    def _word(self, word: str) -> bytes:
        pieces = self.pieces(word)
        if len(pieces) == 1:  # remembered as a word
            return self._merge(pieces[0])
        return b"".join([self.fragments[p] for p in pieces])

    def _merge(self, units: tuple[str, ...]) -> bytes:
        """Ids of a fragment: always the lowest rank, then the leftmost pair."""
        if len(units) > 64:
            return self._merge_long(units)
        part, none, get = list(units), len(self.ranks), self.ranks.get
        ranks = [get(p, none) for p in self._pairs(part)]
        while ranks:
            rank = min(ranks)
            if rank == none:
                break
            i = ranks.index(rank)
            part[i : i + 2] = [part[i] + part[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((part[i - 1], part[i]), none)
            if i < len(ranks):
                ranks[i] = get((part[i], part[i + 1]), none)
        return b"".join([self.codes[t] for t in part])

    def _merge_long(self, units: tuple[str, ...]) -> bytes:
        """The same by a heap, for fragments of any length."""
        part: list[str | None] = list(units)
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, p) for i, p in enumerate(self._pairs(list(units))) if (r := self.ranks.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if part[i] is not None else n
            if j >= n or (part[i], part[j]) != pair:
                continue
            part[i], part[j] = pair[0] + pair[1], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self.ranks.get(p := (part[a], part[b]))) is not None:
                    heapq.heappush(heap, (r, a, p))
        return b"".join([self.codes[t] for t in part if t is not None])

    def _piece(self, text: str) -> bytes:
        if self.quick:
            try:
                raw = text.encode("latin-1")
                if not raw.translate(None, _PLAIN):
                    return b"".join(map(self.plain.__getitem__, _WORDS.findall(raw.translate(_LOWER))))
            except UnicodeEncodeError:
                pass
        words = self.split.pre_tokenize_str(self.normal.normalize_str(text) if self.normal else text)
        return b"".join([self.words[w] for w, _ in words])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(map(text.__contains__, self.special_starts)):
            return self._piece(text)
        return b"".join([np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._piece(p) for p in self.cut.split(text) if p])

    def decode(self, ids: bytes) -> str:
        """As the library: by the file's decoder, or without one the tokens' strings, joined by spaces."""
        if self.library:
            return self.library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def model_of(source: str) -> Bpe:
    return Bpe(source)


def _source(df: DataFrame, path: str):  # noqa: ANN202
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids) of each row, ids as little-endian unsigned 32-bit integers; with decoded, also what they decode to."""
    source = _source(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(source.value)
        for chunk in text_chunks(batches, limit=1 << 20):
            ids = [model.encode(t) for t in chunk.column("text").to_pylist()]
            more = [pa.array([model.decode(x) for x in ids], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([chunk.column("id"), pa.array(ids, pa.binary()), *more], ["id", "ids", *["decoded"] * decoded])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, ids binary" + ", decoded string" * decoded).withColumnRenamed("id", id_col)


def token_lists(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) of each row, ids as an array of integers."""
    source = _source(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(source.value)
        for chunk in text_chunks(batches, limit=1 << 20):
            raw = [model.encode(t) for t in chunk.column("text").to_pylist()]
            n = np.array([len(x) // 4 for x in raw], np.int64)
            flat = pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([chunk.column("id"), pa.array(n), lists], ["id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, n_tokens bigint, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of each row of ids; null ids decode to an empty text."""
    source = _source(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(source.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([model.decode(x or b"") for x in batch.column("ids").to_pylist()], pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_batches(encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, f"id {kind}, text string").withColumnRenamed("id", id_col)
