"""Language of a text by a linear-chain conditional random field over its words.

Words are runs of letters (with their marks); their labels are languages. A word's features are hashed n-grams of its
lower-cased characters with its edges (orders 1 to 3), its prefixes and suffixes of 4 characters, and the word itself
(the lexicon). Labels of neighbouring words are tied by learned transitions. A text is one chain; forward-backward gives
each word's marginals, and the text's language is the one with the largest sum of them, its share the score.

Fit: a bounded sample (`per_lang` documents of each language by the hash of their ids, `pieces` runs of words of each).
Runs of different languages are put together into code-switched chains, so that transitions are learned from switches
whose places are known. PARTS tasks learn from equal shares by AdaGrad on the negated log-likelihood, for ROUNDS rounds,
after each of which their parameters are averaged; only parameters, of fixed size for a language, come to the driver.

Score: one pass over all whole texts. The words of a chunk are featurised once for each distinct word, and all chains of
a chunk run together: the chunk's words are cut into columns of equal length, the product of each column is taken for
all columns at once, and joined up, so no step waits for a text's length. A chain starts anew at each text.

Edge cases: null texts and texts without letters are `und` with score 0, as is every text where nothing can be learned
(no row with id, text and lang outside the held-out ids); with one language that is the answer, score 1; null ids are
scored but never learned from; of rows with equal ids one of the smallest text is learned from; of equal sums the first
language by code point wins; repeated rows score equally; words and texts of any length count whole; extra columns are
ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, mix, save, text_chunks
from .toxicity import held_out

BITS = 16
PER_LANG, PIECES, PIECE_WORDS = 400, 4, 12
CHAIN_PIECES, PARTS, ROUNDS, EPOCHS, BATCH = 4, 4, 3, 3, 32
RATE, DECAY = 0.3, 1e-6
LOT = 4096
_EDGE = 1  # a character that no word holds
_table: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """For each code point 2 if it is a letter, 1 if it is a mark, else 0."""
    if not _table:
        import unicodedata

        _table.append(np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8))
    return _table[0]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, start and end of each word in them, and each text's first word (n + 1)."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[codes]
    inside = np.concatenate([[False], kind > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    letters = np.concatenate([[0], np.cumsum(kind == 2)])
    some = letters[end] > letters[start]  # marks alone are no word
    start, end = start[some], end[some]
    return codes, start, end, np.searchsorted(start, np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])]))


def features_of(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features by distinct word: (distinct word of each occurrence, word of each feature, bucket of each feature)."""
    size = end - start
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    letters = codes[np.repeat(start, size) + inside].astype(np.uint64)
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(mix(letters + np.uint64(77)) * _powers(int(size.max(initial=0)) + 1)[inside], out=sums[1:])
    at = np.concatenate([[0], np.cumsum(size)])
    whole, first, word = np.unique(mix(sums[at[1:]] - sums[at[:-1]] + size.astype(np.uint64)), return_index=True, return_inverse=True)
    size, at = size[first], at[first]
    # each distinct word between two edges, one after another
    width = size + 2
    own = np.repeat(np.arange(len(first)), width)
    place = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    left = width[own] - place
    flat = np.full(len(own), _EDGE, np.uint64)
    middle = np.flatnonzero((place > 0) & (left > 1))
    flat[middle] = letters[at[own[middle]] + place[middle] - 1]
    owner, bucket = [np.arange(len(first))], [whole]
    pos, gram = np.arange(len(own)), np.zeros(len(own), np.uint64)
    for n in range(1, 6):
        keep = left[pos] >= n
        pos, gram = pos[keep], gram[keep]
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + flat[pos + n - 1] + np.uint64(n)
        told = flat[pos] != _EDGE if n == 1 else np.full(len(pos), n < 4) if n < 5 else (place[pos] == 0) | (left[pos] == n)
        owner.append(own[pos[told]])
        bucket.append(gram[told])
    return word, np.concatenate(owner), (mix(np.concatenate(bucket)) >> np.uint64(64 - BITS)).astype(np.int64)


_grown = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_grown[0]) < n:
        more = np.full(max(n, 256), np.uint64(0xD6E8FEB86659FD93))
        more[0] = 1
        _grown[0] = np.multiply.accumulate(more)
    return _grown[0]


@dataclass
class Crf:
    """Languages, a weight for each bucket and language, of each start and of each pair of neighbouring labels."""

    langs: list[str]
    weights: np.ndarray
    start: np.ndarray
    steps: np.ndarray

    def emissions(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's score for each language, and each text's first word."""
        codes, begin, end, first = words_of(texts)
        word, owner, bucket = features_of(codes, begin, end)
        n = int(word.max(initial=-1)) + 1
        scores = np.stack([np.bincount(owner, self.weights[bucket, k], n) for k in range(len(self.langs))], 1)
        return scores[word], first


def _normal(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    return x / np.maximum(x.sum(axes, keepdims=True), 1e-300)


def _scan(local: np.ndarray, fresh: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Normalised forward vectors of all chains at once.

    local (n, L): the factor of each word; fresh (n): whether a chain starts at it. A step's matrix is step * local, at
    a fresh word one whose rows are all start * local, so that what came before does not matter.
    """
    n, size = local.shape
    columns = max(1, int(np.sqrt(n)))
    length = -(-n // columns)
    pad = columns * length - n
    local = np.concatenate([local, np.ones((pad, size))]).reshape(columns, length, size)
    fresh = np.concatenate([fresh, np.ones(pad, bool)]).reshape(columns, length)
    ones = np.broadcast_to(start, (size, size))
    moves = np.stack([step, ones])
    pick = fresh.astype(np.int64)
    whole = np.broadcast_to(np.eye(size), (columns, size, size))
    for t in range(length):  # the product of each column, for all columns at once
        whole = _normal(whole @ (moves[pick[:, t]] * local[:, t, None, :]), (1, 2))
    into = np.empty((columns, size))
    state = np.full(size, 1 / size)
    for c in range(columns):
        into[c] = state
        state = _normal(state @ whole[c], (0,))
    out = np.empty_like(local)
    state = into
    for t in range(length):
        state = _normal(np.einsum("cl,clm->cm", state, moves[pick[:, t]]) * local[:, t], (1,))
        out[:, t] = state
    return out.reshape(-1, size)[:n]


def marginals(model: Crf, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The probability of each language at each word, by forward-backward over the chains that start at `first`."""
    n = len(scores)
    if not n:
        return np.zeros((0, len(model.langs)))
    local = np.exp(scores - scores.max(1, keepdims=True))
    fresh, last = np.zeros(n, bool), np.zeros(n, bool)
    begin = first[:-1][first[:-1] < first[1:]]
    fresh[begin] = True
    last[np.append(begin[1:], n) - 1] = True
    start, step = np.exp(model.start - model.start.max()), np.exp(model.steps - model.steps.max())
    ahead = _scan(local, fresh, start, step)
    behind = _scan(local[::-1], last[::-1], np.ones(len(start)), step.T)[::-1] / np.maximum(local, 1e-300)
    return _normal(ahead * behind, (1,))


def predict(model: Crf, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The language of each text and the share of its words' marginals that it has."""
    if not model.langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    scores, first = model.emissions(texts)
    sums = np.concatenate([np.zeros((1, len(model.langs))), np.cumsum(marginals(model, scores, first), 0)])
    share = sums[first[1:]] - sums[first[:-1]]
    n = np.diff(first)
    best = share.argmax(1)
    some = n > 0
    value = np.clip(share[np.arange(len(n)), best] / np.maximum(n, 1), 0, 1)
    return [model.langs[k] if s else "und" for k, s in zip(best, some, strict=True)], np.where(some, value, 0.0)


# Learning


def gradient(weights: np.ndarray, start: np.ndarray, steps: np.ndarray, emission: np.ndarray, label: np.ndarray, real: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Negated log-likelihood of padded chains and its gradients by emission, start and steps.

    emission (b, t, L), label (b, t), real (b, t): which words are there; a chain's words come first.
    """
    b, t, size = emission.shape
    ahead, behind = np.zeros_like(emission), np.zeros_like(emission)
    ahead[:, 0] = start + emission[:, 0]
    for k in range(1, t):
        ahead[:, k] = np.where(real[:, k, None], np.logaddexp.reduce(ahead[:, k - 1, :, None] + steps, 1) + emission[:, k], ahead[:, k - 1])
    for k in range(t - 2, -1, -1):
        behind[:, k] = np.where(real[:, k + 1, None], np.logaddexp.reduce(steps + (emission[:, k + 1] + behind[:, k + 1])[:, None, :], 2), 0)
    total = np.logaddexp.reduce(ahead[:, -1], 1)
    node = np.exp(ahead + behind - total[:, None, None]) * real[:, :, None]
    rows = np.arange(b)[:, None]
    pair = np.zeros_like(steps)
    told = float(start[label[:, 0]].sum())
    for k in range(1, t):
        on = real[:, k]
        if on.any():
            joint = ahead[on, k - 1, :, None] + steps + (emission[on, k] + behind[on, k])[:, None, :] - total[on, None, None]
            pair += np.exp(joint).sum(0)
            np.add.at(pair, (label[on, k - 1], label[on, k]), -1)
            told += float(steps[label[on, k - 1], label[on, k]].sum())
    told += float((emission[rows, np.arange(t)[None], label] * real).sum())
    node[rows, np.arange(t)[None], label] -= real
    first = np.exp(ahead[:, 0] + behind[:, 0] - total[:, None]).sum(0) - np.bincount(label[:, 0], minlength=size)
    return float(total.sum()) - told, node, first, pair


def learn(pieces: list[str], langs: np.ndarray, size: int, seed: int, begin: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """AdaGrad from `begin` over chains of CHAIN_PIECES pieces, put together at random from all languages."""
    weights, start, steps = (x.copy() for x in begin)
    codes, at, end, first = words_of(pieces)
    word, owner, bucket = features_of(codes, at, end)
    by = np.argsort(owner, kind="stable")
    bucket = bucket[by]
    cut = np.searchsorted(owner[by], np.arange(int(word.max(initial=-1)) + 2))
    length = np.diff(first)
    usable = np.flatnonzero(length)
    if not len(usable):
        return weights, start, steps
    rng = np.random.default_rng(seed)
    seen = [np.full_like(x, 1e-3) for x in (weights, start, steps)]
    for _ in range(EPOCHS):
        order = rng.permutation(usable)
        chains = [order[a : a + CHAIN_PIECES] for a in range(0, len(order), CHAIN_PIECES)]
        for a in range(0, len(chains), BATCH):
            own = chains[a : a + BATCH]
            n = np.array([length[c].sum() for c in own])
            real = np.arange(n.max()) < n[:, None]
            which, label = np.zeros(real.shape, np.int64), np.zeros(real.shape, np.int64)
            flat = np.concatenate(own)
            which[real] = word[np.repeat(first[flat], length[flat]) + np.arange(n.sum()) - np.repeat(np.cumsum(length[flat]) - length[flat], length[flat])]
            label[real] = np.repeat(langs[flat], length[flat])
            count = (cut[which + 1] - cut[which])[real]
            cells = np.repeat(cut[which[real]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            held, back = np.unique(bucket[cells], return_inverse=True)
            owner_cell = np.repeat(np.arange(n.sum()), count)
            emission = np.zeros((*real.shape, size))
            emission[real] = np.stack([np.bincount(owner_cell, weights[held, k][back], n.sum()) for k in range(size)], 1)
            _, node, g_start, g_steps = gradient(weights, start, steps, emission, label, real)
            g = np.stack([np.bincount(back, node[real][owner_cell, k], len(held)) for k in range(size)], 1) + DECAY * weights[held]
            for x, d, s, i in ((weights, g, seen[0], held), (start, g_start, seen[1], slice(None)), (steps, g_steps, seen[2], slice(None))):
                s[i] += d * d
                x[i] -= RATE * d / np.sqrt(s[i])
    return weights, start, steps


def _share() -> Column:
    """A number from 0 to 1 for an id, by hash."""
    return (F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 31) - 1))) / F.lit(float(1 << 31))


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """(doc_id, lang, rank, pieces): runs of words of at most about per_lang documents of each language, saved."""
    known = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~held_out()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in known.select("lang", "doc_id").groupBy("lang").count().collect()}
    if not counts:
        return known.selectExpr("doc_id", "lang", "1 AS rank", "array('') AS pieces").where("false")
    wanted = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.2 * per_lang / n))])
    some = known.where(_share() <= F.element_at(wanted, F.col("lang")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            lists = []
            for text, i in zip(chunk.column("text").to_pylist(), chunk.column("doc_id").to_pylist(), strict=True):
                words = text.split()
                starts = sorted({int(x) % max(1, len(words) - PIECE_WORDS + 1) for x in mix(np.arange(PIECES, dtype=np.uint64) + np.uint64(i & 0xFFFFFFFF) * np.uint64(PIECES))})
                lists.append([" ".join(words[a : a + PIECE_WORDS])[:2000] for a in starts])
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("lang"), pa.array(lists, pa.list_(pa.string()))], ["doc_id", "lang", "pieces"])

    pieces = map_batches(some.withColumn("doc_id", F.col("doc_id").cast("bigint")), cut, "doc_id bigint, lang string, pieces array<string>")
    once = pieces.groupBy("doc_id", "lang").agg(F.min("pieces").alias("pieces"))
    ranked = once.selectExpr("doc_id", "lang", "pieces", "row_number() OVER (PARTITION BY lang ORDER BY xxhash64(doc_id), doc_id) AS rank")
    return save(ranked.where(F.col("rank") <= per_lang))


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Crf:
    """docs (doc_id, text, lang). Rows with a held-out id are not learned from."""
    rows = sample(docs, per_lang)
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    size = len(langs)
    now = np.zeros((1 << BITS, size)), np.zeros(size), np.zeros((size, size))
    if size < 2:
        return Crf(langs, *now)
    place = {x: i for i, x in enumerate(langs)}
    lots = save(rows.select((F.col("rank") % PARTS).alias("part"), "doc_id", "lang", F.explode("pieces").alias("piece")))

    def turn_of(turn: int, begin: Broadcast) -> Callable[[pa.Table], pa.Table]:
        def run(t: pa.Table) -> pa.Table:
            own = t.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
            done = learn(own["piece"].to_pylist(), np.array([place[x] for x in own["lang"].to_pylist()]), size, 97 * turn + own["part"][0].as_py(), begin.value)
            flat = np.concatenate([x.ravel() for x in done])
            lot = np.arange(-(-len(flat) // LOT))
            return pa.table([pa.array(lot, pa.int32()), pa.array([flat[i * LOT : (i + 1) * LOT].tobytes() for i in lot], pa.binary())], ["lot", "block"])

        return run

    for turn in range(ROUNDS):
        run = turn_of(turn, rows.sparkSession.sparkContext.broadcast(now))
        found = lots.groupBy("part").applyInArrow(run, "lot int, block binary").toArrow()  # PARTS models
        total, n = np.zeros(sum(x.size for x in now)), max(1, found["lot"].to_pylist().count(0))
        for lot, block in sorted(zip(found["lot"].to_pylist(), found["block"].to_pylist(), strict=True)):
            total[lot * LOT : lot * LOT + len(block) // 8] += np.frombuffer(block) / n
        cut = np.cumsum([x.size for x in now])
        now = tuple(part.reshape(x.shape) for part, x in zip(np.split(total, cut[:-1]), now, strict=True))
    return Crf(langs, *now)


def identify(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row, of its whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            lang, score = predict(shared.value, chunk.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([chunk.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def label_words(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words array<struct<word, lang, probability>>) of each row: the labels of code-switched text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for chunk in text_chunks(batches):
            texts = chunk.column("text").to_pylist()
            codes, start, end, first = words_of(texts)
            scores, _ = own.emissions(texts) if own.langs else (np.zeros((len(start), 1)), None)
            sure = marginals(own, scores, first) if own.langs else np.zeros((len(start), 1))
            lang = [own.langs[k] for k in sure.argmax(1)] if own.langs else ["und"] * len(start)
            word = [codes[a:b].tobytes().decode("utf-32-le") for a, b in zip(start, end, strict=True)]
            cells = pa.StructArray.from_arrays([pa.array(word, pa.string()), pa.array(lang, pa.string()), pa.array(sure.max(1, initial=0))], ["word", "lang", "probability"])
            yield pa.RecordBatch.from_arrays([chunk.column("id"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), cells)], ["id", "words"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, words array<struct<word: string, lang: string, probability: double>>").withColumnRenamed("id", id_col)
