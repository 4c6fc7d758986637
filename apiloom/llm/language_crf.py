"""Language identification of words with a linear-chain conditional random field.

Words are the runs of letters of a text, lower-cased. The emission score of a word adds hashed weights of its affixes
(first and last two and three letters), its letter bigrams and trigrams, and the word itself (the lexicon). Transition
weights between languages are learned with them, from sequences that splice stretches of labelled texts of different
languages, so that the chain learns how rarely text switches. Forward-backward over a whole text gives each word's
language marginals; the language of a text is the one with the largest mean marginal, and that mean is its score.

A text is one chain, whatever its length: it is cut into blocks of 64 words, block transfer matrices carry the exact
forward and backward messages across blocks, and all blocks of a slice of texts are computed together in numpy.

The model is fitted on at most `per_language` labelled texts of each language (default 150, the smallest hashes of id
and text) and at most `max_texts` in all (default 6,000, but one of each language), of each at most its first
`max_chars` characters (default 4,000); texts within that length come first. Every language can be predicted, and
everything else runs over all rows and whole texts.

Defined results: a text that is null or without a letter is `und` with score 0; a model without labels answers `und`;
rows with a null or repeated id are predicted like others; ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apiloom.llm.common import documents, in_batches, slices
from apiloom.llm.shingles import powers

BUCKETS = 1 << 16
BLOCK = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Salts of the feature families: bigram, trigram, prefixes, suffixes, lexicon.
_SALTS = {"bi": 1, "tri": 2, "pre2": 3, "pre3": 4, "suf2": 5, "suf3": 6, "lex": 7}


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # families * BUCKETS rows, a column for each language
    transition: np.ndarray  # log weights, from row to column


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it a letter, and its one-letter lower case."""
    alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(alpha):
        low = chr(i).lower()
        if len(low) == 1:
            lower[i] = ord(low)
    return alpha, lower


def _bucket(salt: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), salt * 0x51ED2701, np.uint64)
    for p in parts:
        h = (h ^ p) * _ODD
        h ^= h >> np.uint64(29)
    return ((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32) + (salt - 1) * BUCKETS


def words(texts: list[str]) -> dict[str, np.ndarray]:
    """Words of all texts: document, start and stop of each, and the buckets of its features."""
    alpha_of, lower_of = _letters()
    code = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    alpha = alpha_of[code]
    low = lower_of[code].astype(np.uint64)
    low[~alpha] = 0
    edge = np.diff(alpha.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.flatnonzero(alpha)
    back1 = np.where(at > 0, low[at - 1], 0)
    back2 = np.where((at > 1) & (back1 > 0), low[at - 2], 0)
    here = low[at]
    pad = np.concatenate([low, np.zeros(3, np.uint64)])
    second = pad[start + 1]
    third = np.where(second > 0, pad[start + 2], 0)
    last, last2 = low[stop - 1], np.where(stop - start > 1, low[stop - 2], 0)
    last3 = np.where(stop - start > 2, low[np.maximum(stop - 3, 0)], 0)
    # a polynomial hash of each whole word, from running sums
    up, down = powers(len(at) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(here * up[:-1])])
    first = np.concatenate([[0], np.cumsum(stop - start)])
    whole = (sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]]
    return {
        "doc": np.searchsorted(begin, start, "right") - 1,
        "start": start,
        "stop": stop,
        "begin": begin,
        "first": first[:-1],
        "grams": np.stack([_bucket(1, back1, here), _bucket(2, back2, back1, here)], 1),
        "affix": np.stack(
            [
                _bucket(3, low[start], second),
                _bucket(4, low[start], second, third),
                _bucket(5, last2, last),
                _bucket(6, last3, last2, last),
                _bucket(7, whole, (stop - start).astype(np.uint64)),
            ],
            1,
        ),
    }


def emissions(found: dict[str, np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Scores of each word for each language."""
    first, letters = found["first"], len(found["grams"])
    out = np.zeros((len(first), weights.shape[1]), np.float32)
    at = 0
    while at < len(first):  # some 200,000 letters at a time, so that memory does not follow one long text times languages
        stop = max(at + 1, int(np.searchsorted(first, first[at] + 200_000)))
        a, b = first[at], first[stop] if stop < len(first) else letters
        grams = weights[found["grams"][a:b, 0]]
        grams += weights[found["grams"][a:b, 1]]
        out[at:stop] = np.add.reduceat(grams, first[at:stop] - a, axis=0)
        at = stop
    for j in range(found["affix"].shape[1]):
        out += weights[found["affix"][:, j]]
    return out


def marginals(scores: np.ndarray, doc: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Forward-backward over each document's chain (scores by word, words sorted by document)."""
    n, k = scores.shape
    if not n:
        return scores
    step = np.exp(transition - transition.max()).astype(np.float32)
    e = np.exp(scores - scores.max(1, keepdims=True)) + np.float32(1e-12)
    new = np.r_[True, doc[1:] != doc[:-1]]
    doc_first = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(doc_first, np.diff(np.r_[doc_first, n]))
    block_first = np.flatnonzero(place % BLOCK == 0)
    size = np.diff(np.r_[block_first, n])
    order = np.argsort(-size, kind="stable")  # longest first: the blocks with a word at step t are a prefix
    begin, size = block_first[order], size[order]
    active = np.searchsorted(-size, -np.arange(1, BLOCK + 1), "right")
    norm = lambda x: x / x.sum(-1, keepdims=True)

    carry = np.tile(np.eye(k, dtype=np.float32), (len(begin), 1, 1))
    for t in range(BLOCK):
        if not (a := active[t]):
            break
        moved = (carry[:a].reshape(-1, k) @ step).reshape(a, k, k) * e[begin[:a] + t][:, None, :]
        carry[:a] = moved / moved.sum((1, 2), keepdims=True)
    carry = carry[np.argsort(order)]  # by block, in text order

    # messages across the blocks of each document, all documents at once
    number = place[block_first] // BLOCK
    doc_block = np.flatnonzero(number == 0)
    blocks = np.diff(np.r_[doc_block, len(number)])
    enter = np.full((len(number), k), 1 / k, np.float32)
    leave = np.full((len(number), k), 1 / k, np.float32)
    longest = np.argsort(-blocks, kind="stable")
    head, count = doc_block[longest], blocks[longest]
    for j in range(1, int(count[0])):
        b = head[: np.searchsorted(-count, -j, "left")] + j
        enter[b] = norm(np.einsum("bi,bij->bj", enter[b - 1], carry[b - 1]))
    tail = head + count - 1
    for j in range(1, int(count[0])):
        b = tail[: np.searchsorted(-count, -j, "left")] - j
        leave[b] = norm(np.einsum("bij,bj->bi", carry[b + 1], leave[b + 1]))

    forward = np.empty((n, k), np.float32)
    state = enter[order]
    for t in range(BLOCK):
        if not (a := active[t]):
            break
        state[:a] = norm((state[:a] @ step) * e[begin[:a] + t])
        forward[begin[:a] + t] = state[:a]
    state = leave[order]
    back = step.T.copy()
    for t in range(BLOCK - 1, -1, -1):
        if a := active[t]:
            at = begin[:a] + t
            forward[at] *= state[:a]
            state[:a] = norm((state[:a] * e[at]) @ back)
    return norm(forward)


def _expected_moves(scores: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals (sequence, place, language) and summed transition marginals of equal-length sequences."""
    n, length, k = scores.shape
    step, e = np.exp(transition), np.exp(scores - scores.max(2, keepdims=True))
    forward, backward = np.empty_like(e), np.ones_like(e)
    state = np.full((n, k), 1 / k, np.float32)
    for t in range(length):
        state = (state @ step) * e[:, t]
        state /= state.sum(1, keepdims=True)
        forward[:, t] = state
    moves = np.zeros((k, k))
    for t in range(length - 1, 0, -1):
        ahead = e[:, t] * backward[:, t]
        pair = forward[:, t - 1, :, None] * step[None] * ahead[:, None, :]
        moves += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        state = ahead @ step.T
        backward[:, t - 1] = state / state.sum(1, keepdims=True)
    both = forward * backward
    return both / both.sum(2, keepdims=True), moves


def train(texts: list[str], labels: list[str], *, rounds: int = 30, length: int = 32, rate: float = 0.3, l2: float = 1e-6, seed: int = 0) -> Model:
    """Fit emissions and transitions by adaptive gradient ascent on the conditional likelihood of spliced sequences."""
    languages = sorted(set(labels))
    k = len(languages)
    weights = np.zeros((len(_SALTS) * BUCKETS, max(1, k)), np.float32)
    transition = np.zeros((max(1, k), max(1, k)), np.float32)
    if k < 2:
        return Model(languages, weights, transition)
    found = words(texts)
    n = len(found["first"])
    gold = np.array([languages.index(x) for x in labels])[found["doc"]]
    rng = np.random.default_rng(seed)
    # stretches of 4 to 32 words, in random order, laid end to end and cut into sequences of equal length
    cuts = np.unique(np.concatenate([np.flatnonzero(np.r_[True, np.diff(found["doc"]) != 0]), np.cumsum(rng.integers(4, 33, n // 4 + 1))]))
    cuts = cuts[cuts < n]
    pieces = list(zip(cuts, np.r_[cuts[1:], n], strict=True))
    rng.shuffle(pieces)
    line = np.concatenate([np.arange(a, b) for a, b in pieces]) if pieces else np.zeros(0, int)
    rows = len(line) // length
    if not rows:
        length, rows = max(1, len(line)), min(1, len(line))
    line = line[: rows * length].reshape(rows, length)
    truth = gold[line]
    real = np.zeros((k, k))
    np.add.at(real, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
    squares, move_squares = np.full_like(weights, 1e-6), np.full_like(transition, 1e-6)
    char_word = np.repeat(np.arange(n), found["stop"] - found["start"])
    flat = np.concatenate([found["grams"].T.ravel(), found["affix"].T.ravel()])
    owner = np.concatenate([char_word, char_word, *[np.arange(n)] * found["affix"].shape[1]])
    for _ in range(rounds):
        scores = emissions(found, weights)
        p, moves = _expected_moves(scores[line], transition)
        miss = -p
        np.put_along_axis(miss, truth[:, :, None], np.take_along_axis(miss, truth[:, :, None], 2) + 1, 2)
        by_word = np.zeros((n, k), np.float32)
        by_word[line.ravel()] = miss.reshape(-1, k)
        gradient = np.stack([np.bincount(flat, by_word[owner, j], len(weights)) for j in range(k)], 1).astype(np.float32)
        gradient -= l2 * n * weights
        squares += gradient**2
        weights += rate * gradient / np.sqrt(squares)
        step = (real - moves).astype(np.float32)
        move_squares += step**2
        transition += rate * step / np.sqrt(move_squares)
    return Model(languages, weights, transition)


def _held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 150, max_texts: int = 6000, max_chars: int = 4000) -> DataFrame:
    """(text, lang) of the labelled rows to fit on, none of them held out, in a fixed order.

    Hashes are ranked first (each task keeps its own best), and only the texts of the chosen ones are fetched.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~_held_out(id_col))
    known = known.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("place"))
    languages = known.select("lang").distinct().count()
    each = max(1, min(per_language, max_texts // max(1, languages)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.char_length("text") > max_chars, "place"))
    chosen = known.withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "place")
    picked = known.join(F.broadcast(chosen.distinct()), ["lang", "place"]).dropDuplicates(["lang", "place"])
    return picked.orderBy("place", "lang").select(F.substring("text", 1, max_chars).alias("text"), "lang")


def fit(docs: DataFrame, **columns) -> Model:
    rows = training_rows(docs, **columns).collect()
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", spans: bool = False) -> DataFrame:
    """The rows without the text, with `lang_pred` and `score`; with `spans` also the language runs of the text:
    stretches of words with one most likely language, as (start, stop, lang, p) in code points."""
    kept = [f for f in docs.schema if f.name not in (text_col, "lang_pred", "score", "lang_spans")]
    rows = docs.select(*[f"`{f.name}`" for f in kept], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string()), ("p", pa.float64())]))

    def runs(found: dict, p: np.ndarray, n: int, languages: list[str]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(n)]
        best = p.argmax(1)
        cuts = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (found["doc"][1:] != found["doc"][:-1])]) if len(best) else []
        for a, b in zip(cuts, [*cuts[1:], len(best)] if len(best) else [], strict=True):
            d = found["doc"][a]
            base = found["begin"][d]
            out[d].append({"start": int(found["start"][a] - base), "stop": int(found["stop"][b - 1] - base), "lang": languages[best[a]], "p": float(p[a:b, best[a]].mean())})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in slices(batches, "__text", 1_000_000):
            texts = batch.column("__text").to_pylist()
            found = words(texts)
            p = marginals(emissions(found, m.weights), found["doc"], m.transition)
            n = np.bincount(found["doc"], minlength=len(texts))
            mass = np.stack([np.bincount(found["doc"], p[:, j], len(texts)) for j in range(p.shape[1])], 1) / np.maximum(n, 1)[:, None]
            best = mass.argmax(1)
            known = (n > 0) & (len(m.languages) > 0)
            lang = [m.languages[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
            score = np.where(known, np.clip(mass[np.arange(len(texts)), best], 0, 1), 0.0)
            columns = [batch.column(f.name) for f in kept] + [pa.array(lang), pa.array(score, pa.float64())]
            names = [f.name for f in kept] + ["lang_pred", "score"]
            if spans:
                columns.append(pa.array(runs(found, p, len(texts), m.languages) if m.languages else [[]] * len(texts), span))
                names.append("lang_spans")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    declared = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double"]
    if spans:
        declared.append("lang_spans array<struct<start:int,stop:int,lang:string,p:double>>")
    return in_batches(rows, run, ", ".join(declared))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document and its stretches of one language, by a model that saw no held-out row."""
    docs = documents(spark, sf_dir)
    model = fit(docs)
    out = predict(docs.select("doc_id", "text"), model, spans=True)
    return out.select("doc_id", _held_out("doc_id").alias("held_out"), "lang_pred", "score", "lang_spans")
