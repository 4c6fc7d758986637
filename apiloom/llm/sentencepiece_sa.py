"""SentencePiece encoding and decoding with a suffix array of the batch text.

The distinct stretches of a batch (a run of blanks with the word after it; a stretch holds every place at which pieces
of the vocabulary can meet, since no piece has a blank after another character) are laid end to end and indexed: all
suffixes are sorted by the longest piece's length, and every piece of the vocabulary is looked up by two binary
searches, all pieces at once. The occurrence ranges give the edges (start, stop, piece), sorted by position. Relaxing
them in the order of the model then yields its segmentation: in a byte-pair model, the best-scored edge that joins two
neighbouring symbols of a stretch (leftmost of equals) is taken again and again until none is left. All short
stretches take one step together in numpy; a stretch longer than 48 characters keeps its edges in a heap.
Characters without a piece become their UTF-8 bytes as byte pieces.

Encodings of stretches are kept from batch to batch, up to 200,000 stretches or 8 million characters; that only saves work.

Defined results: null has null ids and no tokens; the empty text has an empty list; the encoding of a text decodes to it
exactly, but for the blank's own sign (U+2581) in a text, which the model itself reads as a blank; repeated rows and
other columns are kept as they are, but columns named `ids`, `n_tokens` or `round_trip` are replaced. A model that is not
a byte-pair one is refused.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apiloom.llm.common import documents, in_batches, slices

SPACE = "▁"
_LONG = 48
_REMEMBER, _REMEMBER_CHARS = 200_000, 8_000_000
_NONE = -(2.0**60)


class Vocabulary:
    """Pieces and scores of a byte-pair SentencePiece model with byte fallback and no text normalisation."""

    def __init__(self, path: str):
        import sentencepiece  # only to read the vocabulary file

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes_of: list[bytes] = []
        plain = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                plain.append((piece, i, model.get_score(i)))
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        if any(s != round(s) for _, _, s in plain):
            raise ValueError("not a byte-pair model: its scores are not ranks")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, _ in plain):
            raise ValueError("a piece spans a blank: stretches cannot be encoded on their own")
        self.longest = max(len(p) for p, _, _ in plain)
        self.ids = np.array([i for _, i, _ in plain], np.int32)
        self.scores = np.array([s for _, _, s in plain])
        self.lengths = np.array([len(p) for p, _, _ in plain])
        alphabet = sorted({c for p, _, _ in plain for c in p})
        # characters as codes in code-point order; 0 ends a stretch, unknown characters share the top code
        self.top = len(alphabet) + 1
        if self.top >= 0x7FFF:
            raise ValueError("more than 32,766 characters in the vocabulary")
        self.code_of = np.full(0x110000, self.top, np.uint16)
        self.code_of[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.single = np.full(self.top + 1, -1, np.int32)
        for p, i, _ in plain:
            if len(p) == 1:
                self.single[self.code_of[ord(p)]] = i
        self.rows = np.zeros((len(plain), self.longest), np.uint16)
        for r, (p, _, _) in enumerate(plain):
            self.rows[r, : len(p)] = self.code_of[np.frombuffer(p.encode("utf-32-le"), np.uint32)]
        self.many = self.lengths > 1
        # a character in no longer piece ends a stretch by itself
        joint = {c for p, _, _ in plain if len(p) > 1 for c in p}
        self.alone = "" if "\n" in joint else "\n"

    def stretches(self, text: str) -> list[str]:
        return self._split(SPACE + text.replace(" ", SPACE)) if text else []

    @property
    def _split(self):
        a = self.alone
        return re.compile(f"{SPACE}+[^{SPACE}{a}]*|[^{SPACE}{a}]+|\n").findall


def _packed(code: np.ndarray, bits: int, keys: int) -> list[np.ndarray]:
    """The codes from each place on as 64-bit keys that compare like strings (places run along the last axis)."""
    each = 64 // bits
    span, have = code.astype(np.uint64), bits
    while have < 64:
        step = have // bits
        nearer = np.zeros_like(span)
        nearer[..., :-step] = span[..., step:]
        span = (span << np.uint64(have)) | nearer
        have *= 2
    return [span[..., j * each :] for j in range(keys)]


def _search(keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """For all wanted keys at once, how many sorted suffixes are smaller (or not larger): a binary search."""
    n = len(keys[0])
    low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), n, np.int64)
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        at = np.minimum(middle, n - 1)
        less, same = np.zeros(len(low), bool), np.ones(len(low), bool)
        for k, w in zip(keys, wanted, strict=True):
            have = k[at]
            less |= same & (have < w)
            same &= have == w
        below = less | same if right else less
        low = np.where(open_ & below, middle + 1, low)
        high = np.where(open_ & ~below, middle, high)
    return low


def edges(vocabulary: Vocabulary, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences of pieces of two or more characters in the indexed text: start, length and piece, by start.

    The characters of a batch are few, so mostly one byte each holds them; pieces with others cannot occur.
    """
    v = vocabulary
    present = np.zeros(v.top + 1, bool)
    present[code] = True
    present[0] = True
    local = np.cumsum(present) - 1
    bits = 8 if local[-1] < 255 else 16
    each = 64 // bits
    keys_n = -(-v.longest // each)
    possible = np.flatnonzero(v.many & present[v.rows].all(1))
    n = len(code)
    padded = np.concatenate([local[code], np.zeros(keys_n * each, np.int64)])
    keys = [k[:n] for k in _packed(padded, bits, keys_n)]
    places = np.flatnonzero(code)
    suffix = places[np.lexsort([k[places] for k in keys[::-1]])]
    keys = [k[suffix] for k in keys]
    rows = np.zeros((len(possible), keys_n * each), np.int64)
    rows[:, : v.longest] = local[v.rows[possible]]
    first = lambda m: [k[:, 0].copy() for k in _packed(m, bits, keys_n)]
    low = _search(keys, first(rows), False)
    rows[np.arange(keys_n * each) >= v.lengths[possible][:, None]] = (1 << bits) - 1
    high = _search(keys, first(rows), True)
    many = high - low
    piece = np.repeat(possible, many)
    start = suffix[np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]
    order = np.argsort(start * 64 + v.lengths[piece])
    return start[order], v.lengths[piece[order]], piece[order]


def _relax_heap(n: int, score_of: dict, out: np.ndarray, base: int) -> None:
    """Merge one long stretch: `score_of` has the score of each edge (start, stop); `out` gets each symbol's end."""
    nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(-s, a, b) for a in range(n - 1) if (s := score_of.get((a, a + 2))) is not None for b in (a + 2,)]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, a, b = heapq.heappop(heap)
        if not alive[a] or nxt[a] >= n or nxt[nxt[a]] != b:
            continue
        alive[nxt[a]] = False
        nxt[a] = b
        if b < n:
            prev[b] = a
            if (s := score_of.get((a, nxt[b]))) is not None:
                heapq.heappush(heap, (-s, a, nxt[b]))
        if prev[a] >= 0 and (s := score_of.get((prev[a], b))) is not None:
            heapq.heappush(heap, (-s, prev[a], b))
    for a in range(n):
        out[base + a] = base + nxt[a] if alive[a] else 0


def _relax_grid(first: np.ndarray, size: np.ndarray, look, end: np.ndarray) -> None:
    """Merge all stretches of one class of sizes together, one merge in each at a time."""
    if not len(first):
        return
    span = int(size.max())
    columns = np.arange(span)
    bounds = first[:, None] + np.arange(span + 1)  # ends of symbols, packed to the left
    count = size.copy()
    pairs = np.full((len(first), span), _NONE)
    row, col = np.nonzero(columns < count[:, None] - 1)
    pairs[row, col] = look(bounds[row, col], bounds[row, col] + 2)

    def settle(done: np.ndarray) -> None:
        row, col = np.nonzero(columns < count[done][:, None])
        end[bounds[done][row, col]] = bounds[done][row, col + 1]

    while len(bounds):
        best = pairs.argmax(1)
        rows = np.arange(len(bounds))
        some = pairs[rows, best] > _NONE
        if not some.all():
            settle(~some)
            bounds, pairs, count, best = bounds[some], pairs[some], count[some], best[some]
            rows = rows[: len(best)]
            if not len(rows):
                return
        # drop the boundary between the two symbols and shift the rest to the left
        move = columns > best[:, None]
        bounds[:, :-1] = np.where(move, bounds[:, 1:], bounds[:, :-1])
        pairs[:, :-1] = np.where(move[:, :-1], pairs[:, 1:], pairs[:, :-1])
        pairs[:, -1] = _NONE
        count -= 1
        pairs[rows, best] = _NONE
        after = np.flatnonzero(best + 1 < count)
        at = best[after]
        pairs[after, at] = look(bounds[after, at], bounds[after, at + 2])
        before = np.flatnonzero(best > 0)
        at = best[before] - 1
        pairs[before, at] = look(bounds[before, at], bounds[before, at + 2])


def relax(vocabulary: Vocabulary, start: np.ndarray, length: np.ndarray, piece: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Take edges in the model's order. Returns the starts of the final symbols and their ends, by position."""
    v = vocabulary
    total = int(begin[-1] + sizes[-1]) if len(begin) else 0
    end = np.zeros(total + 2, np.int64)
    key = start * 64 + length
    score = v.scores[piece]

    def look(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wanted = a * 64 + (b - a)
        at = np.minimum(np.searchsorted(key, wanted), max(0, len(key) - 1))
        good = (b - a <= v.longest) & (key[at] == wanted) if len(key) else np.zeros(len(a), bool)
        return np.where(good, score[at] if len(key) else 0, _NONE)

    for i in np.flatnonzero(sizes > _LONG):
        a, b = np.searchsorted(start, [begin[i], begin[i] + sizes[i]])
        own = {(int(s - begin[i]), int(s - begin[i] + n)): float(x) for s, n, x in zip(start[a:b], length[a:b], score[a:b], strict=True)}
        _relax_heap(int(sizes[i]), own, end, int(begin[i]))

    for low, high in ((2, 8), (9, 14), (15, _LONG)):
        short = (sizes >= low) & (sizes <= high)
        _relax_grid(begin[short], sizes[short], look, end)
    one = sizes == 1
    end[begin[one]] = begin[one] + 1
    starts = np.flatnonzero(end[:total])
    return starts, end[starts]


class Encoder:
    """Encodes batches of texts; remembers the encodings of stretches seen before."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.characters = 0
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.tokens = np.zeros(0, np.int32)

    def _learn(self, new: list[str]) -> None:
        v = self.vocabulary
        raw = np.frombuffer("\0".join([*new, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(s) for s in new])
        begin = np.cumsum(sizes + 1) - sizes - 1
        code = v.code_of[raw]
        code[begin + sizes] = 0
        start, length, piece = edges(v, code)
        inside = code[start + length - 1] > 0
        start, length, piece = start[inside], length[inside], piece[inside]
        at, stop = relax(v, start, length, piece, begin, sizes)
        width = stop - at
        token = v.single[code[at]].copy()
        token[code[at] == v.top] = -1
        wide = width > 1
        token[wide] = v.ids[piece[np.searchsorted(start * 64 + length, at[wide] * 64 + width[wide])]]
        owner = np.searchsorted(begin, at, "right") - 1
        lost = np.flatnonzero(token < 0)
        if len(lost):  # characters without a piece: their bytes
            spelled = [np.array(v.byte_ids[np.frombuffer(chr(int(raw[at[i]])).encode("utf-8", "surrogatepass"), np.uint8)]) for i in lost]
            times = np.ones(len(token), np.int64)
            times[lost] = [len(s) for s in spelled]
            where = np.cumsum(times) - times
            token, owner = np.repeat(token, times), np.repeat(owner, times)
            for i, s in zip(lost, spelled, strict=True):
                token[where[i] : where[i] + len(s)] = s
        count = np.bincount(owner, minlength=len(new))
        self.first = np.concatenate([self.first, len(self.tokens) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.tokens = np.concatenate([self.tokens, token.astype(np.int32)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets of each text."""
        if len(self.known) > _REMEMBER or self.characters > _REMEMBER_CHARS:
            self._forget()
        known = self.known
        before = len(known)
        index, words = [], []
        for t in texts:
            found = self.vocabulary.stretches(t)
            words.append(len(found))
            index += [known.setdefault(s, len(known)) for s in found]
        if len(known) > before:
            new = list(known)[before:]
            self.characters += sum(map(len, new))
            self._learn(new)
        index = np.array(index, np.int64)
        many = self.count[index] if len(index) else np.zeros(0, np.int64)
        after = np.concatenate([[0], np.cumsum(many)])
        ids = self.tokens[np.arange(after[-1]) - np.repeat(after[:-1], many) + np.repeat(self.first[index], many)] if len(index) else np.zeros(0, np.int32)
        return ids, after[np.concatenate([[0], np.cumsum(words)])]

    def decode(self, ids: list[int]) -> str:
        spelled = self.vocabulary.bytes_of
        data = b"".join([spelled[i] for i in ids])
        return data[1:].decode("utf-8", "surrogatepass") if data[:1] == b" " else data.decode("utf-8", "surrogatepass")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and model."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _shipped(spark: SparkSession, model: str) -> str:
    """Send the model file to the executors' own scratch space; returns the name under which they find it."""
    spark.sparkContext.addFile(model)
    return model.rpartition("/")[2]


def encode(docs: DataFrame, model: str, *, text_col: str = "text", round_trip: bool = False, drop_text: bool = False) -> DataFrame:
    """The rows with `ids` (array of int) and `n_tokens`; with `round_trip`, whether the ids decode to the text."""
    name = _shipped(docs.sparkSession, model)
    extra = ["ids", "n_tokens", *(["round_trip"] if round_trip else [])]
    rows = docs.drop(*extra)
    kept = [f for f in rows.schema if not (drop_text and f.name == text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(SparkFiles.get(name))
        for batch in slices(batches, text_col, 1_000_000):
            texts = batch.column(text_col).to_pylist()
            ids, offsets = coder.encode([t or "" for t in texts])
            null = np.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array(null) if null.any() else None)
            columns = [batch.column(f.name) for f in kept] + [lists, pa.array(np.diff(offsets), pa.int64())]
            if round_trip:
                flat = ids.tolist()
                columns.append(pa.array([None if t is None else coder.decode(flat[a:b]) == t for t, a, b in zip(texts, offsets, offsets[1:], strict=False)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + extra)

    declared = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["ids array<int>", "n_tokens long", "round_trip boolean"][: len(extra)]
    return in_batches(rows, run, ", ".join(declared))


def decode(rows: DataFrame, model: str, *, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """The rows with the text of their ids; null ids give null."""
    name = _shipped(rows.sparkSession, model)
    kept = [f for f in rows.schema if f.name != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(SparkFiles.get(name))
        for batch in batches:
            texts = [None if x is None else coder.decode(x) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(texts, pa.string())], names=[f.name for f in kept] + [to])

    return in_batches(rows, run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{to}` string"]))


def model_path() -> str:
    """The public 32,000-piece byte-pair model that the queries use; operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to the text."""
    return encode(documents(spark, sf_dir).select("doc_id", "text"), model_path(), round_trip=True, drop_text=True)
