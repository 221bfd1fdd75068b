"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Merge-type (BPE) segmentation runs as an agenda of candidate merges, best score first, then leftmost. A candidate that
comes up is skipped with the dropout rate; it may come up again only when a neighbouring merge makes it anew. Whether it is
skipped is keyed by the seed, the document, the occurrence of the word in it and how many candidates came up in the word
before, so each occurrence is segmented by itself and runs repeat exactly. With rate 0 the result is the library's own.

No piece of the vocabularies used reaches over a word's beginning, so texts are cut there and each word is segmented by
itself, without the signs that follow its letters where no piece joins them. An occurrence's skips are a number whose bit t
stands for the candidate that comes up as the t-th. Each type of word is segmented once without skips; its occurrences
whose skips concern none of the candidates that came up then share that result, and all others are segmented one by one.
The agendas of many words run side by side in numpy, one candidate of each word a step.

Decoding joins pieces and bytes and is exact: characters without a piece become byte pieces, and so does the character
that stands for a space inside pieces, if a text holds it.

Defined cases: null and empty texts have no ids and decode to the empty text (null stays null in decode); repeated rows
with one doc_id are encoded alike; other columns are carried, and the column named for the result is replaced.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import giving_back, runs, utf8

MODEL = "piece_bpe_32k.model"
RATE = 0.1
SEED = 20
#: Types of words kept in a worker, about 100 MB; a worker forgets all of them when there are more.
MOST_TYPES = 400_000
#: At most three candidates a character come up: words up to this length need 64 skips. Longer ones draw more and run by themselves.
WIDE = 21
#: Longer words take a heap for their agenda, which does not grow with the square of their length.
LONG = 48
#: Words whose agendas run side by side, so that they stay in a core's cache.
SIDE = 8192
_NEVER = np.int32(1 << 30)
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = "▁"
_SIGNS = ".,;:!?"
_LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of values that begin at starts, one after another."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Pieces:
    def __init__(self, path: str, rate: float = RATE, seed: int = SEED):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.ids = {p: i for i, p in enumerate(names) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.byte = {int(p[1:-1], 16): i for i, p in enumerate(names) if model.is_byte(i)}
        self.raw = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace(_SPACE, " ").encode() if p in self.ids else b"" for i, p in enumerate(names)]
        if any(_SPACE in p.lstrip(_SPACE) for p in self.ids):
            raise ValueError("a piece reaches over the beginning of a word")
        joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        signs = "".join(c for c in _SIGNS if not any(y == c and _LETTER.match(x) for x, y in joined))
        #: Words without the signs that follow their letters: no piece joins these.
        self.chunk = re.compile((f"{_SPACE}*{_LETTER.pattern}++(?=[{signs}])|" if signs else "") + f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+")
        order = {x: k for k, x in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.rank = {p: order[x] for p, x in self.scores.items()}  # the lowest merges first
        self.limit, self.seed = int(rate * (1 << 32)), seed
        self._tables()
        self._forget()

    def _tables(self) -> None:
        """What the agendas in numpy look up. A symbol is a piece, or a character that is none, by its code point after them."""
        self.n_pieces = n = len(self.raw)
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        side = lambda x: self.ids.get(x, n + ord(x) if len(x) == 1 else -1)
        pairs = {(x, y): (self.rank[p], i) for p, i in self.ids.items() for k in range(1, len(p)) if (x := side(p[:k])) >= 0 and (y := side(p[k:])) >= 0}
        self.slots = 1 << (4 * len(pairs)).bit_length()
        self.keys, self.ranks, self.made = np.full(self.slots, -1, np.int64), np.full(self.slots, _NEVER, np.int32), np.zeros(self.slots, np.int32)
        for (x, y), (rank, i) in pairs.items():
            key = x << 32 | y
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] != -1:
                at = (at + 1) % self.slots
            self.keys[at], self.ranks[at], self.made[at] = key, rank, i

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _GOLDEN) >> np.uint64(65 - self.slots.bit_length())).astype(np.int64)

    def _pairs(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NEVER) and piece of two symbols merged, from the hash table."""
        keys = x.astype(np.int64) << 32 | y
        at = self._slot(keys)
        other = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        while len(other):
            at[other] = (at[other] + 1) % self.slots
            other = other[(self.keys[at[other]] != keys[other]) & (self.keys[at[other]] != -1)]
        return self.ranks[at], self.made[at]

    def _forget(self) -> None:
        self.types: dict[str, int] = {}
        #: By type: where its ids begin in the pool, and the bits of the candidates that came up (0 for a wide word).
        self.starts, self.came = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.uint64)
        self.pool, self.used = np.zeros(1 << 14, np.int32), 0

    def _own(self, key: int, part: int) -> int:
        return xxhash.xxh64_intdigest(struct.pack("<QQ", key & 0xFFFFFFFFFFFFFFFF, part), self.seed)

    def draws(self, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        """64 skips for each occurrence `at` of the document with the hash `own`; each bit is set with the rate, to 32 binary places."""
        if self.limit >> 32 or not self.limit:
            return np.full(len(at), -(self.limit >> 32) & 0xFFFFFFFFFFFFFFFF, np.uint64)
        base = _mix(at.astype(np.uint64) * _GOLDEN + own)
        out = np.zeros(len(at), np.uint64)
        for k in range((self.limit & -self.limit).bit_length() - 1, 32):  # from the last binary place of the rate to the first
            row = _mix(base + np.uint64((k + 1) * int(_GOLDEN) % (1 << 64)))
            out = out | row if self.limit >> k & 1 else out & row
        return out

    def segment(self, word: str, skips: int) -> list[str]:
        """Pieces of one word by the agenda; bit t of skips skips the candidate that comes up as the t-th."""
        return self._agenda(word, skips)[0]

    def _agenda(self, word: str, skips: int) -> tuple[list[str], int]:
        """Pieces and how many candidates came up: a plain list of the neighbours' ranks, or a heap for long words."""
        if len(word) > LONG:
            return self._agenda_long(word, skips)
        parts, rank, n = list(word), self.rank, 0
        agenda = [rank.get(x + y, _NEVER) for x, y in zip(parts, parts[1:], strict=False)]
        while agenda and (best := min(agenda)) != _NEVER:
            k = agenda.index(best)  # the leftmost of equals
            n += 1
            if skips >> (n - 1) & 1:
                agenda[k] = _NEVER
                continue
            parts[k] = merged = parts[k] + parts[k + 1]
            del parts[k + 1], agenda[k]
            if k < len(agenda):
                agenda[k] = rank.get(merged + parts[k + 1], _NEVER)
            if k:
                agenda[k - 1] = rank.get(parts[k - 1] + merged, _NEVER)
        return parts, n

    def _agenda_long(self, word: str, skips: int) -> tuple[list[str], int]:
        parts, rank, came = list(word), self.rank, 0
        bits = bin(skips)[:1:-1]  # the first candidate's first
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                merged = parts[i] + parts[j]
                if merged in rank:
                    heapq.heappush(agenda, (rank[merged], i, j, merged))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, j, merged = heapq.heappop(agenda)
            if not parts[i] or j >= n or after[i] != j or parts[i] + parts[j] != merged:
                continue  # one of its sides has been merged meanwhile
            came += 1
            if bits[came - 1 : came] == "1":
                continue
            parts[i], parts[j] = merged, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p], came

    def _ids(self, pieces: list[str]) -> list[int]:
        return [y for p in pieces for y in ([self.ids[p]] if p in self.ids else [self.byte[b] for b in p.encode()])]

    def _bytes(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words one after another as ids: characters that are no piece become bytes."""
        none = np.flatnonzero(symbols >= self.n_pieces)
        if not len(none):
            return symbols, lengths
        chars = [chr(c).encode() for c in (symbols[none] - self.n_pieces).tolist()]
        each = np.ones(len(symbols), np.int64)
        each[none] = list(map(len, chars))
        out = np.repeat(symbols, each)
        first = np.cumsum(each) - each
        for k, c in zip(first[none].tolist(), chars, strict=True):
            out[k : k + len(c)] = [self.byte[b] for b in c]
        of = np.repeat(np.arange(len(lengths)), lengths)
        return out, np.bincount(of, each, len(lengths)).astype(np.int64)

    def side_by_side(self, words: list[str], skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The agendas of words, none wide, with their skips: ids one after another, how many each word has, and how many candidates came up.

        Symbols keep their places; a merge takes the right one out of a list of neighbours. The rank of a pair stands at the
        place of its left symbol, so the first least rank of a row is the leftmost best candidate.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        first = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        parts, counts, came = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(words), SIDE):
            own = order[a : a + SIDE]
            symbols, n = self._run(text, first[own], sizes[own], skips[own])
            parts.append(symbols[symbols >= 0])
            counts.append((symbols >= 0).sum(1))
            came.append(n)
        ids, lengths = self._bytes(np.concatenate(parts), np.concatenate(counts))
        back = np.empty(len(words), np.int64)
        back[order] = np.arange(len(words))
        starts = (np.cumsum(lengths) - lengths)[back]
        lengths = lengths[back]
        return _ragged(ids, starts, lengths), lengths, np.concatenate(came)[back]

    def _run(self, text: np.ndarray, first: np.ndarray, sizes: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols by word and place, -1 where none is left, and how many candidates came up."""
        n, width = len(sizes), int(sizes.max())
        places = np.arange(width, dtype=np.int32)
        inside = places < sizes[:, None]
        symbols = np.full((n, width + 1), -1, np.int32)  # a column more for the end
        symbols[:, :width][inside] = self.symbol[text[(first[:, None] + places)[inside]]]
        after = np.broadcast_to(places + 1, (n, width)).copy()
        before = np.broadcast_to(places - 1, (n, width)).copy()
        ranks, made = np.full((n, width), _NEVER, np.int32), np.zeros((n, width), np.int32)
        if width > 1:
            pairs = inside[:, 1:]
            ranks[:, :-1][pairs], made[:, :-1][pairs] = self._pairs(symbols[:, : width - 1][pairs], symbols[:, 1:width][pairs])
        came = np.zeros(n, np.int64)
        rows = np.arange(n)
        while len(rows):
            at = ranks[rows].argmin(1)
            go = ranks[rows, at] != _NEVER
            rows, at = rows[go], at[go]
            skip = (skips[rows] >> came[rows].astype(np.uint64)) & np.uint64(1) != 0
            came[rows] += 1
            ranks[rows[skip], at[skip]] = _NEVER
            r, i = rows[~skip], at[~skip]
            j = after[r, i]
            symbols[r, i] = merged = made[r, i]
            symbols[r, j] = -1
            ranks[r, j] = _NEVER
            k = after[r, j]
            after[r, i] = k
            end = k >= sizes[r]
            open_ = np.flatnonzero(~end)
            before[r[open_], k[open_]] = i[open_]
            ranks[r, i] = _NEVER
            ranks[r[open_], i[open_]], made[r[open_], i[open_]] = self._pairs(merged[open_], symbols[r[open_], k[open_]])
            h = before[r, i]
            left = np.flatnonzero(h >= 0)
            ranks[r[left], h[left]], made[r[left], h[left]] = self._pairs(symbols[r[left], h[left]], merged[left])
        return symbols, came

    def _learn(self, words: list[str]) -> None:
        """The ids of new types without skips."""
        n = len(self.types)
        wide = [w for w in words if len(w) > WIDE]
        words = [w for w in words if len(w) <= WIDE]
        ids, lengths, came = self.side_by_side(words, np.zeros(len(words), np.uint64)) if words else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        bits = (np.uint64(1) << came.astype(np.uint64)) - np.uint64(1)
        k = n + len(words) + len(wide)
        while k + 1 > len(self.starts):
            self.starts, self.came = np.concatenate((self.starts, np.zeros_like(self.starts))), np.concatenate((self.came, np.zeros_like(self.came)))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[n + 1 : n + len(words) + 1] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        self.starts[n + len(words) + 1 : k + 1] = self.used
        self.came[n : n + len(words)], self.came[n + len(words) : k] = bits, 0
        self.types.update(zip((*words, *wide), range(n, k), strict=True))

    def _wide(self, word: str, key: int, at: int) -> list[int]:
        """Ids of a wide word that is occurrence `at` of a document, with as many skips as it can need."""
        place, skips = np.array([at]), 0
        for part in range(-(-3 * len(word) // 64)):
            skips |= int(self.draws(np.uint64(self._own(key, part)), place)[0]) << 64 * part
        return self._ids(self._agenda(word, skips)[0])

    def words(self, text: str) -> list[str]:
        """The words of a text, the space before it included; a character that itself looks like a piece's space stands alone as a null sign."""
        if _SPACE not in text:
            return self.chunk.findall((" " + text).replace(" ", _SPACE))
        head, *rest = text.split(_SPACE)
        out = self.chunk.findall((" " + head).replace(" ", _SPACE))
        for x in rest:
            out += ["", *self.chunk.findall(x.replace(" ", _SPACE))]
        return out

    def encode_all(self, texts: list[str | None], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after another, and how many each has; keys are the documents'."""
        if len(self.types) > MOST_TYPES:
            self._forget()
        found = [self.words(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = [w for x in found for w in x]
        types = np.fromiter(map(self.types.get, flat, repeat(-1)), np.int64, len(flat))
        fresh = np.flatnonzero(types < 0).tolist()
        if fresh:
            self._learn(list({flat[k] for k in fresh}.difference(self.types)))
            types[fresh] = [self.types[flat[k]] for k in fresh]
        own = np.repeat(np.array([self._own(k, 0) for k in keys], np.uint64), counts)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        skips = self.draws(own, at)
        lengths = self.starts[types + 1] - self.starts[types]
        ids = _ragged(self.pool, self.starts[types], lengths)
        apart = [np.flatnonzero(skips & self.came[types]), np.flatnonzero(lengths == 0)]  # with skips of their own; wide words and marks
        results = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        if len(apart[0]):
            new, sizes, _ = self.side_by_side([flat[k] for k in apart[0].tolist()], skips[apart[0]])
            results = [new], [sizes]
        mark = [self.byte[b] for b in _SPACE.encode()]
        doc = np.searchsorted(np.cumsum(counts), apart[1], "right")
        for k, d in zip(apart[1].tolist(), doc.tolist(), strict=True):
            one = self._wide(flat[k], keys[d], int(at[k])) if flat[k] else mark
            results[0].append(np.array(one, np.int32))
            results[1].append(np.array([len(one)]))
        which, sizes = np.concatenate(apart), np.concatenate(results[1])
        if len(which):
            pool = np.concatenate((ids, *results[0]))
            starts = np.cumsum(lengths) - lengths
            starts[which] = len(ids) + np.cumsum(sizes) - sizes
            lengths[which] = sizes
            ids = _ragged(pool, starts, lengths)
        return ids, np.bincount(np.repeat(np.arange(len(texts)), counts), lengths, len(texts)).astype(np.int64)

    def encode(self, text: str | None, key: int) -> np.ndarray:
        """Ids of a whole text; key is the document's."""
        return self.encode_all([text], [key])[0]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return raw[1:].decode() if raw else ""  # the space put before the text


_loaded: dict[tuple, Pieces] = {}


def load(path: str, rate: float = RATE, seed: int = SEED) -> Pieces:
    if (path, rate, seed) not in _loaded:
        _loaded[path, rate, seed] = Pieces(path, rate, seed)
    return _loaded[path, rate, seed]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def _encode(pieces: Pieces, doc_ids: pa.Array, texts: pa.Array) -> Iterator[tuple[list[str | None], np.ndarray, np.ndarray]]:
    """Texts, their ids one after another and how many each has, about half a MB of text at a time."""
    for i, j in runs(utf8(texts)[1], 1 << 19):
        some = texts.slice(i, j - i).to_pylist()
        yield some, *pieces.encode_all(some, [zlib.crc32(str(d).encode()) for d in doc_ids.slice(i, j - i).to_pylist()])


def _lists(ids: list[np.ndarray], counts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *counts]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32()))


def encoded(docs: DataFrame, model: str | None = None, rate: float = RATE, seed: int = SEED, out: str = "ids") -> DataFrame:
    """docs with the ids of each whole text. One narrow pass."""
    path = model or default_model()

    def encode(doc_ids: pa.Array, texts: pa.Array) -> pa.Array:
        found = list(_encode(load(path, rate, seed), doc_ids, texts))
        return _lists([x[1] for x in found], [x[2] for x in found])

    return docs.withColumn(out, F.arrow_udf(giving_back(encode), "array<int>")(F.col("doc_id").cast("long"), F.col("text")))


def decoded(docs: DataFrame, model: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the text of each list of ids; null stays null."""
    path = model or default_model()

    def decode(lists: pa.Array) -> pa.Array:
        pieces = load(path)
        return pa.array([None if not x.is_valid else pieces.decode(x.values.to_numpy(zero_copy_only=False)) for x in lists], pa.string())

    return docs.withColumn(out, F.arrow_udf(decode, "string")(F.col(ids)))


_TRIP = pa.struct([("ids", pa.list_(pa.int32())), ("lossless", pa.bool_())])


def round_trip(docs: DataFrame, model: str | None = None, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """doc_id, ids of each whole text, and whether they decode to it. One pass: separate columns would encode twice."""
    path = model or default_model()

    def trip(doc_ids: pa.Array, texts: pa.Array) -> pa.Array:
        pieces = load(path, rate, seed)
        ids, counts, lossless = [], [], []
        for some, own, n in _encode(pieces, doc_ids, texts):
            ids.append(own)
            counts.append(n)
            ends = np.cumsum(n).tolist()
            lossless += [pieces.decode(own[e - k : e]) == (t or "") for t, e, k in zip(some, ends, n.tolist(), strict=True)]
        return pa.StructArray.from_arrays([_lists(ids, counts), pa.array(lossless, pa.bool_())], fields=list(_TRIP))

    trips = docs.select("doc_id", F.arrow_udf(giving_back(trip), "struct<ids:array<int>,lossless:boolean>")(F.col("doc_id").cast("long"), F.col("text")).alias("t"))
    return trips.select("doc_id", "t.ids", "t.lossless")


def pieces_query(docs: DataFrame) -> DataFrame:
    """How many ids each document has, their hash, and whether they decode to its text."""
    return round_trip(docs).select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_xxhash64"), "lossless")
