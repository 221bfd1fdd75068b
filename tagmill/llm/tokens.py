"""Token ids in succinct files: a wavelet matrix for each shard.

A shard holds the ids of consecutive documents, each closed by an end id. Its file keeps the documents' ids and counts and,
for each bit of the ids from the highest, a bit plane with the counts of ones before every 1,024 bits. After each plane the
ids are parted stably by their bit, so rank and select on the planes give the id at a place, the count of an id in a range
and the place of its k-th occurrence, without the ids themselves. Directories and pieces of planes are zstd frames of their
own with an index of their lengths, so that a look-up opens only the frames that it touches.

Documents are put in ascending doc_id by a range partitioning, encoded and cut into shards of bounded size inside each
partition. Files are rows of a Parquet table in the shared folder, one binary value each, so Spark's committer keeps one
copy of each however often tasks are run again. Starts over all documents come from the ids of each partition, a table
with one row a partition.

Defined cases: a null text is an empty one (its end id alone); documents of one doc_id are ordered by a hash of their text,
and repeated rows among them as they come; null ids come first (no other id is lost to them); an empty table makes no file;
other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.llm.common import plan_bytes, runs, saved, utf8

VOCABULARY = "byte_bpe_50k.json"
END = 0
SHARD_TOKENS = 1 << 19
#: Bytes of input that a partition of the range partitioning gets, about.
PART_BYTES = 128 << 20
_MAGIC = b"WVM2"
#: Bits between two counts of a directory, and bits of a frame of a plane.
_STRIDE = 1 << 10
_FRAME = 1 << 18


class Plane:
    """n bits with the ones before every _STRIDE bits; both are given or come from functions when they are first needed."""

    def __init__(self, n: int, directory: np.ndarray | Callable[[], np.ndarray], frames: list[np.ndarray | Callable[[], np.ndarray]]):
        self.n, self._directory, self._frames = n, directory, frames

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        packed = np.packbits(bits, bitorder="little")
        per = np.add.reduceat(np.bitwise_count(packed).astype(np.uint32), np.arange(0, len(packed), _STRIDE // 8)) if len(bits) else np.zeros(0, np.uint32)
        directory = np.concatenate((np.zeros(1, np.uint32), np.cumsum(per, dtype=np.uint32)))
        return cls(len(bits), directory, [packed[i : i + _FRAME // 8] for i in range(0, len(packed), _FRAME // 8)])

    @property
    def directory(self) -> np.ndarray:
        if callable(self._directory):
            self._directory = self._directory()
        return self._directory

    def frame(self, k: int) -> np.ndarray:
        if callable(self._frames[k]):
            self._frames[k] = self._frames[k]()
        return self._frames[k]

    def bits(self) -> np.ndarray:
        packed = [self.frame(k) for k in range(len(self._frames))]
        return np.unpackbits(np.concatenate(packed) if packed else np.zeros(0, np.uint8), count=self.n, bitorder="little").view(bool)

    def _block(self, block: int) -> np.ndarray:
        """The bits of a block of the directory."""
        first = block * _STRIDE
        return np.unpackbits(self.frame(first // _FRAME)[first % _FRAME // 8 : (first % _FRAME + _STRIDE) // 8], count=min(_STRIDE, self.n - first), bitorder="little")

    def bit(self, i: int) -> int:
        return int(self.frame(i // _FRAME)[i % _FRAME >> 3] >> (i & 7) & 1)

    def ones(self, i: int) -> int:
        """Ones among the first i bits."""
        block, rest = divmod(i, _STRIDE)
        return int(self.directory[block]) + (int(self._block(block)[:rest].sum()) if rest else 0)

    def place(self, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of this value; there must be so many."""
        before = self.directory if bit else np.minimum(np.arange(len(self.directory)) * _STRIDE, self.n) - self.directory
        block = int(np.searchsorted(before, k, "right")) - 1
        return block * _STRIDE + int(np.flatnonzero(self._block(block) == bit)[k - int(before[block])])


class WaveletMatrix:
    """Planes from the highest bit; ids below 2 ** len(planes)."""

    def __init__(self, n: int, planes: list[Plane], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits, planes, zeros = max(1, int(ids.max(initial=0)).bit_length()), [], []
        ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for b in range(bits - 1, -1, -1):
            bit = (ids & ids.dtype.type(1 << b)) != 0
            planes.append(Plane.of(bit))
            low = ids.take(np.flatnonzero(~bit))  # several times quicker than a mask where bits are mixed
            zeros.append(len(low))
            ids = np.concatenate((low, ids.take(np.flatnonzero(bit)))) if b else ids
        return cls(len(ids), planes, zeros)

    def ids(self) -> np.ndarray:
        """All ids in order: the planes' partings undone from the last."""
        out = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            bit = self.planes[k].bits()
            before = np.empty_like(out)
            before[np.flatnonzero(~bit)] = out[: self.zeros[k]]
            before[np.flatnonzero(bit)] = out[self.zeros[k] :] | out.dtype.type(1 << (len(self.planes) - 1 - k))
            out = before
        return out

    def access(self, i: int) -> int:
        value = 0
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bit, ones = plane.bit(i), plane.ones(i)
            i, value = (zeros + ones if bit else i - ones), value << 1 | bit
        return value

    def _range(self, value: int, a: int, b: int) -> tuple[int, int]:
        """Where the occurrences of value among the places from a to b lie after the last plane."""
        for k, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            one_a, one_b = plane.ones(a), plane.ones(b)
            a, b = (zeros + one_a, zeros + one_b) if value >> (len(self.planes) - 1 - k) & 1 else (a - one_a, b - one_b)
        return a, b

    def rank(self, value: int, i: int) -> int:
        """How many of the first i ids are value."""
        if value < 0 or value >> len(self.planes):
            return 0
        a, b = self._range(value, 0, i)
        return b - a

    def select(self, value: int, occurrence: int) -> int:
        """Place of the occurrence (from 0) of value, or -1: down the planes to its range, then up by select on each."""
        if value < 0 or value >> len(self.planes):
            return -1
        a, b = self._range(value, 0, self.n)
        if not 0 <= occurrence < b - a:
            return -1
        i = a + occurrence
        for k in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - k) & 1
            i = self.planes[k].place(bit, i - self.zeros[k] if bit else i)
        return i


_HEADER = "<4sQQII"


def shard_file(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, none: np.ndarray | None = None) -> bytes:
    """One file: header, lengths of the frames, then as frames the documents (null, id, ids), the zeros, and each plane's directory and pieces."""
    matrix = WaveletMatrix.build(ids)
    none = np.zeros(len(doc_ids), np.uint8) if none is None else none.astype(np.uint8)
    numbers = none.tobytes() + doc_ids.astype("<i8").tobytes() + counts.astype("<i8").tobytes() + np.array(matrix.zeros, "<i8").tobytes()
    parts = [numbers]
    for plane in matrix.planes:
        parts.append(plane.directory.astype("<u4").tobytes())
        parts += [plane.frame(k).tobytes() for k in range(len(plane._frames))]
    press = zstandard.ZstdCompressor(level=1)
    frames = [press.compress(p) for p in parts]
    header = struct.pack(_HEADER, _MAGIC, len(doc_ids), matrix.n, len(matrix.planes), len(frames))
    return b"".join((header, np.array([len(f) for f in frames], "<u4").tobytes(), *frames))


def open_shard(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, WaveletMatrix]:
    """(whether the doc id is null, doc ids, ids of each document, matrix) of a file; planes are read when they are needed."""
    magic, docs, n, bits, n_frames = struct.unpack_from(_HEADER, image)
    if magic != _MAGIC:
        raise ValueError("no wavelet shard")
    at = struct.calcsize(_HEADER)
    ends = at + 4 * n_frames + np.concatenate(([0], np.cumsum(np.frombuffer(image, "<u4", n_frames, at), dtype=np.int64)))
    unpack = zstandard.ZstdDecompressor()
    frame = lambda k, kind: lambda: np.frombuffer(unpack.decompress(memoryview(image)[ends[k] : ends[k + 1]]), kind)
    numbers = unpack.decompress(memoryview(image)[ends[0] : ends[1]])
    none, numbers = np.frombuffer(numbers, np.uint8, docs).astype(bool), np.frombuffer(numbers, "<i8", 2 * docs + bits, docs)
    per = -(-n // _FRAME)
    planes = [Plane(n, frame(1 + k * (per + 1), "<u4"), [frame(2 + k * (per + 1) + j, np.uint8) for j in range(per)]) for k in range(bits)]
    return none, numbers[:docs], numbers[docs : 2 * docs], WaveletMatrix(n, planes, numbers[2 * docs :].tolist())


class Encoder:
    """The tokenizers library behind a table of the parts of texts.

    The vocabulary's pre-tokenizer always cuts before a space that follows a character other than a space or line feed, and
    around a line feed between such characters, and parts are cut alike in any text, so each part is encoded once. A part
    of letters is one word for the library's model, and so is what precedes the signs at a part's end. Texts with other
    spacing or with the special token go to the library whole. Cutting, numbering and joining parts are done on columns.
    """

    #: Parts kept, about 200 MB in a worker; a worker forgets all of them when there are more.
    MOST = 900_000
    _LETTERS = r" ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+"
    _WORD = rf"^{_LETTERS}$"
    _SIGNED = rf"^(?P<word>{_LETTERS})(?P<signs>[!-/:-@\[-`{{-~]+)$"
    #: White space other than single spaces and line feeds between other characters.
    _ODD = r"  |\n\n| \n|\n |^[ \n]|[ \n]$|[\x00\t\v\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = Tokenizer.from_file(path)  # the same model, for what has been pre-tokenized already
        self.by_words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        special = [re.sub(r"(\W)", r"\\\1", t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([self._ODD, *special])
        # how the byte-level pre-tokenizer writes bytes: printing ones as they are, the others from 256 on
        printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = (b for b in range(256) if b not in printing)
        self.written = {b: b for b in printing} | {b: 256 + k for k, b in enumerate(others)}
        self.gap = chr(self.written[10])
        self.gap_id = self.tokenizer.token_to_id(self.gap)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        #: Ids of the parts one after another, and where those of each part begin.
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 0
        self.starts = np.zeros(1 << 14, np.int64)
        self._append([""], np.zeros(0, np.uint16), np.zeros(1, np.int64))

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _append(self, parts: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, k = len(self.number), len(parts)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while n + k + 1 > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[n + 1 : n + k + 1] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        self.number.update(zip(parts, range(n, n + k), strict=True))

    def _words(self, words: pa.Array, names: list[str]) -> None:
        """Words as the byte-level pre-tokenizer writes them, many in a text of words, with a line feed's sign between them."""
        written = pc.replace_substring(words, " ", "\u0120").to_numpy(zero_copy_only=False).tolist()
        for k in np.flatnonzero(pc.invert(pc.string_is_ascii(words)).to_numpy(zero_copy_only=False)).tolist():
            written[k] = names[k].encode().decode("latin-1").translate(self.written)
        for i in range(0, len(names), 4096):
            some = names[i : i + 4096]
            text = f" {self.gap} ".join([*written[i : i + 4096], ""])
            ids = np.array(self.by_words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)
            ends = np.flatnonzero(ids == self.gap_id)
            if len(ends) != len(some):
                raise AssertionError("words were not cut at their gaps")
            self._append(some, np.delete(ids, ends), np.diff(ends, prepend=-1) - 1)

    def _others(self, parts: list[str]) -> None:
        ids = self._whole(parts)
        self._append(parts, np.array([i for x in ids for i in x], np.uint16), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _learn(self, parts: pa.Array) -> None:
        """Words, then what else stands alone, then words with signs behind them."""
        known = self.number
        is_word = pc.match_substring_regex(parts, self._WORD)
        rest = parts.filter(pc.invert(is_word))
        split = pc.extract_regex(rest, self._SIGNED)
        whole = pc.is_null(split)
        signed, split = rest.filter(pc.invert(whole)).to_pylist(), split.filter(pc.invert(whole))
        heads, tails = (pc.struct_field(split, k).to_pylist() for k in ("word", "signs"))
        words = parts.filter(is_word)
        self._words(words, words.to_numpy(zero_copy_only=False).tolist())
        more = sorted(set(heads).difference(known))
        self._words(pa.array(more, pa.large_string()), more)
        self._others(sorted({*rest.filter(whole).to_pylist(), *tails}.difference(known)))
        if signed:
            ids, lengths = self._joined(np.array([list(map(known.__getitem__, heads)), list(map(known.__getitem__, tails))]).T.reshape(-1))
            self._append(signed, ids, lengths.reshape(-1, 2).sum(1))

    def _joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts one after another, and how many each has."""
        first = self.starts[numbers]
        lengths = self.starts[numbers + 1] - first
        ends = np.cumsum(lengths)
        return self.pool[np.repeat(first - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; null counts as empty."""
        if len(self.number) > self.MOST:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, self.odd)
        cut = pc.replace_substring(pc.replace_substring(pc.if_else(odd, "", texts), "\n", "\0\n\0"), " ", "\0 ")
        cut = pc.split_pattern(cut, "\0")
        parts = cut.flatten().dictionary_encode()
        names = parts.dictionary.to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.number.get, names.tolist(), repeat(-1)), np.int64, len(names))
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            self._learn(parts.dictionary.take(pa.array(fresh)))
            number[fresh] = list(map(self.number.__getitem__, names[fresh].tolist()))
        number = number[parts.indices.to_numpy()]
        counts = pc.list_value_length(cut).to_numpy()
        of = np.repeat(np.arange(len(texts)), counts)
        ids, lengths = self._joined(number)
        per_text = np.bincount(of, lengths, len(texts)).astype(np.int64)
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(whole):
            cuts = np.cumsum(per_text)[whole].tolist()  # texts that went to the library whole have no ids yet
            found = self._whole([texts[int(i)].as_py() for i in whole])
            per_text[whole] = [len(x) for x in found]
            pieces = np.split(ids, cuts)
            ids = np.concatenate([pieces[0], *(y for x, piece in zip(found, pieces[1:], strict=True) for y in (np.array(x, np.uint16), piece))])
        return ids, per_text


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_FILE = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("image", pa.binary())])


def write_shards(docs: DataFrame, vocabulary: str, parts: int | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row per file: part, shard, first_doc, n_docs, before (ids of the part's earlier shards), n_tokens, image."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard, before = _encoder(vocabulary), -1, 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # doc ids, counts, ids of the shard to come
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, shard, before
            doc_ids = pa.concat_arrays([d for d, _, _ in held])
            counts, ids = (np.concatenate([x[k] for x in held]) for k in (1, 2))
            image = shard_file(pc.fill_null(doc_ids, 0).to_numpy(), counts, ids, doc_ids.is_null().to_numpy(zero_copy_only=False))
            row = [[part], [shard], [doc_ids[0].as_py()], [len(doc_ids)], [before], [size], [image]]
            held, size, shard, before = [], 0, shard + 1, before + size
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _FILE, strict=True)], schema=_FILE)

        for batch in batches:
            part = batch["part"][0].as_py() if len(batch) else part
            offsets = utf8(batch["text"])[1]
            for i, j in runs(offsets, 8 << 20):
                ids, counts = encoder.encode(batch["text"].slice(i, j - i))
                ids, counts = np.insert(ids, np.cumsum(counts), END), counts + 1
                ends = np.cumsum(counts)
                a = 0
                while a < len(counts):  # a shard ends with the document that fills it
                    first = int(ends[a] - counts[a])
                    b = min(len(counts), int(np.searchsorted(ends, first + shard_tokens - size)) + 1)
                    held.append((batch["doc_id"].slice(i + a, b - a), counts[a:b], ids[first : ends[b - 1]]))
                    size += int(ends[b - 1]) - first
                    a = b
                    if size >= shard_tokens:
                        yield flush()
        if held:
            yield flush()

    docs = docs.select("doc_id", "text")
    parts = parts or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-plan_bytes(docs) // PART_BYTES))
    order = {"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}  # an id or a text that many rows share is parted too
    ordered = docs.withColumns(order).repartitionByRange(parts, "doc_id", "_hash", "_row").sortWithinPartitions("doc_id", "_hash", "_row")
    fields = "part int, shard int, first_doc long, n_docs long, before long, n_tokens long, image binary"
    return saved(ordered.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(encode, fields), "tokens", "uncompressed")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, before, image in zip(batch["part"], batch["before"], batch["image"], strict=True):
            none, doc_ids, counts, matrix = open_shard(image.as_py())
            ids = matrix.ids().astype("<u4")
            ends = np.cumsum(counts)
            raw = ids.tobytes()
            crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(doc_ids), part.as_py(), np.int32)), pa.array(doc_ids, mask=none), pa.array(ends - counts + before.as_py()), pa.array(counts), pa.array(crc, pa.int64())],
                names=["part", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def _bases(files: DataFrame) -> DataFrame:
    """part, base: ids of all earlier partitions. A row per partition."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))


def read_documents(files: DataFrame) -> DataFrame:
    """A row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    rows = files.select("part", "before", "image").mapInArrow(_read, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(_bases(files)), "part").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def count_ids(files: DataFrame, wanted: list[int]) -> DataFrame:
    """part, shard, id, n: how often each wanted id occurs in each file, by rank alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, image in zip(batch["part"].to_pylist(), batch["shard"].to_pylist(), batch["image"], strict=True):
                matrix = open_shard(image.as_py())[3]
                rows = [(part, shard, i, matrix.rank(i, matrix.n)) for i in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["part", "shard", "id", "n"])

    return files.select("part", "shard", "image").mapInArrow(count if wanted else lambda batches: iter(()), "part int, shard int, id long, n long")


def occurrences(files: DataFrame, wanted: int) -> DataFrame:
    """doc_id, place (of the id in its document), at (over all documents): a row per occurrence of an id, by select."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, image in zip(batch["part"].to_pylist(), batch["before"].to_pylist(), batch["image"], strict=True):
                none, doc_ids, counts, matrix = open_shard(image.as_py())
                starts = np.cumsum(counts) - counts
                n = matrix.rank(wanted, matrix.n)
                for first in range(0, n, 4096):
                    places = np.array([matrix.select(wanted, k) for k in range(first, min(n, first + 4096))], np.int64)
                    of = np.searchsorted(starts, places, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), part, np.int32)), pa.array(doc_ids[of], mask=none[of]), pa.array(places - starts[of]), pa.array(places + before)], names=["part", "doc_id", "place", "at"])

    rows = files.select("part", "before", "image").mapInArrow(find, "part int, doc_id long, place long, at long")
    return rows.join(F.broadcast(_bases(files)), "part").select("doc_id", "place", (F.col("at") + F.col("base")).alias("at"))


def ids_at(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """part, shard, place, id for the wanted rows (part, shard, place); no row for places outside a file."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, image, places in zip(batch["part"].to_pylist(), batch["shard"].to_pylist(), batch["image"], batch["places"].to_pylist(), strict=True):
                matrix = open_shard(image.as_py())[3]
                rows = [(part, shard, i, matrix.access(i)) for i in places if 0 <= i < matrix.n]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["part", "shard", "place", "id"])

    places = wanted.groupBy("part", "shard").agg(F.collect_set("place").alias("places"))  # no more than a file has ids, if they are inside
    return files.join(places, ["part", "shard"]).select("part", "shard", "image", "places").mapInArrow(look, "part int, shard int, place long, id long")


def token_query(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    return read_documents(write_shards(docs, vocabulary))
