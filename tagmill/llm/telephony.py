"""Telephony audio: mu-law, A-law and IMA ADPCM in WAVE files, expanded with numpy and resampled to 16 kHz PCM.

Companded samples are expanded by 256-entry lookup tables; ADPCM blocks are decoded in step across all blocks of a batch,
so the sequential recurrence runs once per sample place, not once per sample. The coded bytes themselves are what a file
stores, so storing is lossless; the PCM is derived from what is read back, and stored and read back itself.

PCM is stored losslessly by prediction: the samples at even places, and for those at odd places what the mean of their
neighbours leaves, which is left out where all of it is 0. Any 16 bit PCM can be stored so. Rows are written by codec, so
that a compressed page holds one kind of sound.

Defined cases: a null text is an empty one and makes one block of padding; equal payloads give equal files; payloads whose
length is no multiple of a block decode without the rest; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import runs, saved, utf8

BLOCK = 192
RATE = 8_000
#: WAVE format tags.
ULAW, ALAW, IMA = 7, 6, 0x11
CODECS = (ULAW, ALAW, IMA)
NAMES = {ULAW: "ulaw", ALAW: "alaw", IMA: "ima"}

_code = np.arange(256)
_u = ~_code & 0xFF
ULAW_PCM = np.where(_u & 0x80, -1, 1) * (((((_u & 15) << 3) + 132) << ((_u >> 4) & 7)) - 132)
ULAW_PCM = ULAW_PCM.astype(np.int16)
_a = _code ^ 0x55
_seg, _low = (_a >> 4) & 7, ((_a & 15) << 4) + 8
ALAW_PCM = (np.where(_a & 0x80, 1, -1) * np.where(_seg > 0, (_low + 256) << np.maximum(_seg - 1, 0), _low)).astype(np.int16)


#: Fixed values of the public format: its step sizes, and how far a nibble's size moves in them.
IMA_STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173,
        190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
        2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818,
        18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """blocks: m x BLOCK bytes, mono; m x (1 + 2 * (BLOCK - 4)) samples, all blocks decoded side by side."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(IMA_STEPS) - 1).astype(np.int32)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(body), len(blocks)), np.int16)
    out[0] = value
    for k in range(2 * len(body)):
        nibble = (body[k >> 1] >> (4 * (k & 1))) & 15
        step = IMA_STEPS[index]
        size = nibble & 7
        change = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
        value = np.clip(value + np.where(nibble & 8, -change, change), -32768, 32767)
        index = np.clip(index + IMA_MOVES[size], 0, len(IMA_STEPS) - 1)
        out[k + 1] = value
    return out.T


def wave_file(payload: bytes, codec: int) -> bytes:
    bits, align = (4, BLOCK) if codec == IMA else (8, 1)
    extra = struct.pack("<HH", 2, 1 + 2 * (BLOCK - 4)) if codec == IMA else struct.pack("<H", 0)
    per_second = RATE * BLOCK // (1 + 2 * (BLOCK - 4)) if codec == IMA else RATE
    form = struct.pack("<HHIIHH", codec, 1, RATE, per_second, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body + b"\0" * (len(payload) & 1)


def read_wave(media: bytes | pa.Buffer) -> tuple[int, bytes]:
    """(format tag, data) of a WAVE file."""
    media = memoryview(media)
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAVE file")
    at, codec = 12, 0
    while at + 8 <= len(media):
        name, size = bytes(media[at : at + 4]), int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            codec = int.from_bytes(media[at + 8 : at + 10], "little")
        if name == b"data":
            return codec, bytes(media[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("no data")


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def expand(payloads: list[bytes], codecs: list[int]) -> list[np.ndarray]:
    """8 kHz PCM of each payload; the ADPCM blocks of all of them are decoded together."""
    ima = [np.frombuffer(p, np.uint8)[: len(p) // BLOCK * BLOCK].reshape(-1, BLOCK) for p, c in zip(payloads, codecs, strict=True) if c == IMA]
    decoded = decode_ima(np.concatenate(ima)) if ima else None
    out, at = [], 0
    for p, c in zip(payloads, codecs, strict=True):
        if c == IMA:
            n = len(p) // BLOCK
            out.append(decoded[at : at + n].reshape(-1))
            at += n
        else:
            out.append((ULAW_PCM if c == ULAW else ALAW_PCM)[np.frombuffer(p, np.uint8)])
    return out


def _predicted(even: np.ndarray, n: int) -> np.ndarray:
    """What is expected at the odd places of n samples: the means of the even neighbours (the last is held)."""
    after = np.append(even[1:], even[-1:])[: n // 2]
    return ((even[: n // 2].astype(np.int32) + after) >> 1).astype(np.int16)


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: samples and the means of neighbours between them (the last is held)."""
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    out[1::2] = _predicted(out[::2], len(out))
    return out


def pack_pcm(pcm: np.ndarray) -> bytes:
    """16 bit PCM as bytes: how many samples, those at even places, and the odd ones' differences from the prediction, if any."""
    even = pcm[::2]
    rest = pcm[1::2] - _predicted(even, len(pcm))  # modulo 2**16, as it is added back
    return struct.pack("<I", len(pcm)) + even.astype("<i2").tobytes() + (rest.astype("<i2").tobytes() if rest.any() else b"")


def unpack_pcm(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    values = np.frombuffer(packed, "<i2", offset=4)
    out = np.empty(n, np.int16)
    out[::2] = values[: (n + 1) // 2]
    out[1::2] = _predicted(out[::2], n)
    if len(values) > (n + 1) // 2:
        out[1::2] += values[(n + 1) // 2 :]
    return out


_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_PCM = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("codec", pa.string()), ("pcm", pa.binary())]
)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch["text"])
        ids = batch["doc_id"].to_pylist()
        for i, j in runs(offsets, 4 << 20):
            rows = []
            for k in range(i, j):
                raw = data[offsets[k] : offsets[k + 1]].tobytes()
                payload = raw + b" " * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))
                rows.append((ids[k], len(raw), wave_file(payload, CODECS[zlib.crc32(payload) % 3])))
            yield _batch(_MEDIA, rows)


def _hear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files by codec, about 2 MB of payload at a time, all blocks of these decoded side by side."""
    for batch in batches:
        media, ids, sizes = batch["media"], batch["doc_id"].to_pylist(), batch["n_bytes"].to_pylist()
        codecs = [int.from_bytes(m.as_buffer()[20:22], "little") for m in media]  # where wave_file puts the format tag
        for codec in CODECS:
            own = [k for k, c in enumerate(codecs) if c == codec]
            ends = np.cumsum([0, *(len(media[k].as_buffer()) for k in own)])
            for i, j in runs(ends, 2 << 20):
                files = [media[k].as_py() for k in own[i:j]]
                payloads = [read_wave(f)[1] for f in files]
                rows = []
                for k, f, p, x in zip(own[i:j], files, payloads, expand(payloads, [codec] * len(files)), strict=True):
                    digest = hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(f), hashlib.sha256(f).hexdigest()
                    rows.append((ids[k], sizes[k], len(p), *digest, NAMES[codec], pack_pcm(resample(x))))
                yield _batch(_PCM, rows)


_MEASURED = pa.struct([("n", pa.int64()), ("crc", pa.int64()), ("peak", pa.int32()), ("mean_square", pa.int64()), ("crossings", pa.int64())])


def _measure(packed: pa.Array) -> pa.Array:
    rows = []
    for x in packed:
        pcm = unpack_pcm(x.as_buffer().to_pybytes()).astype("<i2")
        own = pcm[::2]  # the samples at 8 kHz
        wide = own.astype(np.int64)
        crossings = int(((own[1:] < 0) != (own[:-1] < 0)).sum())
        rows.append((2 * len(pcm), zlib.crc32(pcm.tobytes()), int(np.abs(wide).max(initial=0)), int((wide * wide).sum()) // max(1, len(own)), crossings))
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, _MEASURED, strict=True)], fields=list(_MEASURED))


#: Of the Parquet tables. Larger pages let equal passages of several documents be found.
_LEVEL, _PAGE = "parquet.compression.codec.zstd.level", {"parquet.page.size": 8 << 20}


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a WAVE file whose codec its payload decides."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def heard(media: DataFrame) -> DataFrame:
    """doc_id, digests of the stored files, codec and 16 kHz PCM (packed), from the stored bytes."""
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, pcm binary"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_hear, fields)


def measured(pcm: DataFrame) -> DataFrame:
    """pcm with its bytes and their CRC when unpacked, and the peak, mean square and sign changes of its samples at 8 kHz."""
    return pcm.withColumn("f", F.arrow_udf(_measure, "struct<n:bigint,crc:bigint,peak:int,mean_square:bigint,crossings:bigint>")("pcm")).select(*pcm.columns, "f.*")


def resampled(docs: DataFrame) -> DataFrame:
    """heard() of the stored files: files and PCM are tables of the shared folder, read back from there."""
    files = saved(stored(docs), "media", **_PAGE, **{_LEVEL: 9})
    return saved(heard(files), "pcm", **_PAGE, **{_LEVEL: 12})


def telephony_query(docs: DataFrame) -> DataFrame:
    """Digests of the stored files and features of the stored PCM, both read back from the shared folder."""
    feature = F.concat_ws(":", "codec", "n", "crc", "peak", "mean_square", "crossings")
    read = measured(resampled(docs))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
