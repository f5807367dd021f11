"""Media columns: telephony audio (operator 7).

Payloads are stored as WAV files: mu-law or A-law, in which a byte is a sample, or IMA ADPCM, in which it is
part of a block; any payload is kept as it is. Reading expands mu-law and A-law by lookup tables and decodes ADPCM with numpy,
one step of all blocks at a time. Decoded audio can be resampled and stored as 16-bit PCM.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm import kernels as K
from pairloom.llm.common import arrow_batches

RATE = 8000
PCM, ALAW, ULAW, IMA = 1, 6, 7, 17


def _ulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.uint8)
    size = (((u & 15).astype(np.int32) << 3) + 132 << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.uint8) ^ 0x55
    exp, size = ((a >> 4) & 7).astype(np.int32), (a & 15).astype(np.int32) << 4
    size = np.where(exp == 0, size + 8, size + 264 << np.maximum(exp - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


EXPAND = {ULAW: _ulaw_table(), ALAW: _alaw_table()}
#: The step sizes and index moves that the IMA ADPCM format fixes.
IMA_STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767])
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)


def wav(codec: int, body: bytes, rate: int = RATE, block: int = 1, bits: int = 8, per_block: int = 0) -> bytes:
    """A RIFF file with one channel; body is padded to an even length as RIFF asks."""
    fmt = struct.pack("<HHIIHH", codec, 1, rate, rate * block if codec != IMA else rate * block // per_block, block, bits)
    if codec == IMA:
        fmt += struct.pack("<HH", 2, per_block)
    elif codec != PCM:
        fmt += struct.pack("<H", 0)
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 20 + len(fmt) + len(body) + len(pad)) + b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(body)) + body + pad


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """Codec, rate, block size and the data chunk of a RIFF file; ValueError if it isn't one, or not of one channel."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate, block = 12, 0, 0, 0
    while at + 8 <= len(media):
        name, (size,) = media[at : at + 4], struct.unpack_from("<I", media, at + 4)
        if name == b"fmt ":
            codec, channels, rate, _, block = struct.unpack_from("<HHIIH", media, at + 8)
            if channels != 1:
                raise ValueError(f"a WAV file of {channels} channels; only one is read")
        elif name == b"data":
            return codec, rate, block, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("a WAV file without data")


#: ADPCM blocks that are decoded together.
BLOCKS = 1 << 13


def ima_decode(body: bytes | memoryview | np.ndarray, block: int) -> np.ndarray:
    """PCM of IMA ADPCM blocks (one channel), the last one may be short: numpy across blocks, a loop over a block's nibbles."""
    count, rest = divmod(len(body), block)
    if rest >= 4:
        return np.concatenate((ima_decode(memoryview(body)[: count * block], block), ima_decode(memoryview(body)[count * block :], rest)))
    raw = np.frombuffer(body, np.uint8, count * block).reshape(-1, block)
    if count > BLOCKS:
        out = np.empty((count, 2 * (block - 4) + 1), np.int16)
        for a in range(0, count, BLOCKS):
            out[a : a + BLOCKS] = ima_decode(raw[a : a + BLOCKS].reshape(-1), block).reshape(-1, out.shape[1])
        return out.reshape(-1)
    value = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(raw[:, 2].astype(np.int64), 88)
    nibbles = np.stack((raw[:, 4:] & 15, raw[:, 4:] >> 4), axis=2).reshape(len(raw), 2 * (block - 4))
    out = np.empty((len(raw), nibbles.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(nibbles.shape[1]):
        n = nibbles[:, k]
        step = IMA_STEPS[index]
        move = (step >> 3) + np.where(n & 1, step >> 2, 0) + np.where(n & 2, step >> 1, 0) + np.where(n & 4, step, 0)
        value = np.clip(value + np.where(n & 8, -move, move), -32768, 32767)
        index = np.clip(index + IMA_MOVES[n], 0, 88)
        out[:, k + 1] = value
    return out.reshape(-1)


def ima_encode(pcm: np.ndarray, block: int = 256) -> bytes:
    """IMA ADPCM blocks of PCM (one channel), the last one padded with its last sample; lossy."""
    per = (block - 4) * 2 + 1
    if not len(pcm):
        return b""
    full = np.concatenate((pcm, np.full(-len(pcm) % per, pcm[-1], pcm.dtype))).astype(np.int32).reshape(-1, per)
    value, index = full[:, 0].copy(), np.zeros(len(full), np.int64)
    nibbles = np.zeros((len(full), per - 1), np.uint8)
    for k in range(1, per):
        step = IMA_STEPS[index]
        gap = full[:, k] - value
        n = np.where(gap < 0, 8, 0)
        left, move = np.abs(gap), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            hit = left >= part
            n, left, move = n + np.where(hit, bit, 0), left - np.where(hit, part, 0), move + np.where(hit, part, 0)
        value = np.clip(value + np.where(n & 8, -move, move), -32768, 32767)
        index = np.clip(index + IMA_MOVES[n], 0, 88)
        nibbles[:, k - 1] = n
    head = np.zeros((len(full), 4), np.uint8)
    head[:, :2] = full[:, :1].astype("<i2").view(np.uint8)
    return np.hstack((head, nibbles[:, ::2] | nibbles[:, 1::2] << 4)).tobytes()


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """Rate and 16-bit samples of a stored file."""
    file = read_wav(media)
    return file[1], decode_all([file])[0]


#: Samples that are computed with together: what is needed beside a file and its samples does not grow with it.
PIECE = 1 << 18


def resample(pcm: np.ndarray, up: int, down: int, out: np.ndarray | None = None) -> np.ndarray:
    """Linear interpolation to up / down times the rate, in integers, so that reruns agree to the bit; into `out` if given."""
    n = (len(pcm) * up + down - 1) // down
    out = np.empty(n, np.int16) if out is None else out
    for a in range(0, n, PIECE):
        at = np.arange(a, min(a + PIECE, n), dtype=np.int64) * down
        k, part = at // up, at % up
        x, y = pcm[k].astype(np.int64), pcm[np.minimum(k + 1, len(pcm) - 1)].astype(np.int64)
        out[a : a + PIECE] = (x * (up - part) + y * part) // up
    return out


def feature(pcm: np.ndarray) -> str:
    """Integer statistics: samples, mean square, peak, zero crossings and a 8-band energy envelope."""
    edge = [*(k * len(pcm) // 8 for k in range(8)), len(pcm)]
    flips = peak = 0
    bands = []
    for low, high in zip(edge, edge[1:]):
        energy = 0
        for a in range(low, high, PIECE):
            x = pcm[a : min(a + PIECE, high)].astype(np.int64)
            energy, peak = energy + int((x * x).sum()), max(peak, int(np.abs(x).max()))
            below = np.append(pcm[a - 1 : a] < 0, x < 0)  # the sample before it, if any
            flips += int(np.count_nonzero(below[1:] != below[:-1]))
        bands.append(energy)
    means = [e // max(1, high - low) if len(pcm) >= 8 else 0 for e, low, high in zip(bands, edge, edge[1:])]
    return f"n={len(pcm)};ms={sum(bands) // max(1, len(pcm))};peak={peak};zc={flips};env={','.join(map(str, means))}"


def resampled_wav(pcm: np.ndarray, up: int, down: int) -> np.ndarray:
    """Bytes of a 16-bit PCM file at rate up, written in place: the only copy of its samples."""
    n = (len(pcm) * up + down - 1) // down
    head = wav(PCM, b"", up, 2, 16)
    raw = np.empty(len(head) + 2 * n, np.uint8)
    raw[: len(head)] = np.frombuffer(head, np.uint8)
    raw[4:8] = np.frombuffer(struct.pack("<I", len(raw) - 8), np.uint8)
    raw[len(head) - 4 : len(head)] = np.frombuffer(struct.pack("<I", 2 * n), np.uint8)
    resample(pcm, up, down, raw[len(head) :].view("<i2"))
    return raw


def binaries(parts: list[np.ndarray | bytes | None]) -> pa.Array:
    """A binary column; a part that stands alone is not copied."""
    sizes = [0 if p is None else len(p) for p in parts]
    some = [p for p in parts if p is not None and len(p)]
    data = pa.py_buffer(some[0]) if len(some) == 1 else pa.py_buffer(b"".join(bytes(p) for p in some))
    valid = None if all(p is not None for p in parts) else pa.array([p is not None for p in parts]).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(parts), [valid, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), data])


#: Bytes of an ADPCM block of stored payloads, and its samples: a header of 4 bytes, then two samples a byte.
BLOCK = 192
PER_BLOCK = 2 * (BLOCK - 4) + 1
#: Codecs that keep any payload byte by byte; which one is used follows from the payload.
CODECS = (ULAW, ALAW, IMA)


def stored(payload: bytes, codecs: tuple[int, ...] = CODECS) -> bytes:
    """The WAV file of a payload: its bytes are mu-law or A-law samples, or those of ADPCM blocks."""
    codec = codecs[zlib.crc32(payload) % len(codecs)]
    return wav(codec, payload, RATE, BLOCK, 4, PER_BLOCK) if codec == IMA else wav(codec, payload)


def encode_text(docs: DataFrame, codecs: tuple[int, ...] = CODECS, multiple: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8, padded with spaces to a positive multiple, as a WAV file.

    Null text: empty. All codecs keep the payload byte by byte; equal texts get equal files. Other columns
    are ignored; repeated rows stay; empty docs give no rows. A long text is held as a few copies of its bytes.
    """
    if not set(codecs) <= {ULAW, ALAW, IMA} or (IMA in codecs and multiple % BLOCK):
        raise ValueError("payloads are stored as mu-law, A-law, or whole ADPCM blocks")
    arrow_batches(docs.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = K.column_bytes(b.column("text"))
            for x, y in K.chunks(off, 1 << 20):
                media = []
                for i in range(x, y):
                    raw = data[off[i] : off[i + 1]].tobytes()
                    media.append(stored(raw.ljust(max(multiple, -(-len(raw) // multiple) * multiple)), codecs))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(x, y - x), pa.array(np.diff(off)[x:y]), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(go, "doc_id long, n_bytes long, media binary")


def decode_all(files: list[tuple[int, int, int, bytes]]) -> list[np.ndarray]:
    """16-bit samples of files (codec, rate, block, body): ADPCM blocks of one size are decoded together."""
    out: list[np.ndarray] = [None] * len(files)
    whole: dict[int, list[int]] = {}
    for i, (codec, _, block, body) in enumerate(files):
        if codec in EXPAND:
            out[i] = EXPAND[codec][np.frombuffer(body, np.uint8)]
        elif codec == IMA and len(body) % block == 0:
            whole.setdefault(block, []).append(i)
        else:
            out[i] = ima_decode(body, block) if codec == IMA else np.frombuffer(body, "<i2")
    for block, at in whole.items():
        samples = ima_decode(b"".join(files[i][3] for i in at), block)
        ends = np.cumsum([len(files[i][3]) // block * (2 * (block - 4) + 1) for i in at])
        for i, part in zip(at, np.split(samples, ends[:-1])):
            out[i] = part
    return out


def read_media(media: DataFrame, tail: int = 16, rate: int | None = None) -> DataFrame:
    """Adds payload (the data chunk read back), tail_crc32 (of its last bytes), feature, and pcm if a rate is given.

    pcm is a 16-bit PCM WAV file resampled to that rate. Null media: null in all added columns. Takes
    and returns doc_id, n_bytes, media. A long file is decoded, resampled and measured in pieces: beside it, its samples
    and what is stored of it are held once.
    """
    arrow_batches(media.sparkSession)
    names = ["doc_id", "n_bytes", "media"]
    extra = ["payload binary", "tail_crc32 long", "feature string"] + (["pcm binary"] if rate else [])

    def made(files: list) -> list[list]:
        """payload, checksum, feature and resampled file of each."""
        out = []
        for file, samples in zip(files, decode_all(files)):
            out.append([file[3], zlib.crc32(file[3][-tail:]), feature(samples), resampled_wav(samples, rate, file[1]) if rate else None])
        return out

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off = K.column_bytes(b.column("media"))[1]
            for x, y in K.chunks(off, 1 << 20):  # ADPCM blocks of so many files are decoded together
                part = b.slice(x, y - x)
                raw = [m.as_buffer() if m.is_valid else None for m in part.column("media")]
                found = iter(made([read_wav(memoryview(m)) for m in raw if m is not None]))
                rows = [[None] * 4 if m is None else next(found) for m in raw]
                cols = [binaries([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())]
                cols += [binaries([r[3] for r in rows])] if rate else []
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in names), *cols], names + [e.split()[0] for e in extra])

    return media.select(*names).mapInArrow(go, ", ".join(["doc_id long", "n_bytes long", "media binary", *extra]))
