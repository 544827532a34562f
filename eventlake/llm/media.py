"""AVI motion-JPEG media columns.

A payload of bytes becomes an AVI file of lossless JPEG frames (process 14: predictor 1 and 8-bit samples), 64 samples
wide. The Huffman table gives a difference of k bits a code of 9 - k bits, so every sample takes 9 bits and both ways
are array operations; frames with other tables are decoded bit by bit. Reading parses the RIFF index, decodes the intra
frames and cuts shots where the histogram difference of neighbours is far above those around it.

Defined results: a null or empty text is one row of zeros; null doc_ids and repeated rows are rows like others; equal
texts give equal values; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table, texts_of

WIDTH = 64
#: Rows of samples in a frame.
HEIGHT = 64
FPS = 25
#: A cut needs a difference of this many deviations above the mean of those around it, and of this part of all samples.
DEVIATIONS, LEAST, AROUND = 3.0, 0.25, 8
_BITS = 9


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """The 9-bit word of each difference -255..255, and the difference of each word (the last word is none)."""
    d = np.arange(-255, 256)
    size = np.array([int(abs(x)).bit_length() for x in d.tolist()])
    extra = np.where(d < 0, d + (1 << size) - 1, d)
    prefix = np.where(size == 8, 0, (1 << (8 - size)) * 2 - 2)  # 0, 10, 110, ... for 8, 7, 6, ... bits
    word = prefix << size | extra
    back = np.zeros(512, np.int64)
    back[word] = d
    return word.astype(np.uint16), back


_WORD, _BACK = _codes()
_TABLE = struct.pack(">HHB16B9B", 0xFFC4, 28, 0, *([1] * 9 + [0] * 7), *range(8, -1, -1))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">HH", marker, len(body) + 2) + body


def frame(samples: np.ndarray) -> bytes:
    """One lossless JPEG of (rows, WIDTH) 8-bit samples."""
    rows, width = samples.shape
    wide = samples.astype(np.int16)
    diff = np.empty_like(wide)
    diff[:, 1:] = wide[:, 1:] - wide[:, :-1]
    diff[1:, 0] = wide[1:, 0] - wide[:-1, 0]  # the first of a row is predicted by the one above
    diff[0, 0] = wide[0, 0] - 128
    word = _WORD[diff.ravel() + 255]
    bits = np.empty((len(word), _BITS), np.uint8)
    for k in range(_BITS):
        bits[:, k] = (word >> (_BITS - 1 - k)) & 1
    flat = bits.ravel()
    coded = np.packbits(np.concatenate([flat, np.ones(-len(flat) % 8, np.uint8)]) if len(flat) % 8 else flat).tobytes().replace(b"\xff", b"\xff\x00")
    head = _segment(0xFFC3, struct.pack(">BHHBBBB", 8, rows, width, 1, 1, 0x11, 0)) + _TABLE + _segment(0xFFDA, struct.pack(">BBBBBB", 1, 1, 0, 1, 0, 0))
    return b"\xff\xd8" + head + coded + b"\xff\xd9"


def decoded(jpeg: bytes) -> np.ndarray:
    """The samples of a lossless JPEG of one component with predictor 1."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, lengths, values = 2, None, None
    while True:
        marker, size = struct.unpack_from(">HH", jpeg, at)
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFFC3:
            bits, rows, width, parts = struct.unpack_from(">BHHB", body)
            if bits != 8 or parts != 1:
                raise ValueError("only one component of 8 bits is read")
        elif marker == 0xFFC4:
            lengths = list(body[1:17])
            values = list(body[17 : 17 + sum(lengths)])
        elif marker == 0xFFDA:
            break
        elif marker >> 4 == 0xFFC:
            raise ValueError("only lossless frames are read")
    raw = jpeg[at : jpeg.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff")
    n = rows * width
    if lengths == [1] * 9 + [0] * 7 and values == list(range(8, -1, -1)):
        bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * _BITS).reshape(n, _BITS)
        word = bits[:, 0].astype(np.uint16)
        for k in range(1, _BITS):
            word = word << 1 | bits[:, k]
        diff = _BACK[word]
    else:
        diff = _bit_by_bit(raw, lengths, values, n)
    diff = diff.reshape(rows, width)
    first = 128 + np.cumsum(diff[:, 0])
    diff = diff.copy()
    diff[:, 0] = first
    return (np.cumsum(diff, axis=1) & 0xFF).astype(np.uint8)


def _bit_by_bit(raw: bytes, lengths: list[int], values: list[int], n: int) -> np.ndarray:
    code, codes, at = 0, {}, 0
    for size, count in enumerate(lengths, 1):
        for _ in range(count):
            codes[size, code] = values[at]
            code, at = code + 1, at + 1
        code <<= 1
    whole, total, at, out = int.from_bytes(raw, "big"), len(raw) * 8, 0, np.zeros(n, np.int64)
    take = lambda a, k: whole >> (total - a - k) & ((1 << k) - 1)
    for i in range(n):
        size = 1
        while (k := codes.get((size, take(at, size)))) is None:
            size += 1
        extra = take(at + size, k) if k else 0
        out[i] = extra if not k or extra >> (k - 1) else extra - (1 << k) + 1
        at += size + k
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(payload: bytes) -> bytes:
    """payload, a multiple of WIDTH bytes, as an AVI file; the last frame may be lower than the others."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    frames = [frame(samples[i : i + HEIGHT]) for i in range(0, len(samples), HEIGHT)]
    height, largest = min(HEIGHT, len(samples)), max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, WIDTH, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, height)
    shape = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 8, b"MJPG", WIDTH * height, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", shape)))
    at, index, movie = 4, [], []
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movie.append(_chunk(b"00dc", f))
        at += len(movie[-1])
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"movi" + b"".join(movie)) + _chunk(b"idx1", b"".join(index)))


def parsed(data: bytes) -> tuple[float, list[tuple[int, int]]]:
    """Seconds of a frame, and (place, length) of each video frame by the file's index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movie, seconds, index = 12, 0, 1 / FPS, b""
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"LIST" and data[at + 8 : at + 12] == b"hdrl" and data[at + 12 : at + 16] == b"avih":
            seconds = struct.unpack_from("<I", data, at + 20)[0] / 1e6
        elif name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movie = at + 8
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    found = []
    for name, _, place, length in struct.iter_unpack("<4sIII", index):
        if name[2:] in (b"dc", b"db"):
            # offsets count from the word "movi", or in some files from the start
            place = place if data[place : place + 4] == name and struct.unpack_from("<I", data, place + 4)[0] == length and data[movie + place : movie + place + 4] != name else movie + place
            found.append((place + 8, length))
    return seconds, found


def shots(frames: list[np.ndarray]) -> list[tuple[int, int]]:
    """First and last frame of each shot."""
    if len(frames) < 2:
        return [(0, len(frames) - 1)]
    share = np.stack([np.bincount(f.ravel() >> 4, minlength=16) / f.size for f in frames])
    diff = np.abs(np.diff(share, axis=0)).sum(1) / 2
    sums, squares = np.concatenate([[0], np.cumsum(diff)]), np.concatenate([[0], np.cumsum(diff * diff)])
    k = np.arange(len(diff))
    a, b = np.maximum(k - AROUND, 0), np.minimum(k + AROUND + 1, len(diff))
    n = np.maximum(b - a - 1, 1)
    mean = (sums[b] - sums[a] - diff) / n
    spread = np.sqrt(np.maximum((squares[b] - squares[a] - diff * diff) / n - mean * mean, 0))
    cuts = np.flatnonzero((diff >= LEAST) & (diff > mean + DEVIATIONS * spread)) + 1
    edges = [0, *cuts.tolist(), len(frames)]
    return [(x, y - 1) for x, y in zip(edges, edges[1:], strict=False)]


def clips(data: bytes) -> tuple[bytes, list[tuple[float, float, int, float]]]:
    """The samples of an AVI file, and for each shot: start and end in seconds, frames, mean sample."""
    seconds, index = parsed(data)
    frames = [decoded(data[a : a + n]) for a, n in index]
    made = [(x * seconds, (y + 1) * seconds, y - x + 1, float(np.concatenate([f.ravel() for f in frames[x : y + 1]]).mean())) for x, y in shots(frames)]
    return b"".join(f.tobytes() for f in frames), made


def store(docs: DataFrame, multiple: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes and media: the text's UTF-8 and zeros up to a positive multiple, as AVI."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(t or "").encode() for t in batch["text"].to_pylist()]
        media = [avi(r + b"\0" * (-len(r) % multiple or (0 if r else multiple))) for r in raw]
        return pa.record_batch([batch["doc_id"], pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_texts(docs, one, "doc_id long, n_bytes long, media binary")


def clip_rows(media: DataFrame) -> DataFrame:
    """One row for each shot of the media column: doc_id, shot, start_s, end_s, n_frames, mean_sample."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, k, *c) for i, m in enumerate(batch["media"].to_pylist()) if m for k, c in enumerate(clips(m)[1])]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        return pa.record_batch([batch["doc_id"].take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(cols[k], t) for k, t in ((2, pa.float64()), (3, pa.float64()), (4, pa.int32()), (5, pa.float64())))], ["doc_id", "shot", "start_s", "end_s", "n_frames", "mean_sample"])

    return map_texts(media, one, "doc_id long, shot int, start_s double, end_s double, n_frames int, mean_sample double", "media")


def digests(media: DataFrame) -> DataFrame:
    """What is read back from the media column, in digests, with the shots as text."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for m in batch["media"].to_pylist():
            samples, found = clips(m)
            out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(m), hashlib.sha256(m).hexdigest(), ";".join(f"{a:.2f}-{b:.2f}:{n}:{v:.3f}" for a, b, n, v in found)))
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.record_batch([batch["doc_id"], batch["n_bytes"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_texts(media, one, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", "media")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(store(texts_of(table(spark, sf_dir, "documents"))))
