"""Media columns: PNG files made and read with zlib and numpy, and low-frequency cosine-transform hashes.

write_png() stores 8-bit RGB samples as PNG chunks (length, type, data, CRC-32); read_png() walks the chunks,
checks each CRC and the stream's Adler-32 (in zlib), undoes the five scanline filters with numpy and returns
the samples. cosine_hash() reduces the luminance to 32 x 32 means, takes the two-dimensional cosine transform
and sets one bit for each of the 8 x 8 lowest frequencies above their median.

with_media() adds them as columns in one pass over Arrow batches: no shuffle, memory bounded by one batch.

Defined results: a null text is the empty text, which becomes one scanline of spaces; equal texts give equal
media, hash and digests; very long texts become tall images of the same width; an empty table gives an empty
result; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: One scanline: 64 pixels of 3 samples.
WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
SIDE, LOW = 32, 8


class DamagedImage(ValueError):
    """The bytes are not a whole PNG of the supported kind."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _entropy(samples: np.ndarray) -> float:
    counts = np.bincount(samples.ravel(), minlength=256)
    share = counts[counts > 0] / samples.size
    return float(-(share * np.log2(share)).sum())


def write_png(samples: bytes, level: int = 1) -> bytes:
    """A PNG of 8-bit RGB scanlines of ROW samples each; len(samples) must be a positive multiple of ROW."""
    if not samples or len(samples) % ROW:
        raise ValueError(f"samples must be a positive multiple of {ROW}")
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    up = rows.copy()
    up[1:] -= rows[:-1]
    kind, best = (2, up) if _entropy(up) < _entropy(rows) else (0, rows)
    lines = np.empty((len(rows), ROW + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = best
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _chunks(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 12 <= len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + size]
        if len(data) != size or media[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + data)):
            raise DamagedImage(f"chunk {kind!r} fails its checksum")
        yield kind, data
        at += 12 + size
        if kind == b"IEND":
            return
    raise DamagedImage("the file ends before IEND")


def unfilter(kinds: np.ndarray, residuals: np.ndarray, step: int) -> np.ndarray:
    """Undo PNG scanline filters 0 to 4; residuals is (rows, bytes), step the bytes of a pixel."""
    out = residuals.copy()
    if (kinds == 0).all():
        return out
    if (kinds == 2).all():
        return np.cumsum(out, axis=0, dtype=np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, kind in enumerate(kinds):
        line = out[y]
        if kind == 1:
            line[:] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            line += above
        elif kind == 3 or kind == 4:
            left, corner = np.zeros(step, np.int16), np.zeros(step, np.int16)
            for x in range(0, len(line), step):
                b = above[x : x + step].astype(np.int16)
                if kind == 3:
                    guess = (left + b) // 2
                else:
                    p = left + b - corner
                    da, db, dc = abs(p - left), abs(p - b), abs(p - corner)
                    guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, b, corner))
                line[x : x + step] += guess.astype(np.uint8)
                left, corner = line[x : x + step].astype(np.int16), b
        elif kind != 0:
            raise DamagedImage(f"filter {kind}")
        above = line
    return out


def read_png(media: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, samples as (height, width * channels)); raises DamagedImage for anything damaged."""
    if media[: len(SIGNATURE)] != SIGNATURE:
        raise DamagedImage("no PNG signature")
    parts = list(_chunks(media))
    if not parts or parts[0][0] != b"IHDR" or len(parts[0][1]) != 13:
        raise DamagedImage("no header")
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[0][1])
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlaced:
        raise DamagedImage("only 8-bit samples without palette or interlace")
    try:
        raw = zlib.decompress(b"".join(data for kind, data in parts if kind == b"IDAT"))
    except zlib.error as e:
        raise DamagedImage(str(e)) from e
    if len(raw) != height * (width * channels + 1):
        raise DamagedImage("the image data has another size")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width * channels + 1)
    return width, height, unfilter(lines[:, 0], lines[:, 1:], channels)


def _cosine(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


_BASIS = _cosine(SIDE, LOW)


def cosine_hash(samples: np.ndarray, channels: int = CHANNELS) -> bytes:
    """8 bytes: which of the lowest frequencies of the 32 x 32 luminance lie above their median."""
    height = len(samples)
    light = samples.reshape(height, -1, channels).sum(axis=2, dtype=np.int64)
    rows = np.arange(SIDE + 1) * height // SIDE
    if height >= SIDE:
        small = np.add.reduceat(light, rows[:-1], axis=0) / np.diff(rows)[:, None]
    else:
        small = light[np.arange(SIDE) * height // SIDE].astype(float)
    small = small.reshape(SIDE, SIDE, -1).mean(axis=2)
    low = (_BASIS @ small @ _BASIS.T).ravel()
    low[0] = 0.0  # the mean says nothing about the shape
    return np.packbits(low > np.median(low)).tobytes()


def _payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(ROW, -(-len(data) // ROW) * ROW), b" ")


#: name, Spark type, Arrow type of what with_media() adds
COLUMNS = (
    ("n_bytes", T.LongType(), pa.int64()), ("payload_bytes", T.LongType(), pa.int64()), ("payload_sha256", T.StringType(), pa.string()), ("tail_crc32", T.LongType(), pa.int64()),
    ("media_bytes", T.LongType(), pa.int64()), ("media_sha256", T.StringType(), pa.string()), ("phash", T.BinaryType(), pa.binary()), ("media", T.BinaryType(), pa.binary()),
)


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True, level: int = 1) -> DataFrame:
    """id, sizes, digests of what was read back, the cosine hash and, unless keep_media is false, the PNG itself."""
    columns = [c for c in COLUMNS if keep_media or c[0] != "media"]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c[0]: [] for c in COLUMNS}
            for text in batch.column(1).to_pylist():
                size, payload = _payload(text)
                media = write_png(payload, level)
                _, _, samples = read_png(media)
                back = samples.tobytes()
                row = (size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples), media if keep_media else b"")
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[c[0]], c[2]) for c in columns)], names=["id", *(c[0] for c in columns)])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c[0], c[1]) for c in columns)])
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(store, schema)
