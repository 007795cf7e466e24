"""PNG images in binary columns: writing, checked reading, and low-frequency cosine hashes."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .arrow import with_python_columns

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes in a row of the images that stand for texts.
ROW = 64
NONE, SUB, UP, AVERAGE, PAETH = range(5)
#: Images are reduced to a square of this side, of which the hash takes the lowest 8 x 8 frequencies.
SIDE, LOW = 32, 8


class BadImage(ValueError):
    """The bytes aren't a whole PNG of 8-bit grey samples."""


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def filtered(image: np.ndarray, kind: int) -> np.ndarray:
    """The image's rows after one of the filters none, sub or up (modulo 256)."""
    out = image.copy()
    if kind == SUB:
        out[:, 1:] -= image[:, :-1]
    elif kind == UP:
        out[1:] -= image[:-1]
    return out


def cheapest_filter(image: np.ndarray) -> tuple[int, np.ndarray]:
    """The filter with the least sum of absolute differences, as is usual for PNG writers."""
    options = [(kind, filtered(image, kind)) for kind in (NONE, SUB, UP)]
    costs = [int(np.abs(rows.view(np.int8).astype(np.int16)).sum(dtype=np.int64)) for _, rows in options]
    return options[int(np.argmin(costs))]


def write_png(image: np.ndarray) -> bytes:
    """An 8-bit grey image (rows, columns) as PNG."""
    height, width = image.shape
    kind, rows = cheapest_filter(image)
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, rows
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Undoes the filters of an image's rows; the first column of ``lines`` names each row's filter.

    Runs of rows with one of the filters none, sub and up are undone at once; the other two go sample by sample.
    """
    kinds, rows = lines[:, 0], lines[:, 1:]
    out = np.empty_like(rows)
    width = rows.shape[1]
    above = np.zeros(width, np.uint8)
    cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(rows)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        kind, run = int(kinds[lo]), rows[lo:hi]
        if kind == NONE:
            out[lo:hi] = run
        elif kind == SUB:
            np.cumsum(run, axis=1, dtype=np.uint8, out=out[lo:hi])
        elif kind == UP:
            np.cumsum(run, axis=0, dtype=np.uint8, out=out[lo:hi])
            out[lo:hi] += above
        elif kind in (AVERAGE, PAETH):
            for y in range(lo, hi):
                undo_row(rows[y], above, out[y], kind)
                above = out[y]
        else:
            raise BadImage(f"unknown row filter {kind}")
        above = out[hi - 1]
    return out


def undo_row(row: np.ndarray, above: np.ndarray, out: np.ndarray, kind: int) -> None:
    left = corner = 0
    for x in range(len(row)):
        up = int(above[x])
        if kind == AVERAGE:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            near = (abs(p - left), abs(p - up), abs(p - corner))
            guess = (left, up, corner)[near.index(min(near))]
        left = (int(row[x]) + guess) & 255
        corner = up
        out[x] = left


def read_png(data: bytes) -> np.ndarray:
    """Reads an 8-bit grey PNG without interlacing; tests every chunk's checksum and the order and size of the chunks."""
    if data[:8] != SIGNATURE:
        raise BadImage("no PNG signature")
    at, size, packed, ended = 8, None, [], False
    while at < len(data):
        if ended or at + 12 > len(data):
            raise BadImage("data after the end or a cut chunk")
        length, kind = struct.unpack(">I4s", data[at : at + 8])
        body, stated = data[at + 8 : at + 8 + length], data[at + 8 + length : at + 12 + length]
        if len(stated) < 4 or zlib.crc32(body, zlib.crc32(kind)) != struct.unpack(">I", stated)[0]:
            raise BadImage(f"wrong checksum in {kind!r}")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise BadImage("not 8-bit grey without interlacing")
            size = (height, width)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        at += 12 + length
    if size is None or not ended:
        raise BadImage("no header or no end")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as wrong:
        raise BadImage(str(wrong)) from wrong
    if len(raw) != size[0] * (size[1] + 1) or not size[0] or not size[1]:
        raise BadImage("wrong number of samples")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(size[0], size[1] + 1))


@lru_cache(maxsize=1)
def cosines() -> np.ndarray:
    """The first LOW basis vectors of the type-II cosine transform of SIDE samples."""
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * SIDE))


def reduced(image: np.ndarray) -> np.ndarray:
    """Means over a SIDE x SIDE grid of cells; short axes repeat their samples."""
    for axis in (0, 1):
        n = image.shape[axis]
        at = np.arange(SIDE) * n // SIDE
        count = np.maximum(np.diff(np.append(at, n)), 1)
        sums = np.add.reduceat(image.astype(np.float64, copy=False), at, axis=axis)
        image = sums / (count[:, None] if axis == 0 else count[None, :])
    return image


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies, the mean apart, lie above their median."""
    low = cosines() @ reduced(image) @ cosines().T
    flat = np.round(low.ravel(), 6)
    return np.packbits(flat > np.median(flat[1:])).tobytes()


def payload_of(data: bytes) -> bytes:
    """The bytes, filled with zeros to a positive multiple of ROW."""
    return data + bytes(-len(data) % ROW if data else ROW)


def with_media(df: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """Adds a binary column with the PNG of the bytes in ``payload``, ROW samples to a row, zeros at the end.

    Null and empty payloads give an image of one row of zeros. Equal payloads give equal images.
    """

    def encode(payloads: list[bytes | None]) -> list[list[bytes]]:
        return [[write_png(np.frombuffer(payload_of(x or b""), np.uint8).reshape(-1, ROW)) for x in payloads]]

    return with_python_columns(df.withColumn(payload, F.col(payload).cast("binary")), [payload], StructType([StructField(media, BinaryType())]), encode)


FEATURES = "payload binary, hash binary, width int, height int, image_error string"


def with_media_features(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds the samples read back from the PNG, their 64-bit cosine hash, the size, and what is wrong with the image.

    The columns are payload, hash, width, height and image_error, and replace those of these names. Null media give
    nulls and the error ``no image``; damaged ones nulls and their error.
    """

    def decode(images: list[bytes | None]) -> list[list]:
        rows = []
        for x in images:
            try:
                image = read_png(x or b"")
                rows.append((image.tobytes(), cosine_hash(image), image.shape[1], image.shape[0], None))
            except BadImage as wrong:
                rows.append((None, None, None, None, "no image" if x is None else str(wrong)))
        return [list(column) for column in zip(*rows, strict=True)]

    return with_python_columns(df, [media], StructType.fromDDL(FEATURES), decode)


def op7_media(spark, sf_dir: str) -> DataFrame:
    """Every text as a PNG, read back with its checksums tested; ``feature`` is the cosine hash in hex."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    written = with_media(raw, "raw").select("doc_id", F.length("raw").cast("long").alias("n_bytes"), "media")
    read = with_media_features(written)
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{ROW}, {ROW})")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("hash")).alias("feature"),
    )
