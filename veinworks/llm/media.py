"""Media columns: lossless PNG bytes and cosine-transform hashes.

``encode_png`` writes 8-bit greyscale PNG: signature, IHDR, IDAT (zlib), IEND,
each chunk with its CRC-32, and for each row the filter of None, Sub and Up
that leaves the least differences. ``decode_png`` tests the signature, every chunk's
checksum, the header and the length of the data, and undoes all five row
filters with numpy. ``dct_hash`` takes the 64 lowest frequencies of the
two-dimensional cosine transform, without the constant one, and keeps for
each whether it is above their median: 64 bits in a binary column.

Defined cases: a null text counts as empty and is stored as one row of zero
bytes; equal texts give equal bytes and hashes; rows that repeat are each
kept; an empty table gives no rows; of the input only ``doc_id`` and ``text``
are read.
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

from veinworks.llm.storage import checkpointed

#: Fixed values of the file format: its signature, and the filter types None, Sub, Up, Average, Paeth.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
WIDTH = 64
#: Frequencies computed in each direction; the 64 lowest after the constant one have sums of up to 10.
FREQUENCIES = 11


class MediaError(ValueError):
    """The bytes are not a PNG of the kind that ``encode_png`` writes, or are damaged."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _predictions(pixels: np.ndarray) -> dict[int, np.ndarray]:
    """What each filter type but None predicts for every pixel."""
    x = pixels.astype(np.int16)
    a = np.pad(x, ((0, 0), (1, 0)))[:, :-1]
    b = np.pad(x, ((1, 0), (0, 0)))[:-1]
    c = np.pad(x, ((1, 0), (1, 0)))[:-1, :-1]
    return {SUB: a, UP: b, AVERAGE: (a + b) // 2, PAETH: _paeth(a, b, c)}


def chosen_filters(pixels: np.ndarray) -> np.ndarray:
    """For each row the type of None, Sub and Up whose differences have the least sum of absolute values (as signed bytes).

    Sub and Up must leave a quarter of None's at most: text has repeated strings, which compress better unfiltered.
    """
    left, above = np.zeros_like(pixels), np.zeros_like(pixels)
    left[:, 1:], above[1:] = pixels[:, :-1], pixels[:-1]
    sums = [weight * np.abs((pixels - p).view(np.int8).astype(np.int16)).sum(axis=1) for weight, p in ((1, np.zeros_like(pixels)), (4, left), (4, above))]
    return np.argmin(sums, axis=0).astype(np.uint8)


def encode_png(pixels: np.ndarray, filters: np.ndarray | int | None = None, level: int = 6) -> bytes:
    """8-bit greyscale PNG of a two-dimensional uint8 array; ``filters`` is one type, one for each row, or None to choose for each row."""
    height, width = pixels.shape
    kinds = chosen_filters(pixels) if filters is None else np.broadcast_to(np.asarray(filters, np.uint8), (height,))
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = kinds, pixels
    if kinds.max(initial=0) > UP:
        for kind, predicted in _predictions(pixels).items():
            mine = kinds == kind
            rows[mine, 1:] = ((pixels.astype(np.int16) - predicted) % 256)[mine]
    elif kinds.any():
        sub, up = np.flatnonzero(kinds == SUB), np.flatnonzero(kinds == UP)
        rows[sub, 2:] -= pixels[sub, :-1]
        up = up[up > 0]
        rows[up, 1:] -= pixels[up - 1]
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, above and above left, the one nearest to left + above - above left."""
    near = a + b - c
    to_a, to_b, to_c = abs(near - a), abs(near - b), abs(near - c)
    return np.where((to_a <= to_b) & (to_a <= to_c), a, np.where(to_b <= to_c, b, c))


def decode_png(data: bytes) -> np.ndarray:
    """The pixels of an 8-bit greyscale PNG; raises MediaError if it is damaged."""
    if data[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, packed, header, ended = 8, [], None, False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise MediaError("a chunk is cut off")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data) or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise MediaError(f"the checksum of chunk {kind!r} is wrong")
        if (kind == b"IHDR") != (at == 8):
            raise MediaError("the header isn't the first chunk, or is there twice")
        at += 12 + n
        if kind == b"IHDR":
            if n != 13:
                raise MediaError(f"a header of {n} bytes")
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
    if at != len(data):
        raise MediaError("data after the end")
    if header is None or not ended or header[2:] != (8, 0, 0, 0, 0):
        raise MediaError("not a whole 8-bit greyscale image")
    width, height = header[:2]
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != height * (width + 1):
        raise MediaError("the data has another length than the header says")
    rows = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return unfiltered(rows[:, 0], rows[:, 1:])


def unfiltered(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo each row's filter, with sums modulo 256."""
    if not kinds.any():
        return rows
    if kinds.max() > PAETH:
        raise MediaError("an unknown filter type")
    if kinds.max() > UP:
        return _swept(kinds, rows)
    out = rows.copy()
    sub = kinds == SUB
    out[sub] = np.cumsum(rows[sub], axis=1, dtype=np.uint8)
    up = kinds == UP
    if up.any():
        # an Up row is the last other row before it plus the sum of the Up rows since then
        padded = np.zeros((len(rows) + 1, rows.shape[1]), np.uint8)
        padded[1:][~up] = out[~up]
        sums = np.zeros_like(padded)
        np.cumsum(np.where(up[:, None], rows, 0), axis=0, dtype=np.uint8, out=sums[1:])
        base = np.maximum.accumulate(np.where(up, 0, np.arange(1, len(rows) + 1)))[up]
        out[up] = padded[base] + sums[1:][up] - sums[base]
    return out


def _swept(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All five filters, by sweeps over the diagonals: the pixels of one need only those of the two before it."""
    height, width = rows.shape
    out = np.zeros((height + 1, width + 1), np.int16)
    for d in range(height + width - 1):
        i = np.arange(max(0, d - width + 1), min(height, d + 1))
        j = d - i
        kind, a, b, c = kinds[i], out[i + 1, j], out[i, j + 1], out[i, j]
        guess = np.choose(kind, (np.zeros_like(a), a, b, (a + b) // 2, _paeth(a, b, c)))
        out[i + 1, j + 1] = (rows[i, j] + guess) % 256
    return out[1:, 1:].astype(np.uint8)


def _lowest() -> tuple[np.ndarray, np.ndarray]:
    """The places of the 64 frequencies of least sum after the constant one, in that order."""
    i, j = np.divmod(np.arange(FREQUENCIES**2), FREQUENCIES)
    order = np.lexsort((i, i + j))[1:65]
    return i[order], j[order]


_LOWEST = _lowest()


def _cosines(n: int) -> np.ndarray:
    return np.cos(np.pi / n * np.outer(np.arange(FREQUENCIES), np.arange(n) + 0.5))


def dct_hash(pixels: np.ndarray) -> bytes:
    """64 bits: which of the 64 lowest frequencies, the constant one aside, are above their median."""
    low = _cosines(pixels.shape[0]) @ pixels.astype(np.float64) @ _cosines(pixels.shape[1]).T
    values = np.round(low[_LOWEST] / pixels.size, 6)
    return np.packbits(values > np.median(values)).tobytes()


def payload(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes with zero bytes up to a positive multiple of 64, and their number without those."""
    raw = (text or "").encode()
    return raw + b"\0" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw)), len(raw)


def to_media(df: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` and the PNG of each whole text in the binary column ``media``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, images = [], []
            for t in batch.column("_text").to_pylist():
                data, n = payload(t)
                sizes.append(n)
                images.append(encode_png(np.frombuffer(data, np.uint8).reshape(-1, WIDTH)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Decode ``media`` and add the digests of what was read back and the hash, in binary (``hash``) and as hex (``feature``)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image in batch.column("media").to_pylist():
                pixels = decode_png(image)
                data, h = pixels.tobytes(), dct_hash(pixels)
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(image), hashlib.sha256(image).hexdigest(), h.hex(), h))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "hash"],
            )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        decode, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, hash binary"
    )


def media_column(df: DataFrame) -> DataFrame:
    """Store every whole text as a PNG, read the stored bytes back and compute their features."""
    return media_features(checkpointed(to_media(df)))
