"""The cosine feature against its definition, damaged headers, and very many equal rows in shards."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinworks.llm import media, sharding


def feature_by_hand(pixels):
    h, w = pixels.shape
    found = []
    for total in range(11):
        for i in range(total + 1):
            j = total - i
            value = sum(float(pixels[y, x]) * math.cos(math.pi / h * i * (y + 0.5)) * math.cos(math.pi / w * j * (x + 0.5)) for y in range(h) for x in range(w))
            found.append(round(value / pixels.size, 6))
    found = found[1:65]
    middle = float(np.median(found))
    return [v > middle for v in found], [abs(v - middle) for v in found]


def test_feature_by_its_definition():
    r = np.random.default_rng(4)
    for h in (1, 3, 17):
        pixels = r.integers(0, 256, (h, 64), np.uint8)
        bits, far = feature_by_hand(pixels)
        got = np.unpackbits(np.frombuffer(media.dct_hash(pixels), np.uint8)).astype(bool).tolist()
        assert len(got) == 64 and all(a == b for a, b, d in zip(got, bits, far, strict=True) if d > 2e-6)
    flat = media.dct_hash(np.full((5, 64), 7, np.uint8))
    assert flat == b"\0" * 8  # a constant image has no frequency but the constant one


def test_headers_that_no_image_has():
    image = media.encode_png(np.arange(128, dtype=np.uint8).reshape(2, 64))
    header, rest = image[8:33], image[33:]
    short = media._chunk(b"IHDR", header[8:20])
    for bad in (media.SIGNATURE + short + rest, media.SIGNATURE + rest, media.SIGNATURE + rest[: struct.unpack(">I", rest[:4])[0] + 12] + header + rest, media.SIGNATURE + header + header + rest, image + b"x", media.SIGNATURE):
        with pytest.raises(media.MediaError):
            media.decode_png(bad)
    assert (media.decode_png(image) == np.arange(128, dtype=np.uint8).reshape(2, 64)).all()


def test_very_many_equal_rows_are_dealt_out(spark, monkeypatch):
    rows = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text")).union(spark.range(200).selectExpr("id AS doc_id", "CAST(id AS string) AS text"))
    whole = sorted((r["shard"], r["slot"], r["doc_id"]) for r in sharding.shard_slots(rows, 4).collect())
    monkeypatch.setattr(sharding, "PART", 7)
    dealt = sorted((r["shard"], r["slot"], r["doc_id"]) for r in sharding.shard_slots(rows, 4).collect())
    assert dealt == whole and len(whole) == 3200
