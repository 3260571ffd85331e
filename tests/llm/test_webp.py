"""Round trips through every construct of the format, and the media query."""

import hashlib
import zlib

import numpy as np
import pytest

from tidemark.llm import queries as Q
from tidemark.llm import webp as W
from tidemark.llm.media import read_media, store_media

RNG = np.random.default_rng(1)
IMAGE = W.pixels_of((RNG.integers(0, 8, (37, 53, 4)) * 9 + np.arange(53)[None, :, None]).astype(np.int32))
FEW = np.array([0xFF000000, 0xFF00FF00, 0x80123456], np.uint32)[RNG.integers(0, 3, (20, 31))]
TILED = np.tile(IMAGE[:5], (6, 1))


def side(k, b):
    return (k + (1 << b) - 1) >> b


H, WIDE = IMAGE.shape
MODES = RNG.integers(0, 14, (side(H, 3), side(WIDE, 3))).astype(np.uint32)
FACTORS = RNG.integers(0, 2**24, (side(H, 4), side(WIDE, 4))).astype(np.uint32) | np.uint32(0xFF000000)
GROUPS = RNG.integers(0, 4, (side(H, 3), side(WIDE, 3)))


@pytest.mark.parametrize(
    "image, how",
    [
        (IMAGE, {}), (FEW, {}), (TILED, {"matches": True}), (TILED, {"cache_bits": 6}), (TILED, {"cache_bits": 10, "matches": True}), (IMAGE, {"transforms": (("green",),)}),
        (IMAGE, {"transforms": (("predictor", MODES, 3),)}), (IMAGE, {"transforms": (("cross", FACTORS, 4),)}), (IMAGE, {"transforms": (("predictor", MODES, 3), ("cross", FACTORS, 4), ("green",)), "cache_bits": 4, "matches": True}),
        (IMAGE, {"block_bits": 3, "groups": GROUPS}), (FEW, {"palette": True, "matches": True}), (np.full((3, 192), 0xFF202020, np.uint32), {}), (IMAGE[:1, :1], {}),
        (np.array([0xFF000000 + 0x10101 * (i % 17) for i in range(400)], np.uint32).reshape(20, 20), {"palette": True}), (np.full((70, 90), 0xFF010203, np.uint32), {"matches": True, "palette": False}),
    ],
)
def test_round_trip(image, how):
    assert (W.decode_image(W.encode_image(image, **how)) == image).all()


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor(mode):
    modes = np.full((side(H, 2), side(WIDE, 2)), mode, np.uint32)
    assert (W.decode_image(W.encode_image(IMAGE, transforms=(("predictor", modes, 2),))) == IMAGE).all()


def test_known_predictions():
    left, top, right, corner = [10, 20, 30, 40], [50, 60, 70, 80], [5, 5, 5, 5], [20, 30, 40, 50]
    assert W.predicted(0, left, top, right, corner) == [255, 0, 0, 0]
    assert W.predicted(7, left, top, right, corner) == [30, 40, 50, 60]
    assert W.predicted(11, left, top, right, corner) == top
    assert W.predicted(12, left, top, right, corner) == [40, 50, 60, 70]
    assert W.predicted(13, left, top, right, corner) == [35, 45, 55, 65]


def test_code_lengths_stay_short():
    counts = {i: 1 << min(i, 40) for i in range(30)}
    bits = W.code_lengths(counts)
    assert max(bits.values()) <= 15 and sum(2.0**-b for b in bits.values()) == 1
    assert W.code_lengths({5: 9}) == {5: 0} and W.code_lengths({}) == {}


def test_damaged_files():
    file = W.encode_image(IMAGE)
    for bad in (b"RIFX" + file[4:], file[: len(file) // 2], W.encode_image(FEW)[:-20], file[:20] + b"\x00" + file[21:]):
        with pytest.raises(ValueError):
            W.decode_image(bad)


@pytest.mark.parametrize("rows", [16384, 16385, 16389])
def test_payloads_about_the_most_rows_of_an_image(rows):
    payload = (bytes(range(97, 123)) * 200_000)[: 192 * rows]
    media = W.encode_payload(payload)
    assert media.count(b"WEBPVP8L") == 1 and W.decode_payload(media, len(payload)).tobytes() == payload
    assert W.decode_image(media).shape == ((16384, 192) if rows == 16384 else (-(-rows // 2), 384))


def test_payloads_that_repeat_are_written_with_back_references(monkeypatch):
    line = b"the same line of text again and again, number 1234567890. "
    payload = (line * 400)[: 192 * 100]
    assert W._repetitive(np.frombuffer(payload, np.uint8)) and not W._repetitive(RNG.integers(97, 122, 19200).astype(np.uint8))
    media = W.encode_payload(payload)
    assert len(media) < 1000 and W.decode_payload(media, len(payload)).tobytes() == payload
    few = b"abcabd" * 3200
    assert W.decode_payload(W.encode_payload(few), len(few)).tobytes() == few
    monkeypatch.setattr(W, "FARTHEST", 100)  # repeats lie farther than distances can tell
    assert W.decode_payload(W.encode_payload(payload), len(payload)).tobytes() == payload


def test_media_query(spark, sf):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = Q.op7_media_webp(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        raw = docs[r["doc_id"]]
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_media_edges(documents):
    out = {r["doc_id"]: r for r in read_media(store_media(documents([(1, None), (2, ""), (3, "x"), (4, "y" * 192), (5, "x"), (None, "z")]))).collect()}
    assert bytes(out[1]["payload"]) == bytes(out[2]["payload"]) == b" " * 192 and out[4]["n_bytes"] == 192 and len(out[4]["payload"]) == 192
    assert out[3]["media"] == out[5]["media"] and out[3]["feature"] == out[5]["feature"] and None in out
    assert read_media(store_media(documents([(1, "x")]).limit(0))).count() == 0
