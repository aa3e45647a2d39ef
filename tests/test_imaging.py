import struct
import zlib

import numpy as np
import pytest

from glyphmill.operators import imaging
from glyphmill.sources import png

rng = np.random.default_rng(9)


def filtered(pixels, kinds):
    """A PNG whose rows use the given filters."""
    h, w = pixels.shape[:2]
    step = 1 if pixels.ndim == 2 else pixels.shape[2]
    flat = pixels.reshape(h, -1).astype(int)
    raw = b""
    for y in range(h):
        up = flat[y - 1] if y else np.zeros_like(flat[0])
        left = np.concatenate([np.zeros(step, int), flat[y][:-step]])
        corner = np.concatenate([np.zeros(step, int), up[:-step]])
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [np.zeros_like(up), left, up, (left + up) // 2, near][kinds[y % len(kinds)]]
        raw += bytes([kinds[y % len(kinds)]]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes()

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    colour = {1: 0, 2: 4, 3: 2, 4: 6}[step]
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("shape", [(7, 5), (7, 5, 3)])
def test_png_round_trip_and_all_filters(shape):
    pixels = rng.integers(0, 256, shape).astype(np.uint8)
    assert (png.decode(png.encode(pixels)) == pixels).all()
    assert (png.decode(filtered(pixels, [0, 1, 2, 3, 4])) == pixels).all()


def test_png_faults():
    good = png.encode(np.zeros((4, 4), np.uint8))
    for bad in (b"x", good[:40], png.SIGNATURE):
        with pytest.raises((ValueError, zlib.error)):
            png.decode(bad)
    with pytest.raises(ValueError, match="too many"):
        png.decode(good, most_pixels=3)
    clear = np.zeros((2, 2, 4), np.uint8)
    assert png.decode(filtered(clear, [0])).tolist() == [[[255] * 3] * 2] * 2


def page():
    """Two framed panels; in the first a white balloon with three letters on grey."""
    p = np.full((300, 300), 255, np.uint8)
    for x in (10, 160):
        p[10:290, x : x + 130] = 150
        p[10:290, x : x + 2] = p[10:290, x + 128 : x + 130] = p[10:12, x : x + 130] = p[288:290, x : x + 130] = 0
    yy, xx = np.mgrid[:300, :300]
    oval = ((xx - 75) / 45) ** 2 + ((yy - 90) / 32) ** 2
    p[oval <= 1.1] = 0
    p[oval <= 1] = 255
    for x in (58, 72, 86):
        p[80:100, x : x + 4] = 0
        p[80:84, x : x + 9] = 0
    return p


def test_pages_are_detected_cleaned_and_proven(spark):
    picture = png.encode(page())
    df = spark.createDataFrame([(1, picture), (2, None), (3, b"junk")], "k bigint, picture binary")
    facts = {r.k: r for r in imaging.facts(df, "k", "picture").collect()}
    assert (facts[1].width, facts[1].height, len(facts[1].appearance)) == (300, 300, 64) and facts[2].fault == "no picture" and facts[3].fault == "no PNG"
    found = {r.k: r for r in imaging.detect(df, "k", "picture").collect()}[1]
    (balloon,) = [b for b in found.balloons if b.polarity == "light"]
    x, y, w, h = balloon.bbox
    assert abs(x - 31) <= 3 and abs(y - 59) <= 3 and abs(w - 89) <= 6 and abs(h - 63) <= 6
    assert balloon.text == [58, 80, 37, 20] and len(found.panels) == 2
    work = spark.createDataFrame([(1, picture, [balloon.text, [200, 200, 40, 40]])], "k bigint, picture binary, boxes array<array<int>>")
    done = imaging.clean(work, "k", "picture", "boxes").first()
    assert done.outcomes[0] == "flat"
    after = png.decode(done.cleaned)
    assert (after[78:102, 56:97] == 255).all() and after[10, 10] == 0
    proof = imaging.proofs(spark.createDataFrame([(1, picture, done.cleaned, done.mask)], "k bigint, a binary, b binary, m binary"), "k", "a", "b", "m").first()
    assert proof.changed == 0 and proof.surviving == 1.0 and 0 < proof.coverage < 0.05
    other = imaging.proofs(spark.createDataFrame([(1, picture, png.encode(np.zeros((5, 5), np.uint8)), done.mask)], "k bigint, a binary, b binary, m binary"), "k", "a", "b", "m").first()
    assert other.fault == "sizes differ"
