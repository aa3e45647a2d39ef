"""PNG pictures of eight bits a sample to and from arrays, with the standard library and numpy.

Grey, grey with alpha, RGB, RGBA and palette pictures without interlacing; any other raises. The
size is checked against a limit before a byte is unpacked.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples per pixel by colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
MOST_PIXELS = 80_000_000


def chunks(data: bytes):
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += size + 12


def decode(data: bytes, most_pixels: int = MOST_PIXELS) -> np.ndarray:
    """(height, width) of grey or (height, width, 3) of colour; alpha is laid on white."""
    if not data.startswith(SIGNATURE):
        raise ValueError("no PNG")
    head = palette = None
    packed = []
    for kind, body in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in SAMPLES or interlaced:
        raise ValueError(f"not supported: {depth} bits, colour type {colour}, interlaced {interlaced}")
    if not width or not height or width * height > most_pixels:
        raise ValueError("too many pixels or none")
    step = SAMPLES[colour]
    row = width * step + 1
    opened = zlib.decompressobj()
    raw = opened.decompress(b"".join(packed), row * height + 1)
    if len(raw) != row * height:
        raise ValueError("cut short or too long")
    pixels = _unfiltered(np.frombuffer(raw, dtype=np.uint8).reshape(height, row), step).reshape(height, width, step)
    if colour == 3:
        return palette[pixels[..., 0]]
    if colour in (4, 6):
        alpha = pixels[..., -1:].astype(np.float64) / 255
        pixels = np.rint(pixels[..., :-1] * alpha + 255 * (1 - alpha)).astype(np.uint8)
    return pixels[..., 0] if pixels.shape[2] == 1 else pixels


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Rows without their filters; each is undone against the row above."""
    out = np.zeros((rows.shape[0] + 1, rows.shape[1] - 1), dtype=np.uint8)
    for y, line in enumerate(rows):
        kind, now, up = line[0], line[1:], out[y]
        if kind == 0:
            out[y + 1] = now
        elif kind == 1:
            out[y + 1] = np.cumsum(now.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[y + 1] = now + up
        elif kind in (3, 4):
            out[y + 1] = _stepwise(kind, now.tolist(), up.tolist(), step)
        else:
            raise ValueError(f"no such filter: {kind}")
    return out[1:]


def _stepwise(kind: int, now: list[int], up: list[int], step: int) -> np.ndarray:
    """The mean and the nearest-of-three filters, in which every byte rests on the one before."""
    done: list[int] = []
    for i, v in enumerate(now):
        a, c = (done[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 3:
            guess = (a + up[i]) >> 1
        else:
            p = a + up[i] - c
            guess = min((abs(p - a), 0, a), (abs(p - up[i]), 1, up[i]), (abs(p - c), 2, c))[2]
        done.append((v + guess) & 255)
    return np.array(done, dtype=np.uint8)


def encode(pixels: np.ndarray) -> bytes:
    """Grey or RGB bytes as a PNG; the same pixels give the same bytes."""
    height, width = pixels.shape[:2]
    flat = np.ascontiguousarray(pixels, dtype=np.uint8).reshape(height, -1)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), flat], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")
