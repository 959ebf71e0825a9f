"""CRC-32 of ranges from those of prefixes: a checksum moves on over n bytes by a linear map."""

from __future__ import annotations

from functools import cache

import numpy as np


@cache
def _moves() -> np.ndarray:
    """[k, byte, value]: what each byte of a checksum becomes behind 2**k zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1))
    at = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    out = [(at >> np.uint32(8)) ^ step[at & np.uint32(255)]]
    for _ in range(31):
        out.append(_apply(out[-1], out[-1]))
    return np.stack(out)


def _apply(t: np.ndarray, crc: np.ndarray) -> np.ndarray:
    byte = np.uint32(255)
    return t[0][crc & byte] ^ t[1][crc >> np.uint32(8) & byte] ^ t[2][crc >> np.uint32(16) & byte] ^ t[3][crc >> np.uint32(24)]


def moved(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums behind so many (below 2**32) zero bytes."""
    crc, length = crc.astype(np.uint32), np.asarray(length, np.int64)
    for k in range(int(length.max(initial=0)).bit_length()):
        crc = np.where(length >> k & 1, _apply(_moves()[k], crc), crc)
    return crc


def of_range(upto_start: np.ndarray, upto_end: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The checksum of a range of bytes from those of the prefixes that end before it and with it, and its length."""
    return moved(upto_start, length) ^ upto_end.astype(np.uint32)
