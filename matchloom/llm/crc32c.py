"""Masked CRC-32C of many byte strings at once, with table look-ups over whole blocks."""

from __future__ import annotations

import functools

import numpy as np

#: Fixed values of the checksum: its reversed polynomial, and the constant its mask adds.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8

BLOCK = 256


def _byte_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(POLYNOMIAL), crc >> 1).astype(np.uint32)
    return crc


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """``at[j]``: what a byte at place j of a block adds to the block's remainder; ``shift``: what each of the four
    bytes of a remainder becomes when a whole block follows."""
    one = _byte_table()
    at = np.empty((BLOCK, 256), np.uint32)
    at[BLOCK - 1] = one
    for j in range(BLOCK - 2, -1, -1):
        at[j] = (at[j + 1] >> np.uint32(8)) ^ one[at[j + 1] & 0xFF]
    # a remainder followed by a block is a message of its four bytes, then zeros
    shift = np.stack([at[k] for k in range(4)])
    return at, shift


def crc32c(items: list[bytes]) -> np.ndarray:
    """CRC-32C of each item. Zeros before a message leave the plain remainder as it is, so items are padded in front to
    whole blocks; the start value is the complement of the first four bytes."""
    at, shift = _tables()
    n = len(items)
    sizes = np.fromiter((len(x) for x in items), np.int64, n)
    blocks = -(-np.maximum(sizes, 4) // BLOCK)
    ends = np.cumsum(blocks)
    flat = np.zeros(int(ends[-1]) * BLOCK if n else 0, np.uint8)
    for x, size, end in zip(items, sizes.tolist(), (ends * BLOCK).tolist(), strict=True):
        flat[end - size:end] = np.frombuffer(x, np.uint8)
        flat[end - size:min(end - size + 4, end)] ^= 0xFF  # of an item under four bytes, only those it has
    rows = flat.reshape(-1, BLOCK)
    part = np.zeros(len(rows), np.uint32)
    for j in range(BLOCK):
        part ^= at[j][rows[:, j]]
    order = np.argsort(-blocks, kind="stable")
    longest = blocks[order]
    crc = np.zeros(n, np.uint32)
    most = int(longest[0]) if n else 0
    for step in range(most):
        # items with at least most - step blocks have begun
        live = order[:np.searchsorted(-longest, -(most - step), side="right")]
        old = crc[live]
        moved = shift[0][old & 0xFF] ^ shift[1][(old >> 8) & 0xFF] ^ shift[2][(old >> 16) & 0xFF] ^ shift[3][old >> 24]
        crc[live] = moved ^ part[ends[live] - most + step]
    # an item under four bytes leaves the rest of the start value, moved by its size
    short = np.flatnonzero(sizes < 4)
    rest = np.uint32(0xFFFFFFFF) >> (8 * sizes[short]).astype(np.uint32)
    crc[short] ^= rest
    return crc ^ np.uint32(0xFFFFFFFF)


def masked(items: list[bytes]) -> np.ndarray:
    """Rotated and shifted, so that a checksum stored inside checksummed data does no harm."""
    crc = crc32c(items)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)
