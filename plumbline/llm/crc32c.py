"""Masked CRC-32C of many byte strings at once, in numpy."""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0x82F63B78
MASK = 0xA282EAD8  # added after rotating by 15 bits, so that a checksum of data holding checksums stays useful
LANE = 64


def _words() -> np.ndarray:
    """The effect of two bytes on an empty register."""
    crc = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(POLYNOMIAL), crc >> 1)
    return crc


WORDS = _words()


def _shift_tables(n_bytes: int) -> list[np.ndarray]:
    """Four tables that together carry a register over ``n_bytes`` zero bytes."""
    tables = []
    for byte in range(4):
        crc = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
        for _ in range(n_bytes // 2):
            crc = WORDS[crc & 0xFFFF] ^ (crc >> np.uint32(16))
        tables.append(crc)
    return tables


SHIFT = _shift_tables(LANE)


def crc32c(records: list[bytes]) -> np.ndarray:
    """CRC-32C of each record of at least 4 bytes.

    A register that starts at zero ignores leading zeros, so records are padded in front to whole lanes of 64 bytes (the
    usual start value goes into the first 4 bytes). All lanes advance together, then each record's lanes are folded.
    """
    if not records:
        return np.zeros(0, np.uint32)
    sizes = np.array([len(r) for r in records])
    if sizes.min() < 4:
        raise ValueError("records of under 4 bytes")
    order = np.argsort(-sizes, kind="stable")
    lanes = -(-sizes // LANE)
    ends = np.cumsum(lanes) * LANE
    flat = np.zeros(int(ends[-1]), np.uint8)
    flat_bytes = memoryview(flat)
    for r, size, end in zip(records, sizes.tolist(), ends.tolist()):
        flat_bytes[end - size : end] = r
    heads = (ends - sizes)[:, None] + np.arange(4)
    flat[heads] ^= 0xFF
    words = flat.view("<u2").reshape(-1, LANE // 2).T
    crc = np.zeros(words.shape[1], np.uint32)
    for w in words:
        crc = WORDS[(crc & 0xFFFF) ^ w] ^ (crc >> np.uint32(16))
    first = (ends // LANE - lanes)[order]
    n = lanes[order]
    out = np.zeros(len(records), np.uint32)
    for i in range(int(n[0])):
        k = int(np.searchsorted(-n, -i, side="left"))  # records with more than i lanes come first
        x = out[:k]
        out[:k] = SHIFT[0][x & 255] ^ SHIFT[1][(x >> 8) & 255] ^ SHIFT[2][(x >> 16) & 255] ^ SHIFT[3][x >> 24] ^ crc[first[:k] + i]
    result = np.empty_like(out)
    result[order] = out ^ np.uint32(0xFFFFFFFF)
    return result


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)
