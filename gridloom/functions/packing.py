"""Byte layouts: scale streams, fixed-size blocks of codes, 16-bit floats and 8-bit blocks."""

from __future__ import annotations

import struct

import numpy as np

from gridloom.functions import rans

SUPERBLOCK, GROUP = 256, 64
# The most levels of each block type, and its bytes for 256 codes.
MOST_LEVELS = {"b4": 15, "b6": 63, "b7": 99}
BLOCK_BYTES = {"b4": 136, "b6": 200, "b7": 264}
SCALE_MODES = {"fp32": 0, "fp16": 1, "ent8": 4}


def block_type(k: int) -> str:
    if k % 2 == 0 or k < 3:
        raise ValueError(f"levels must be odd and at least 3, not {k}")
    for name, most in MOST_LEVELS.items():
        if k <= most:
            return name
    raise ValueError(f"no block type holds {k} levels")


def pack_blocks(digits: np.ndarray, k: int, scales: np.ndarray) -> bytes:
    """Rows of digits (a multiple of 256 columns) and a scale for each 64 as blocks: 4 half floats, then codes."""
    kind, half = block_type(k), (k - 1) // 2
    rows, cols = digits.shape
    if cols % SUPERBLOCK:
        raise ValueError(f"{cols} columns are no multiple of {SUPERBLOCK}")
    codes = (digits.astype(np.int16) - half).reshape(-1, SUPERBLOCK)
    heads = (np.asarray(scales, np.float32).reshape(-1, SUPERBLOCK // GROUP) / np.float32(half)).astype("<f2").view(np.uint8)
    if kind == "b7":
        body = codes.astype(np.int8).view(np.uint8)
    else:
        shifted = (codes + (8 if kind == "b4" else 32)).astype(np.uint8)
        low = shifted & 15
        body = low[:, 0::2] | low[:, 1::2] << 4
        if kind == "b6":
            high = (shifted >> 4).reshape(len(codes), -1, 4)
            body = np.hstack([body, (high << np.array([0, 2, 4, 6], np.uint8)).sum(axis=2).astype(np.uint8)])
    return np.hstack([heads.reshape(len(codes), 8), body]).tobytes()


def unpack_blocks(blob: bytes, rows: int, cols: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, codes, scales of codes) of :func:`pack_blocks`."""
    raw = np.frombuffer(blob, np.uint8).reshape(-1, BLOCK_BYTES[kind])
    scales = raw[:, :8].copy().view("<f2").astype(np.float32)
    body = raw[:, 8:]
    if kind == "b7":
        codes = body.copy().view(np.int8).astype(np.int16)
    else:
        low = body[:, :128]
        codes = np.stack([low & 15, low >> 4], axis=2).reshape(len(raw), SUPERBLOCK).astype(np.int16)
        if kind == "b6":
            high = (body[:, 128:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
            codes += high.reshape(len(raw), SUPERBLOCK).astype(np.int16) << 4
        codes -= 8 if kind == "b4" else 32
    weights = np.repeat(scales, GROUP, axis=1) * codes.astype(np.float32)
    return weights.reshape(rows, cols), codes.reshape(rows, cols), scales.reshape(rows, cols // GROUP)


def pack_eights(values: np.ndarray) -> bytes:
    """Blocks of 32: a half float of max/127, then 8-bit codes rounded half to even."""
    v = np.asarray(values, np.float32).reshape(-1, 32)
    d = np.abs(v).max(axis=1) / np.float32(127)
    codes = np.where(d[:, None] > 0, np.rint(v / np.where(d > 0, d, 1)[:, None]), 0).astype(np.int8)
    return np.hstack([d.astype("<f2").view(np.uint8).reshape(-1, 2), codes.view(np.uint8)]).tobytes()


def unpack_eights(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, 34)
    return (raw[:, :2].copy().view("<f2").astype(np.float32) * raw[:, 2:].copy().view(np.int8).astype(np.float32)).reshape(-1)


def widen_bf16(bits: np.ndarray) -> np.ndarray:
    return (np.asarray(bits, np.uint16).astype(np.uint32) << 16).view(np.float32)


def encode_scales(scales: np.ndarray, mode: str) -> bytes:
    """fp32, fp16, or ent8: 8-bit codes of log2 between two floats, entropy coded with their table."""
    s = np.asarray(scales, np.float32).reshape(-1)
    if mode == "fp32":
        return s.astype("<f4").tobytes()
    if mode == "fp16":
        return s.astype("<f2").tobytes()
    if mode != "ent8":
        raise ValueError(f"unknown scale mode {mode!r}")
    x = np.log2(np.maximum(s.astype(np.float64), 1e-30))
    low, high = float(x.min()), float(x.max())
    high = high if high > low else low + 1e-30
    q = np.clip(np.rint((x - low) / (high - low) * 255.0), 0, 255).astype(np.int64)
    table = rans.Table.of(q, 256, 4096)
    freqs = np.array(table.freqs, "<u2").tobytes()
    return struct.pack("<ffH", low, high, len(freqs)) + freqs + rans.encode(q, table)


def decode_scales(data: bytes, mode: str, n: int) -> np.ndarray:
    if mode in ("fp32", "fp16"):
        return np.frombuffer(data, "<f4" if mode == "fp32" else "<f2", n).astype(np.float32)
    low, high, size = struct.unpack_from("<ffH", data)
    freqs = np.frombuffer(data, "<u2", size // 2, 10)
    q = rans.decode(data[10 + size :], n, rans.Table(tuple(int(f) for f in freqs), 4096))
    return np.exp2(low + q / 255.0 * (high - low)).astype(np.float32)
