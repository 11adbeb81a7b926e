"""Randomly rotated one-bit codes with a correction factor.

A unit vector o is projected on BITS random directions with orthonormal columns;
its code is the signs. With s the code as +-1/sqrt(bits), <s, o> is stored as
the correction. For a query q, <s, q> / <s, o> estimates <o, q> without bias, and
the error is about sqrt(1 - <o, q>^2) * sqrt((1 / <s, o>^2 - 1) / (bits - 1))
times a standard normal number.

The query's projections are rounded to PLANES bits, with a fixed dither a
coordinate so that rounding adds no bias, and kept as packed bit planes. Then
<s, q> is a few ANDs and population counts of 64-bit words, and neither side's
full vector is touched.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

#: Bits of a rounded projection.
PLANES = 4
#: What an embedding must be to take part.
SANE = "embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = float('inf')) and exists(embedding, x -> x <> 0)"


def bits_for(dim: int, factor: int = 2) -> int:
    return 64 * max(1, -(-factor * dim // 64))


@functools.lru_cache(maxsize=8)
def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """bits x dim, orthonormal columns, uniform among such matrices."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(unit: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Signs (n x bits) and corrections of unit vectors."""
    y = unit @ rotation(unit.shape[1], bits, seed).T
    return y > 0, np.abs(y).sum(axis=1) / np.sqrt(np.float32(bits))


def turned(unit: np.ndarray, bits: int, seed: int) -> np.ndarray:
    return unit @ rotation(unit.shape[1], bits, seed).T


@functools.lru_cache(maxsize=8)
def _dither(bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed + 101).random(bits).astype(np.float32)


def planes(y: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bit planes (n x PLANES * bits / 8 bytes) of projections, their offset and step."""
    low = y.min(axis=1)
    step = np.maximum(y.max(axis=1) - low, 1e-12) / (2**PLANES - 1)
    u = np.clip(np.floor((y - low[:, None]) / step[:, None] + _dither(y.shape[1], seed)), 0, 2**PLANES - 1).astype(np.uint8)
    cut = (u[:, None, :] >> np.arange(PLANES, dtype=np.uint8)[None, :, None]) & 1
    return np.packbits(cut, axis=2).reshape(len(y), -1), low.astype(np.float32), step.astype(np.float32)


def inner(code: np.ndarray, fix: np.ndarray, plane: np.ndarray, low: np.ndarray, step: np.ndarray, bits: int, each: bool = False) -> np.ndarray:
    """Estimated inner products from packed bytes: queries x codes, or row by row if each."""
    words = bits // 64
    c = np.ascontiguousarray(code).view(np.uint64)
    q = np.ascontiguousarray(plane).view(np.uint64).reshape(len(plane), PLANES, words)
    scale = 2 ** np.arange(PLANES, dtype=np.float32)
    ups = np.bitwise_count(q).sum(axis=2).astype(np.float32) @ scale
    own = np.bitwise_count(c).sum(axis=1).astype(np.float32)
    # <s, q> = (2 * (step * shared + low * own) - (low * bits + step * ups)) / sqrt(bits), over fix
    per = 1 / (np.float32(np.sqrt(bits)) * fix)
    a, base = 2 * step, -(low * bits + step * ups)
    if each:
        shared = np.bitwise_count(q & c[:, None, :]).sum(axis=2).astype(np.float32) @ scale
        return (a * shared + 2 * low * own + base) * per
    out = np.empty((len(q), len(c)), np.float32)
    codes = [np.ascontiguousarray(c[:, w]) for w in range(words)]
    kind = np.uint16 if bits * (2**PLANES - 1) < 1 << 16 else np.uint32
    for i in range(0, len(q), 8):  # in blocks that stay in the cache
        for k in range(0, len(c), 4096):
            part = out[i : i + 8, k : k + 4096]
            x, y, total = np.empty(part.shape, np.uint64), np.empty(part.shape, np.uint8), np.zeros(part.shape, kind)
            for j in range(PLANES - 1, -1, -1):
                np.left_shift(total, 1, out=total)
                for w in range(words):
                    np.bitwise_and(q[i : i + 8, j, w, None], codes[w][None, k : k + 4096], out=x)
                    np.bitwise_count(x, out=y)
                    np.add(total, y, out=total)
            np.multiply(total, a[i : i + 8, None], out=part)
            part += (2 * low)[i : i + 8, None] * own[k : k + 4096]
            part += base[i : i + 8, None]
            part *= per[k : k + 4096]
    return out


def slack(fix: np.ndarray, step: np.ndarray, at: np.ndarray | float, bits: int) -> np.ndarray:
    """Standard error of an estimate whose true value is ``at``, rounding included."""
    return np.sqrt(np.maximum(1 - np.square(at), 1e-6) * spread(fix, bits) ** 2 + np.square(step) / 4 / np.maximum(fix, 1e-6) ** 2)


def signs(packed: np.ndarray, bits: int) -> np.ndarray:
    """+-1/sqrt(bits) from packed bits."""
    return (np.unpackbits(packed, axis=1)[:, :bits].astype(np.float32) * 2 - 1) / np.sqrt(np.float32(bits))


def spread(correction: np.ndarray, bits: int) -> np.ndarray:
    """Standard error of the estimate for orthogonal vectors."""
    return np.sqrt(np.maximum(1 / np.maximum(correction, 1e-6) ** 2 - 1, 0) / (bits - 1))


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and unit vectors for each dimension; null, empty, zero and non-finite vectors are left out."""
    size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    start = np.cumsum(size) - size
    out = []
    for d in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == d)
        x = flat[start[rows][:, None] + np.arange(d)].astype(np.float64)
        with np.errstate(all="ignore"):
            norm = np.linalg.norm(x, axis=1)
            ok = np.isfinite(norm) & (norm > 0)
        out.append((rows[ok], (x[ok] / norm[ok, None]).astype(np.float32)))
    return out


def bytes_column(rows: np.ndarray) -> pa.Array:
    """Fixed-width rows of bytes as binary values."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def from_bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)
