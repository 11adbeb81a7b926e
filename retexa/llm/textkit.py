"""Whole-batch text routines on Arrow buffers: no Python object per word.

Texts arrive as one byte buffer with row offsets. Words are runs of ASCII
letters and digits and of all bytes above 127; anything else separates. A span
is hashed in constant time from prefix sums of a polynomial in 2^64, so every
function here is a fixed number of numpy passes over the bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = [np.ones(0, U), np.ones(0, U)]
#: Bytes of a block of texts; longer texts are a block each. Powers kept between blocks at most.
BLOCK, KEPT, BATCH = (1 << 18) - 1, 1 << 20, 1000
# the default pool keeps what batches once took; a worker is to hold what its block needs
pa.set_memory_pool(pa.system_memory_pool())

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
KIND = np.where(WORD, 1, 2).astype(np.uint8)
KIND[[*range(0, 33), 127]] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); wraps silently."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_column(col: pa.Array, lower: bool = False) -> pa.Array:
    """Large strings without nulls; a null counts as the empty text."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    return pc.utf8_lower(col) if lower else col


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the len + 1 offsets of a large-string array."""
    raw = col.buffers()
    offs = np.frombuffer(raw[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def blocks(col: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes each, so that memory doesn't follow the batch."""
    _, offs = buffers(col)
    i, n = 0, len(col)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _power(n: int, which: int) -> np.ndarray:
    """At least n powers of the base, or of its inverse."""
    if len(_powers[which]) >= n:
        return _powers[which]
    p = np.full(1 << max(18, int(n - 1).bit_length()), (_BASE, _INVERSE)[which], U)
    p[0] = 1
    np.multiply.accumulate(p, out=p)
    if len(p) <= KEPT:
        _powers[which] = p
    return p


def prefix_sums(b: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(b) + 1, U)
    np.cumsum((b.astype(U) + U(1)) * _power(len(b), 0)[: len(b)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _power(len(sums), 1)[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def _owner(offs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.searchsorted(offs, starts, "right") - 1


def words(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each word."""
    return _runs(WORD[b].view(np.uint8), offs)


def pieces(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each run of word bytes and each run of punctuation."""
    return _runs(KIND[b], offs)


def _runs(kind: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(kind)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.ones(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offs] = True
    at = np.flatnonzero(edge)
    keep = kind[at[:-1]] > 0
    starts = at[:-1][keep]
    return starts, at[1:][keep], _owner(offs, starts)


def row_hash(b: np.ndarray, offs: np.ndarray, salt: int = 0) -> np.ndarray:
    return mix(span_hash(prefix_sums(b), offs[:-1], offs[1:]) ^ U(salt))


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) fixed by key and salt."""
    return ((mix(key.astype(np.int64).view(U) ^ mix(np.array([salt], np.int64).view(U))) >> U(11)).astype(np.float64) + 0.5) / 2.0**53


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of texts hold at most BATCH rows, where the session hasn't set its own number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH))


def set_aside(docs: DataFrame, taken: Callable[[str], bool]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with the columns whose names are taken renamed, and what brings its columns back."""
    names = {c: f"_own_{i}_{c}" for i, c in enumerate(docs.columns) if taken(c.lower())}
    return docs.withColumnsRenamed(names), lambda out: out.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def extended(schema: T.StructType, *new: T.StructField) -> T.StructType:
    """schema without the fields that new ones replace, then the new ones."""
    names = {f.name.lower() for f in new}
    return T.StructType([*(f for f in schema.fields if f.name.lower() not in names), *new])
