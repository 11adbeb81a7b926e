"""Operator 4, byte-level BPE: encoding in padded numpy matrices, and decoding.

A text is cut by the tokenizer's pattern; each distinct piece is encoded once a
task. Pieces of similar length share a padded matrix of token ids beside a
matrix of the ranks of neighbouring pairs. In a round every row merges its
leftmost pair of minimum rank, looks up the two pairs that this makes in a hash
table and closes the gap; rows without a mergeable pair leave. The rounds of a
row cost the square of its width, so pieces longer than the widest matrix, which
are rare, make the same merges from a heap in n log n instead.

The vocabulary is a file of base64 tokens and ranks; its path is a parameter and
every worker must be able to read it.

Defined results: a null text has null tokens and a null count, an empty text no
tokens; texts are encoded whole however long; an empty table stays empty; rows
are kept as they are, in any number, with their other columns, except that columns named like a result are replaced.
Decoding replaces ids outside the vocabulary, and bytes that are no UTF-8, by
U+FFFD; null tokens decode to null.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retexa.llm import textkit as K

U = np.uint64
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128, 256, 512, 1024)
#: Matrix cells at once, bytes of text at once, and distinct pieces that a task remembers.
CELLS, BLOCK, REMEMBERED = 1 << 18, 1 << 19, 100_000
NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Ranks, the pair table and the bytes of each token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.digest = hashlib.sha256(raw + PATTERN.encode()).hexdigest()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        a, b, r = array("q"), array("q"), array("i")
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    a.append(left), b.append(right), r.append(rank)
        a, b, r = np.array(a, np.int64), np.array(b, np.int64), np.array(r, np.int32)
        self._table(a, b, r)
        size = max(ranks.values(), default=-1) + 1
        own = [b""] * (size + 1)
        for token, rank in ranks.items():
            own[rank] = token
        self.known = np.array([bool(x) for x in own])
        own = [x or "�".encode() for x in own]
        self.length = np.array([len(x) for x in own], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(own), np.uint8)

    @property
    def ranks(self) -> dict[bytes, int]:
        """Token and rank, made anew: a worker needs only the table."""
        return {self.bytes[self.start[i] : self.start[i] + self.length[i]].tobytes(): int(i) for i in np.flatnonzero(self.known)}

    def _table(self, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> None:
        """Open addressing with linear probing, at most a quarter full."""
        self.bits = max(4, int(4 * max(len(a), 1) - 1).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size + 64, -1, np.int64), np.full(size + 64, NONE, np.int32)
        key = (a << 32) | b
        at, todo, self.probes = self._hash(key), np.arange(len(key)), 0
        while len(todo):
            self.probes += 1
            free = self.keys[at[todo]] < 0
            self.keys[at[todo[free]]] = key[todo[free]]
            won = self.keys[at[todo]] == key[todo]
            self.values[at[todo[won]]] = rank[todo[won]]
            todo = todo[~won]
            at[todo] += 1

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(U) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merged pair, NONE where there is none; negative ids are padding."""
        key = (a.astype(np.int64) << 32) | b
        flat = key.ravel()
        at = self._hash(flat)
        out = np.where(self.keys[at] == flat, self.values[at], NONE)
        open_ = np.flatnonzero((self.keys[at] != flat) & (self.keys[at] >= 0))
        while len(open_):
            at[open_] += 1
            seen = self.keys[at[open_]]
            hit = seen == flat[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        out = out.reshape(key.shape)
        out[(a < 0) | (b < 0)] = NONE
        return out

    def matrix(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts for pieces of at most width bytes."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        done, count = np.full((n, width), -1, np.int32), size.copy()
        row = np.arange(n)
        rank = self.pair(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((n, 1), NONE)
        while len(row):
            best = rank.argmin(axis=1)
            each = np.arange(len(row))
            low = rank[each, best]
            live = low < NONE
            if not live.all():
                out = ~live
                done[row[out], : ids.shape[1]] = ids[out]
                row, ids, rank, best, low = row[live], ids[live], rank[live], best[live], low[live]
                each = np.arange(len(row))
            if not len(row):
                break
            count[row] -= 1
            ids[each, best] = low
            if ids.shape[1] == 2:
                done[row, 0] = ids[:, 0]
                break
            # every live row loses one column: shift what lies right of the merged pair
            cols = np.arange(ids.shape[1] - 1)
            right = cols > best[:, None]
            ids = np.where(right, ids[:, 1:], ids[:, :-1])
            rank = np.where(right[:, :-1], rank[:, 1:], rank[:, :-1])
            left = np.flatnonzero(best > 0)
            rank[left, best[left] - 1] = self.pair(ids[left, best[left] - 1], ids[left, best[left]])
            inner = np.flatnonzero(best < ids.shape[1] - 1)
            rank[inner, best[inner]] = self.pair(ids[inner, best[inner]], ids[inner, best[inner] + 1])
        return done[np.arange(width) < count[:, None]], count

    def long(self, piece: bytes) -> list[int]:
        """The same merges with a heap and a linked list."""
        ids = [int(x) for x in self.byte[np.frombuffer(piece, np.uint8)]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        a = np.array(ids, np.int32)
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(self.pair(a[:-1], a[1:])) if r < NONE]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            key = (ids[i] << 32) | ids[j]
            at = ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - self.bits)
            while (seen := self.keys[at]) >= 0:
                if seen == key:
                    heapq.heappush(heap, (int(self.values[at]), i, ids[i], ids[j]))
                    return
                at += 1

        while heap:
            rank, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                push(i, after[j])
            if before[i] >= 0:
                push(before[i], i)
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts in the order of the pieces."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        count, parts, at = np.zeros(len(pieces), np.int64), [], []
        bucket = np.searchsorted(WIDTHS, size)
        for k, width in enumerate(WIDTHS):
            own = np.flatnonzero((bucket == k) & (size > 0))
            step = max(1, CELLS // width)
            for lo in range(0, len(own), step):
                some = own[lo : lo + step]
                flat, n = self.matrix([pieces[i] for i in some], width)
                parts.append(flat), at.append(some)
                count[some] = n
        for i in np.flatnonzero(bucket == len(WIDTHS)):
            flat = np.array(self.long(pieces[i]), np.int32)
            parts.append(flat), at.append(np.array([i]))
            count[i] = len(flat)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        order = np.concatenate(at) if at else np.zeros(0, np.int64)
        if len(order) and (np.diff(order) < 0).any():
            start = np.zeros(len(pieces), np.int64)
            start[order] = np.cumsum(count[order]) - count[order]
            flat = flat[spread(start, count)]
        return flat, count


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start + count."""
    stop = np.cumsum(count)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - count), count)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder(dict):
    """Piece -> place among the pieces seen, encoded in bulk; forgets when full."""

    def __init__(self, path: str):
        super().__init__()
        self.vocabulary = vocabulary(path)
        self.cut = regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.flat, self.count, self.start = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, piece: str) -> int:
        place = self[piece] = len(self)
        self.new.append(piece)
        return place

    def _places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Place of every piece, and the bounds of each text's pieces."""
        if len(self) > REMEMBERED:
            self.forget()
        pieces, bounds = [], np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            if text:
                pieces += self.cut(text)
            bounds[i + 1] = len(pieces)
        place = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        if self.new:
            flat, count = self.vocabulary.encode_pieces([x.encode() for x in self.new])
            self.flat = np.concatenate([self.flat, flat])
            self.count = np.concatenate([self.count, count])
            self.start = np.cumsum(self.count) - self.count
            self.new = []
        return place, bounds

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of each text's tokens."""
        place, bounds = self._places(texts)
        count = self.count[place]
        return self.flat[spread(self.start[place], count)], np.diff(np.concatenate([[0], np.cumsum(count)])[bounds])

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """The number of each text's tokens."""
        place, bounds = self._places(texts)
        return np.diff(np.concatenate([[0], np.cumsum(self.count[place])])[bounds])


def decode_flat(vocab: Vocabulary, flat: np.ndarray, count: np.ndarray) -> pa.Array:
    """Large strings, one a row."""
    ids = np.where((flat >= 0) & (flat < len(vocab.length) - 1), flat, len(vocab.length) - 1)
    size = vocab.length[ids]
    data = vocab.bytes[spread(vocab.start[ids], size)]
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
    raw = pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    try:
        return raw.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([x.decode(errors="replace") for x in raw.to_pylist()], pa.large_string())


def token_list(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and counts of a list column; nulls in it count as ids outside the vocabulary."""
    count = np.nan_to_num(batch.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return batch.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), count


def _chunks(column: pa.Array) -> Iterator[tuple[int, int]]:
    return K.blocks(K.text_column(column), BLOCK)


TOKENS = T.StructField("tokens", T.ArrayType(T.IntegerType()))
COUNT = T.StructField("n_tokens", T.LongType())
EXACT = T.StructField("round_trip", T.BooleanType())


def encode(docs: DataFrame, path: str = VOCABULARY, text: str = "text", check: bool = False) -> DataFrame:
    """docs with tokens and n_tokens; with check also round_trip, whether decoding
    the tokens gives the text again. One pass, no shuffle."""
    K.small_batches(docs.sparkSession)
    new = [TOKENS, COUNT, EXACT] if check else [TOKENS, COUNT]
    schema = K.extended(docs.schema, *new)
    kept = [f.name for f in schema.fields[: -len(new)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path)
        for batch in batches:
            for i, j in _chunks(batch[text]):
                part = batch.slice(i, j - i)
                words = part[text]
                flat, count = coder.encode(words.to_pylist())
                offs = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                null = words.is_null().to_numpy(zero_copy_only=False)
                tokens = pa.ListArray.from_arrays(pa.array(offs), pa.array(flat), mask=pa.array(null))
                cols = [tokens, pa.array(count, mask=null)]
                if check:
                    again = decode_flat(coder.vocabulary, flat, count)
                    cols.append(pc.equal(again, words.cast(pa.large_string())))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), *cols], [*kept, *(f.name for f in new)])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str = VOCABULARY, tokens: str = "tokens") -> DataFrame:
    """docs with decoded, the text of the tokens."""
    K.small_batches(docs.sparkSession)
    schema = K.extended(docs.schema, T.StructField("decoded", T.StringType()))
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                null = part[tokens].is_null().to_numpy(zero_copy_only=False)
                out = decode_flat(vocab, *token_list(part[tokens]))
                out = pc.if_else(pa.array(null), pa.scalar(None, pa.large_string()), out)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), out.cast(pa.string())], [*kept, "decoded"])

    return docs.withColumn(tokens, F.col(tokens).cast("array<int>")).mapInArrow(run, schema)
