"""Whole Arrow batches of texts as numpy arrays: word spans, 64-bit hashes, windows of words.

All word classes used here are unions of single bytes (every non-ASCII character consists of bytes
from 0x80 on), so words can be cut on UTF-8 bytes without decoding.  Equality of words, lines and
windows is equality of 64-bit hashes; two different ones meet with a chance of 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 19


def _stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUE = _stream(256, 7)
BASE = 0x5851F42D4C957F2D
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between blanks: all bytes but 0x20 and 0x09-0x0D.
NONBLANK = np.ones(256, bool)
NONBLANK[[32, 9, 10, 11, 12, 13]] = False
#: Words of digits, lower-case letters and non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = n + n // 16
        out = np.ones(size, U)
        done, step = 1, base
        while done < size:  # doubling: what follows is the part before times base**done
            out[done:2 * done] = out[:size - done][:done] * U(step)
            done, step = 2 * done, step * step % 2**64
        have = _powers[base] = out
    return have[:n]


def plain_strings(column: pa.Array) -> pa.Array:
    """A string array without nulls (null becomes the empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "") if column.null_count else column


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, offsets) for runs of rows with about ``limit`` bytes, one row at least."""
    column = plain_strings(column)
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


@dataclass
class Words:
    """Words of several documents; ``data`` has one newline behind each document."""

    data: np.ndarray
    bounds: np.ndarray  # document d is data[bounds[d]:bounds[d + 1] - 1]
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    count: np.ndarray  # words of each document
    first: np.ndarray  # number of its first word
    hash: np.ndarray
    prefix: np.ndarray | None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans of ``data``."""
        inverse = _power_table(pow(BASE, -1, 2**64), len(self.data) + 1)
        return mix((self.prefix[end] - self.prefix[start]) * inverse[start] + (end - start).astype(U))


def words_of(data: np.ndarray, offs: np.ndarray, kind: np.ndarray, lower: bool, hashes: bool = True) -> Words:
    """Cut the documents of one slice into words; without ``hashes`` these stay empty."""
    docs = len(offs) - 1
    lens = np.diff(offs)
    text = np.full(len(data) + docs, 10, np.uint8)
    text[np.arange(len(data)) + np.repeat(np.arange(docs), lens)] = LOWER[data] if lower else data
    bounds = offs + np.arange(docs + 1)
    edge = np.flatnonzero(np.diff(kind[text].view(np.int8), prepend=np.int8(0)))
    start, end = edge[0::2], edge[1::2]
    first = np.searchsorted(start, bounds)
    count = np.diff(first)
    if not hashes:
        return Words(text, bounds, start, end, np.repeat(np.arange(docs), count), count, first[:-1], np.zeros(0, U), None)
    values = BYTE_VALUE[text]
    values *= _power_table(BASE, len(text))
    prefix = np.zeros(len(text) + 1, U)
    np.cumsum(values, out=prefix[1:])
    out = Words(text, bounds, start, end, np.repeat(np.arange(docs), count), count, first[:-1], np.zeros(0, U), prefix)
    out.hash = out.span_hash(start, end)
    return out


def window_hash(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of k words that begin at the words ``at``."""
    acc = np.full(len(at), k, U)
    for j in range(k):
        acc = (acc ^ (acc >> U(29))) * U(0x9E3779B97F4A7C15) + hashes[at + j]
    return mix(acc)


def windows(w: Words, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(number of the first word, hash) of all k-word windows; with ``short``, fewer words are one window of their own."""
    at = np.arange(max(0, len(w.start) - k + 1))
    at = at[w.doc[at] == w.doc[at + k - 1]] if len(at) else at
    starts, out = [at], [window_hash(w.hash, at, k)]
    if short:
        for n in range(1, k):
            a = w.first[w.count == n]
            if len(a):
                starts.append(a)
                out.append(window_hash(w.hash, a, n))
    return np.concatenate(starts), np.concatenate(out)


def by_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of 0/1 or small integers over [bounds[d], bounds[d + 1])."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array)
                                       else columns[f.name].cast(f.type) for f in schema], schema=schema)
