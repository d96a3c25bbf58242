"""Vectorised text kernels over Arrow string columns.

Words are found and hashed for a whole slice of documents at once: a word's hash is a polynomial in
its bytes (a difference of prefix sums, scaled back by an inverse power), then mixed.  Nothing here
loops over characters or words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_pow = np.ones(1, dtype=U64)
_inv = np.ones(1, dtype=U64)


def _powers(n: int) -> None:
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, 1 << 20)
        _pow = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, _P, U64)]))
        _inv = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, _PINV, U64)]))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@dataclass
class Tokens:
    """Words of some documents: hashes, byte spans in `data`, and each document's range of words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # len(documents) + 1
    data: np.ndarray

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about `most` bytes: first row, end row, bytes, offsets from 0."""
    data, offsets = buffers(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def tokenize(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Tokens:
    """Words are the longest runs of bytes that are `inside` once A-Z is lower-cased."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Tokens(none.astype(U64), none, none, np.zeros(len(offsets), np.int64), data)
    low = LOWER[data]
    word = inside[low]
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    _powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum((low.astype(U64) + U64(1)) * _pow[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _inv[starts])
    return Tokens(hashes, starts, ends, np.searchsorted(starts, offsets), low)


_ODD = [U64(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2127599BF4325C37, 0x880355F21E6D1965, 0x9FB21C651E98DF25)]


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place; the last k-1 places are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, U64(k))
    for j in range(k):
        out = (out ^ (hashes[j : j + n] * _ODD[j % 10])) * _ODD[(j + 3) % 10]
        out ^= out >> U64(29)
    return mix(out)


def shingle_sets(tokens: Tokens, k: int = 5) -> list[np.ndarray]:
    """Per document: its distinct k-word shingles, sorted; a shorter text is one shingle."""
    whole, out = runs(tokens.hashes, k), []
    for a, b in zip(tokens.bounds[:-1].tolist(), tokens.bounds[1:].tolist()):
        if b - a >= k:
            x = np.sort(whole[a : b - k + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        else:
            out.append(runs(tokens.hashes[a:b], b - a) if b > a else np.zeros(0, U64))
    return out


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with the first number behind it that makes it unlike the columns."""
    taken = {c.lower() for c in columns}
    return [next(x for x in (n, *(f"{n}_{k}" for k in range(1, len(taken) + 2))) if x.lower() not in taken) for n in names]


def groups(batches, key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by `key`; a table may hold many groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        column = batch.column(batch.schema.get_field_index(key))
        last = column[len(column) - 1]
        first = pc.index(column, last).as_py()
        if first == 0 and held[0].column(held[0].schema.get_field_index(key))[0] == last:
            continue
        held[-1] = batch.slice(0, first)
        yield pa.Table.from_batches(held)
        held = [batch.slice(first)]
    if held:
        yield pa.Table.from_batches(held)


def edges(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans; equal spans have equal hashes wherever they lie."""
    if not len(starts):
        return np.zeros(0, U64)
    _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * _pow[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * _inv[starts])
