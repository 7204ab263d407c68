"""Helpers of the training-data operators: shared folders, row frames and hashed words.

Words are ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes.  A word's 64-bit hash is a
polynomial over a random byte table, taken for a whole slice of documents at
once from one running sum; two different words collide with a probability of
about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tessera.operators.set_join import mix, small_batches
from tessera.operators.tables import discard, materialize, new_path, shared_dir

__all__ = ["discard", "materialize", "mix", "new_path", "shared_dir", "small_batches"]

#: Bytes of text that are hashed at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has already, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, 2 * SLICE_BYTES)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if size == 2 * SLICE_BYTES:
            _POWERS[base] = known
    return known[:n]


class Words(NamedTuple):
    hashes: np.ndarray  # uint64, a word each
    first: np.ndarray  # documents + 1 positions in hashes
    start: np.ndarray  # byte positions in buf
    end: np.ndarray
    buf: np.ndarray  # bytes, lower-cased if so asked
    offsets: np.ndarray  # documents + 1 byte positions
    run: np.ndarray  # running sum of the polynomial

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of any spans of buf."""
        if not len(start):
            return np.zeros(0, np.uint64)
        inverse = np.append(_powers(_INVERSE, len(self.buf)), np.uint64(0))
        return mix((self.run[end] - self.run[start]) * inverse[start])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows of about limit bytes."""
    data, offs = text_buffer(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


#: Lower case, and white space for ASCII marks.
PLAIN = _LOWER.copy()
PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def hash_words(buf: np.ndarray, offsets: np.ndarray, lower: bool, fold: np.ndarray | None = None) -> Words:
    """Words of a slice; fold maps bytes before (lower: A-Z to a-z)."""
    if lower:
        buf = (_LOWER if fold is None else fold)[buf]
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none, buf, offsets, np.zeros(1, np.uint64))
    space = _SPACE[buf]
    edge = np.zeros(n + 1, bool)  # a document begins or ends at this byte
    edge[offsets] = True
    before = edge[:-1].copy()
    before[1:] |= space[:-1]
    after = edge[1:].copy()
    after[:-1] |= space[1:]
    word = ~space
    start = np.flatnonzero(word & before)
    end = np.flatnonzero(word & after) + 1
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _powers(_BASE, n), out=run[1:])
    hashes = mix((run[end] - run[start]) * _powers(_INVERSE, n)[start])
    return Words(hashes, np.searchsorted(start, offsets), start, end, buf, offsets, run)


def crc32_rest(ids: list, mod: int) -> np.ndarray:
    """crc32 of each id as text, modulo mod; of a null id the empty text's."""
    import zlib

    return np.fromiter((zlib.crc32(b"" if x is None else str(x).encode()) % mod for x in ids), np.int64, len(ids))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
