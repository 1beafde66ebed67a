"""Tokenisation and row helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import inspect
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A-Z become a-z, other bytes stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: As LOWER, and every byte that is neither a letter, a digit nor part of a longer character becomes a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def space_tokens(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def word_tokens(text: str | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(WORDS).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _table() -> np.ndarray:
    """A random number for every byte at each of 64 places in a word (tabulation hashing)."""
    return mix64(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(64, 256)


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def token_hashes(texts: list[str | None], table: bytes = LOWER, limit: int = 2 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens of the texts, one text after another, and how many each text has.

    ``table`` LOWER gives the words of ``space_tokens``, WORDS those of ``word_tokens``.
    """
    out, counts, held, size = [], np.zeros(len(texts), np.int64), [], 0

    def add(stop: int):
        lengths = np.array([len(x) for x in held], np.int64) + 1
        h, n = _hashes(b" ".join([*held, b""]).translate(table), lengths)
        counts[stop - len(held) : stop] = n
        out.append(h)

    for i, t in enumerate(texts):
        held.append(t.encode("utf-8", "surrogatepass") if t else b"")
        size += len(held[-1])
        if size >= limit:
            add(i + 1)
            held, size = [], 0
    if held:
        add(len(texts))
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), counts


def _hashes(raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(raw, np.uint8)
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = np.flatnonzero(start)
    if not len(first):
        return np.empty(0, np.uint64), np.zeros(len(lengths), np.int64)
    place = np.arange(len(data), dtype=np.int32)
    begin = np.where(start, place, np.int32(0))
    place -= np.maximum.accumulate(begin)
    part = _table()[place & 63, data]
    part[~inside] = 0
    long = np.flatnonzero(inside & (place > 63))
    if len(long):
        part[long] *= mix64((place[long] >> 6).astype(np.uint64)) | np.uint64(1)
    ends = np.cumsum(lengths)
    cut = np.searchsorted(first, np.r_[0, ends])
    return np.add.reduceat(part, first), np.diff(cut)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal text of ``doc_id`` modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def only(df: DataFrame, **columns: Column) -> DataFrame:
    """Just the named expressions, so that other columns can't clash with the operator's own."""
    return df.select(*[c.alias(k) for k, c in columns.items()])


def release() -> None:
    """Give freed memory back to the system: workers are kept between tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(f):
    """``f`` over batches or over one group, with ``release`` at its end."""
    if inspect.isgeneratorfunction(f):
        def run(batches):
            yield from f(batches)
            release()
    else:
        def run(group):
            out = f(group)
            release()
            return out

    return run


def pieces(batch: pa.RecordBatch, column: str, limit: int):
    """Row ranges of ``batch`` whose ``column`` holds about ``limit`` bytes at most, one row at least."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(lengths):
        yield start, len(lengths)
