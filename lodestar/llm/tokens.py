"""Vectorised word tokens over Arrow text columns.

A word is a maximal run of letters and digits after lower-casing; every byte of
a non-ASCII character counts as part of a word, but for the blocks of no-break
and general punctuation (U+00A0-00BF, U+2000-206F, U+3000-303F), which separate
words like ASCII punctuation and white space do.  Each word is hashed to 64 bits
by prefix sums of a polynomial over its bytes, computed for a whole slice of rows
at once, so no Python object is made per word.

A null text gives no words, like an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; bounds the memory of a Python
#: worker whatever the size of Spark's Arrow batches.  A longer single text is
#: still taken whole.
SLICE_BYTES = 1 << 20

_SPLITMIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _multipliers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64)) * _SPLITMIX) | np.uint64(1)


_MULT = _multipliers(1 << 12)


def multipliers(n: int) -> np.ndarray:
    """At least n odd 64-bit multipliers, the same in every process."""
    global _MULT
    if n > len(_MULT):
        _MULT = _multipliers(max(n, 2 * len(_MULT)))
    return _MULT


def _word_bytes() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[ord("0") : ord("9") + 1] = True
    table[ord("a") : ord("z") + 1] = True
    table[ord("A") : ord("Z") + 1] = True
    table[0x80:] = True
    return table


_IS_WORD = _word_bytes()


@dataclass
class Words:
    """Words of consecutive rows: row i has words offsets[i]:offsets[i + 1].

    start and end are byte positions in data, the rows' lower-cased UTF-8 bytes;
    row_start holds where each row's bytes begin.  Lower-casing keeps the number
    of characters, so character positions hold for the original text as well.
    """

    hashes: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    row_start: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without nulls, offsets from 0."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column = column.cast(pa.string())
        kind = np.int32
    n = len(column)
    if n == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=kind, count=n + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return offsets - offsets[0], raw


def _separate_unicode_punctuation(raw: np.ndarray, word: np.ndarray) -> None:
    lead = np.flatnonzero((raw == 0xC2) | (raw == 0xE2) | (raw == 0xE3))
    if not len(lead):
        return
    n = len(raw)
    first, second = raw[lead], raw[np.minimum(lead + 1, n - 1)]
    two = lead[(first == 0xC2) & (second >= 0xA0) & (second <= 0xBF)]
    three = lead[((first == 0xE2) & ((second == 0x80) | ((second == 0x81) & (raw[np.minimum(lead + 2, n - 1)] <= 0xAF)))) | ((first == 0xE3) & (second == 0x80))]
    for at, length in ((two, 2), (three, 3)):
        for k in range(length):
            word[np.minimum(at + k, n - 1)] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base ** i, base ** -i) modulo 2 ** 64 for i < n; the base is odd, so it has an inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.ones(n, dtype=np.uint64)
        filled = 1
        while filled < n:
            take = min(filled, n - filled)
            p[filled : filled + take] = p[:take] * np.uint64(pow(base, filled, 1 << 64))
            filled += take
        out.append(p)
    return out[0], out[1]


_BASE = 0x5851F42D4C957F2D
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWER = _powers(1 << 16)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWER
    if n > len(_POWER[0]):
        _POWER = _powers(1 << (n - 1).bit_length())
    return _POWER


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * base ** i modulo 2 ** 64 over every prefix, the empty one first."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def cut_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the stretches [start, end), wherever they lie, from prefix sums."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def spans_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    if len(start) == 0:
        return np.zeros(0, dtype=np.uint64)
    prefix = prefix_hash(_LETTER[raw])
    return mix64(cut_hash(prefix, start, end) + (end - start).astype(np.uint64) * _SPLITMIX)


def words_of(column: pa.Array) -> Words:
    """The words of a string column; see the module's docstring."""
    column = pc.utf8_lower(column.fill_null(""))
    row, raw = string_buffers(column)
    n = len(raw)
    word = _IS_WORD[raw]
    if n and raw.max() >= 0xC2:
        _separate_unicode_punctuation(raw, word)
    before = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = word[:-1]
        before[row[:-1][row[:-1] < n]] = False
    start = np.flatnonzero(word & ~before)
    last = np.empty(n, dtype=bool)
    if n:
        last[-1] = True
        last[:-1] = ~word[1:]
        ends = row[1:] - 1
        last[ends[ends >= 0]] = True
    end = np.flatnonzero(word & last) + 1
    offsets = np.searchsorted(start, row)
    return Words(spans_hash(raw, start, end), offsets, start, end, raw, row)


def slices(batch: pa.RecordBatch, text: int | str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about limit bytes of text, of one row at least."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    bucket = np.cumsum(sizes) // max(1, limit)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    begin = 0
    for stop in [*cuts.tolist(), n]:
        if stop > begin:
            yield batch.slice(begin, stop - begin)
            begin = stop


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every width consecutive items, len - width + 1 of them.

    Rows must be cut apart by the caller: a window may straddle two rows.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n] * multipliers(width)[0]
        for k in range(1, width):
            out += hashes[k : k + n] * multipliers(width)[k]
    return mix64(out)


def windows(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, rows) of all windows of that width that lie within one row."""
    count = np.maximum(np.diff(offsets) - width + 1, 0)
    total = int(count.sum())
    rows = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    return np.arange(total) - np.repeat(first, count) + offsets[:-1][rows], rows


def order_in_rows(row: np.ndarray, hashes: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
    """The order by (row, rank, hash); row ascends already, rank is below 2 ** 12.

    Sorts one packed integer a value.  Where the packing can't tell two hashes
    apart, or rows are too many for it, it sorts by the full columns instead.
    """
    if len(row) and row[-1] < 1 << 20:
        key = row.astype(np.uint64) << np.uint64(44)
        if rank is None:
            key |= hashes >> np.uint64(20)
        else:
            key |= (rank.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32))
        order = np.argsort(key, kind="stable")
        key, value = key[order], hashes[order]
        if not ((key[1:] == key[:-1]) & (value[1:] != value[:-1])).any():
            return order
    return np.lexsort((hashes, row) if rank is None else (hashes, rank, row))


def distinct_in_rows(row: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, sorted within each row; their rows; offsets of the rows)."""
    order = order_in_rows(row, hashes)
    hashes, row = hashes[order], row[order]
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[first], row[first]
    return hashes, row, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])


#: Values that are looked up at once when rows are compared.
LOOKUPS = 1 << 20


def common(values: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values rows a and b have in common, pair by pair; values are distinct and sorted within each row."""
    out = np.zeros(len(a), dtype=np.int64)
    if not len(a) or not len(values):
        return out
    size = np.diff(offsets)
    kinds, name = np.unique(values, return_inverse=True)
    span = np.int64(len(kinds))
    place = np.repeat(np.arange(len(size)), size) * span + name
    edge = np.cumsum(size[a])
    at = 0
    while at < len(a):
        # as many pairs as make about LOOKUPS look-ups, one at least
        stop = max(at + 1, int(np.searchsorted(edge, (edge[at - 1] if at else 0) + LOOKUPS, side="right")))
        count = size[a[at:stop]]
        end = np.cumsum(count)
        look = np.repeat(offsets[a[at:stop]] - (end - count), count) + np.arange(end[-1])
        wanted = np.repeat(b[at:stop], count) * span + name[look]
        found = np.searchsorted(place, wanted)
        hits = np.concatenate([[0], np.cumsum(place[np.minimum(found, len(place) - 1)] == wanted)])
        out[at:stop] = hits[end] - hits[end - count]
        at = stop
    return out


def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, after which the worker gives back what Arrow's pool keeps in reserve."""
    yield from batches
    pa.default_memory_pool().release_unused()
