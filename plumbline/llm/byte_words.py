"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow column.

An Arrow string column already is one byte buffer with offsets, so words are found as runs in a byte mask and
hashed by differences of one running sum, without a Python object per word. Work goes by slices of bounded
bytes; a single longer text is a slice of its own and is cut at word boundaries inside.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_128_intdigest

SLICE_BYTES = 2 << 20
#: Bytes that are hashed at once: what a step makes of them stays in the cache.
HASHED_BYTES = 1 << 18
#: Longer runs are hashed one by one: modulo 2**64 the running sum has known equal pairs of some thousand bytes.
SHORT_RUN = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Words of letters and digits after lower-casing: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Words between white space: `[^\x20\x09-\x0D]+`.
GRAPHIC = ~WHITE

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_SECOND_BYTE = np.random.default_rng(20240301).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_RANDOM.integers(0, 2**63)) * 2 + 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, one_by_one: bool = True) -> np.ndarray:
    """A 64-bit hash of each run data[start:end]; equal bytes have equal hashes wherever they stand.

    Without `one_by_one` long runs are hashed as short ones are, which is enough where equal hashes are only suspected.
    """
    return _hashes(data, starts, ends, [_BYTE], one_by_one)[0]


def double_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run, which together stand for its bytes."""
    first, second = _hashes(data, starts, ends, [_BYTE, _SECOND_BYTE], True)
    return first, second


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tables: list[np.ndarray], one_by_one: bool) -> list[np.ndarray]:
    out = [np.empty(len(starts), np.uint64) for _ in tables]
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + HASHED_BYTES, "right")))
        part = data[lo : int(ends[j - 1])]
        up, down = _tables(len(part) + 1)
        s, e = starts[i:j] - lo, ends[i:j] - lo
        total = np.zeros(len(part) + 1, np.uint64)
        for hashes, table in zip(out, tables):
            np.cumsum(table[part] * up[: len(part)], out=total[1:])
            hashes[i:j] = mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        for k in np.flatnonzero(e - s > SHORT_RUN).tolist() if one_by_one else ():
            both = xxh3_128_intdigest(part[s[k] : e[k]].tobytes())
            for hashes, h in zip(out, (both & 0xFFFFFFFFFFFFFFFF, both >> 64)):
                hashes[i + k] = h
        i = j
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of at most `limit` bytes of text; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(text))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def word_runs(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n + 1 bounds).

    `data` is lower-cased already where that matters; words never cross from one text into the next.
    """
    inside = is_word[data]
    begins = np.empty(len(inside) + 1, bool)
    begins[0], begins[-1] = len(inside) > 0 and inside[0], False
    if len(inside):
        np.greater(inside[1:], inside[:-1], out=begins[1:-1])
    stops = np.empty(len(inside) + 1, bool)
    stops[0], stops[-1] = False, len(inside) > 0 and inside[-1]
    if len(inside):
        np.greater(inside[:-1], inside[1:], out=stops[1:-1])
        seams = at[1:-1]
        seams = seams[(seams > 0) & (seams < len(inside))]
        both = seams[inside[seams - 1] & inside[seams]]
        begins[both] = stops[both] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(starts, at)


def per_text(values: np.ndarray, bounds: np.ndarray, dtype=np.float64) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]] along the first axis; empty ranges give zero."""
    n = len(bounds) - 1
    out = np.zeros((n, *values.shape[1:]), dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0, dtype=dtype)
    return out
