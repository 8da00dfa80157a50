"""Token ids of whole texts from a tokenizer library, each distinct stretch of text encoded once.

Texts are cut at places where no token of the tokenizer can cross. A worker keeps the ids of the stretches it has
met by 128 bits of hashes, so the library works on distinct stretches only. What is kept is bounded in bytes: beyond
KEPT_BYTES the worker starts anew, which changes no result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain
from string import punctuation

import numpy as np
import pandas as pd
import pyarrow as pa

from plumbline.llm.byte_words import GRAPHIC, double_hashes, word_runs

KEPT_BYTES = 64 << 20
#: What one stretch takes besides its ids.
ENTRY_BYTES = 48
#: Stretches that a library gets at once: its own results take over a kilobyte for each.
AT_ONCE = 4_000
#: Words that are encoded as one text: much longer texts take a library more time for each word.
JOINED = 200
#: The same where texts are normalised, which costs more in long ones.
FEW = 50


@lru_cache(maxsize=4)
def tokenizer(path: str, special_as_text: bool = False):
    """The library's tokenizer for a file; with `special_as_text` special strings in texts are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    if special_as_text:
        t.encode_special_tokens = True
    return t


def word_stretches(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts at white space, for tokenizers that drop it."""
    return word_runs(data, at, GRAPHIC)


def spaced_stretches(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts before a space that follows a character which surely is no white space, for byte-level BPE.

    Its pattern takes one space together with the word behind it, so a token always ends there. After a character
    that may be Unicode white space (its UTF-8 begins with C2, E1, E2 or E3) nothing is cut.
    """
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    spaces = np.flatnonzero(data == 32)
    spaces = spaces[spaces > 0]
    before = data[spaces - 1]
    two, three = data[np.maximum(spaces - 2, 0)], data[np.maximum(spaces - 3, 0)]
    wide = (before >= 128) & (two != 0xC2) & (three != 0xE1) & (three != 0xE2) & (three != 0xE3)
    cut[spaces[((before > 32) & (before < 127)) | wide]] = True
    cut[-1] = False
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    return starts, ends, np.searchsorted(starts, at)


def distinct_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each run the number of its bytes in a list of the distinct ones; runs stand one behind the other."""
    bounds = np.append(starts, ends[-1])
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    kinds = runs.dictionary_encode()
    return kinds.indices.to_numpy(), kinds.dictionary.to_pylist()


def larger(values: np.ndarray, used: int, size: int) -> np.ndarray:
    """The first `used` values in a new array, whose other memory is not touched yet."""
    out = np.empty(size, values.dtype)
    out[:used] = values[:used]
    return out


class Rows:
    """A growing list of lists of numbers in two flat arrays, which double when they are full."""

    def __init__(self, kind=np.int32):
        self.n, self.used = 0, 0
        self._bounds, self._values = np.zeros(1024, np.int64), np.zeros(4096, kind)

    @property
    def values(self) -> np.ndarray:
        return self._values[: self.used]

    def add(self, lists: Sequence[Sequence[int]]) -> np.ndarray:
        """The numbers of the new rows."""
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        return self.add_flat(np.fromiter(chain.from_iterable(lists), self._values.dtype, int(lengths.sum())), lengths)

    def add_flat(self, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The same for rows that stand one after the other."""
        n, total = len(lengths), self.used + len(values)
        if self.n + n + 1 > len(self._bounds):
            self._bounds = larger(self._bounds, self.n + 1, 2 * (self.n + n + 1))
        if total > len(self._values):
            self._values = larger(self._values, self.used, 2 * total)
        self._bounds[self.n + 1 : self.n + 1 + n] = self.used + np.cumsum(lengths)
        self._values[self.used : total] = values
        rows = np.arange(self.n, self.n + n)
        self.n, self.used = self.n + n, total
        return rows

    def lengths(self, rows: np.ndarray) -> np.ndarray:
        return self._bounds[rows + 1] - self._bounds[rows]

    def flat(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All values of the rows, one row after the other, and where each row ends in them."""
        lengths = self.lengths(rows)
        ends = np.cumsum(lengths)
        if not len(rows) or not ends[-1]:
            return np.zeros(0, self._values.dtype), ends
        return self._values[np.arange(ends[-1]) + np.repeat(self._bounds[rows] - (ends - lengths), lengths)], ends


class Stretches:
    """The distinct ones among stretches of a byte array, told apart by 128 bits of hashes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        first, second = double_hashes(data, starts, ends)
        self.codes, self.keys = pd.factorize(first)
        example = self._examples(len(self.keys))
        if not (second == second[example[self.codes]]).all():  # two kinds share their first hash
            _, self.codes = np.unique(np.stack([first, second]), axis=1, return_inverse=True)
            self.codes = self.codes.ravel()
            example = self._examples(int(self.codes.max()) + 1)
            self.keys = first[example]
        self.seconds = second[example]
        self._data, self._starts, self._ends = data, starts[example], ends[example]

    def _examples(self, n: int) -> np.ndarray:
        example = np.empty(n, np.int64)
        example[self.codes[::-1]] = np.arange(len(self.codes))[::-1]
        return example

    def bytes_of(self, kinds: np.ndarray) -> list[bytes]:
        data = self._data
        return [data[a:b].tobytes() for a, b in zip(self._starts[kinds].tolist(), self._ends[kinds].tolist())]


class Encoder:
    """Ids of stretches by their hashes; `rows` finds or makes them with `encode`, which takes their bytes."""

    def __init__(self, encode: Callable[[list[bytes]], list[Sequence[int]]]):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.key_rows = np.zeros(0, np.int64)
        self.late: list[tuple[np.ndarray, np.ndarray]] = []
        self.table, self.seconds, self.size = Rows(), Rows(np.uint64), 0

    def _find(self, keys: np.ndarray, seconds: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int64)
        for known, rows in ((self.keys, self.key_rows), *self.late):
            if len(known):
                k = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[k] == keys
                found[hit] = rows[k[hit]]
        at = np.flatnonzero(found >= 0)
        found[at[self.seconds.values[found[at]] != seconds[at]]] = -1
        return found

    def _add(self, keys: np.ndarray, seconds: np.ndarray, encoded: list[Sequence[int]]) -> np.ndarray:
        rows = self.table.add(encoded)
        self.seconds.add_flat(seconds, np.ones(len(seconds), np.int64))
        order = np.argsort(keys)
        self.late.append((keys[order], rows[order]))
        if sum(len(k) for k, _ in self.late) * 4 > len(self.keys) or len(self.late) > 6:
            keys, at = (np.concatenate(x) for x in zip((self.keys, self.key_rows), *self.late))
            order = np.argsort(keys)
            self.keys, self.key_rows, self.late = keys[order], at[order], []
        self.size = ENTRY_BYTES * self.table.n + 8 * self.table.used
        return rows

    def rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each stretch the row of its ids in `table`; valid until the next call."""
        return self.rows_of(Stretches(data, starts, ends)) if len(starts) else np.zeros(0, np.int64)

    def rows_of(self, stretches: Stretches) -> np.ndarray:
        """The same for stretches of which the distinct ones are known."""
        if self.size > KEPT_BYTES:
            self._clear()
        found = self._find(stretches.keys, stretches.seconds)
        for new in np.array_split(at := np.flatnonzero(found < 0), len(at) // AT_ONCE + 1):
            if len(new):
                found[new] = self._add(stretches.keys[new], stretches.seconds[new], self.encode(stretches.bytes_of(new)))
        return found[stretches.codes]

    def lengths(self, rows: np.ndarray) -> np.ndarray:
        return self.table.lengths(rows)

    def flat(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, one row after the other, and where each row ends in them."""
        return self.table.flat(rows)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    def encode(stretches: list[bytes]) -> list[list[int]]:
        texts = [s.decode("utf-8", "replace") for s in stretches]
        return [e.ids for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]

    return Encoder(encode)


@lru_cache(maxsize=1)
def word_encoder(path: str) -> Encoder:
    """The same for a space and a word behind it, and byte-level BPE: many are encoded as one text, in half the time.

    A token that begins with a space begins a word, as words have no spaces. Words with bytes of characters that may be
    Unicode white space (as in `spaced_stretches`) are encoded one by one, for there the pattern looks beyond a word.
    """
    t = tokenizer(path)
    begins = np.array([(t.id_to_token(i) or "").startswith("Ġ") for i in range(t.get_vocab_size())])
    alone = encoder.__wrapped__(path).encode
    wide = re.compile(rb"[\xc2\xe1\xe2\xe3]").search

    def joined(plain: list[bytes]) -> list[list[int]]:
        ids = t.encode_batch_fast([b"".join(plain).decode("utf-8", "replace")], add_special_tokens=False)[0].ids
        at = np.flatnonzero(begins[ids]).tolist() if ids else []
        if len(at) != len(plain) or (at and at[0]):
            return alone(plain)
        return [ids[a:b] for a, b in zip(at, [*at[1:], len(ids)])]

    def encode(stretches: list[bytes]) -> list[list[int]]:
        plain = [s for s in stretches if not wide(s)]
        found = chain.from_iterable(joined(plain[i : i + JOINED]) for i in range(0, len(plain), JOINED))
        others = iter(alone([s for s in stretches if wide(s)]) if len(plain) < len(stretches) else ())
        return [next(others if wide(s) else found) for s in stretches]

    return Encoder(encode)


@lru_cache(maxsize=1)
def marked_encoder(path: str) -> Encoder:
    """The ids of `encoder` for words without white space, and BPE that drops white space and marks where a piece ends.

    Words of letters are one piece, those with ASCII marks behind the letters two; many such words are encoded as one text
    with spaces between them. Every word has at least its number of pieces, so where all together have exactly that many
    ends, each has its own; otherwise, and for other words, they are encoded one by one.
    """
    t = tokenizer(path)
    stops = np.array([(t.id_to_token(i) or "").endswith("</w>") for i in range(t.get_vocab_size())])

    def alone(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(text: str) -> int:
        letters = text.rstrip(punctuation)
        return 0 if not letters.isalpha() else 1 if len(letters) == len(text) else 2

    def joined(plain: list[tuple[str, int]]) -> Iterator[list[int]]:
        parts = [plain[i : i + FEW] for i in range(0, len(plain), FEW)]
        for part, e in zip(parts, t.encode_batch_fast([" ".join([text for text, _ in part]) for part in parts], add_special_tokens=False)):
            ids = e.ids
            ends, upto = np.flatnonzero(stops[ids]) + 1, np.cumsum([n for _, n in part])
            if len(ends) != upto[-1] or ends[-1] != len(ids):
                yield from alone([text for text, _ in part])
            else:
                at = ends[upto - 1].tolist()
                yield from (ids[a:b] for a, b in zip([0, *at[:-1]], at))

    def encode(stretches: list[bytes]) -> list[list[int]]:
        texts = [s.decode("utf-8", "replace") for s in stretches]
        counts = [pieces(text) for text in texts]
        found = joined([(text, n) for text, n in zip(texts, counts) if n])
        others = iter(alone([text for text, n in zip(texts, counts) if not n]))
        return [next(found if n else others) for n in counts]

    return Encoder(encode)
