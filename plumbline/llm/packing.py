"""Packing (operator 9): harmonic classes, filled by every worker on its own.

A document's ids are cut into pieces whose lengths are reciprocals of the capacity: whole sequences first, then
1/2, 1/4, ... of it down to SMALLEST, and a rest. Class k holds pieces of at most capacity/k ids and its bins take
exactly k pieces, so bins of the cut classes are full and the rests (shorter than SMALLEST) waste at most one part
in k + 1 of theirs. A worker holds the ids of fewer than k pieces of each class. What is left at its end is poured
into full sequences, and the last ids into sequences whose lengths are powers of two: these need no padding.

Null text is empty: its document is the end id alone. Rows with null or repeated ids are packed as rows of their
own. An empty table gives no rows. Sequence numbers carry the number of the task, so they are unique and a task that
is run again after a lost executor makes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.byte_words import slices, text_bytes
from plumbline.llm.tokenizing import marked_encoder, word_stretches

CAPACITY = 2048
SMALLEST = 64
END_ID = 1

Piece = tuple[object, int, np.ndarray, int]  # document, ids before it, ids, ids of the document


def cut(n: int, capacity: int, smallest: int) -> list[int]:
    """Lengths of the pieces of n ids: capacity, then its halves, then what remains."""
    out, size = [], capacity
    while n and size >= smallest:
        out += [size] * (n // size)
        n, size = n % size, size // 2
    return out + [n] * bool(n)


class Bins:
    """Open bins of one worker. `place` gives the pieces of a bin that became full, `rest` all that are left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list[Piece]] = {}

    def place(self, piece: Piece) -> list[Piece] | None:
        k = self.capacity // len(piece[2])
        waiting = self.open.setdefault(k, [])
        waiting.append(piece)
        return self.open.pop(k) if len(waiting) == k else None

    def rest(self) -> Iterator[list[Piece]]:
        left = [p for k in sorted(self.open) for p in self.open[k]]
        total = sum(len(p[2]) for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in reversed(range(self.capacity.bit_length())) if (total % self.capacity) >> b & 1]
        for size in sizes:
            bin_, room = [], size
            while room:
                doc, start, ids, n = left.pop(0)
                bin_.append((doc, start, ids[:room], n))
                if len(ids) > room:
                    left.insert(0, (doc, start + room, ids[room:], n))
                room -= min(room, len(ids))
            yield bin_


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, smallest: int = SMALLEST, with_ids: bool = False
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for.

    `capacity` must be a power of two; `path` is a tokenizer that drops white space.
    """
    if capacity < 2 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, task, made, out, id_type = Bins(capacity), TaskContext.get().partitionId(), 0, [], None

        def close(pieces: list[Piece]) -> None:
            nonlocal made
            number, offset = (task << 36) + made, 0
            made += 1
            for doc, start, ids, n in pieces:
                out.append((doc, start, len(ids), crc32(ids.tobytes()), n, number, offset, *[ids.tolist()] * with_ids))
                offset += len(ids)

        def flushed() -> pa.RecordBatch:
            kinds = [id_type, *[pa.int64()] * 6, *[pa.list_(pa.int32())] * with_ids]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out.clear()
            return batch

        for part in slices(batches, "text"):
            id_type = part.column("id").type
            data, at = text_bytes(part.column("text"))
            starts, ends, bounds = word_stretches(data, at)
            known = marked_encoder(path)
            flat, upto = known.flat(known.rows(data, starts, ends))
            upto = np.append(0, upto)[bounds]
            for k, doc in enumerate(part.column("id").to_pylist()):
                ids = np.append(flat[upto[k] : upto[k + 1]], END_ID).astype("<u4")
                start = 0
                for length in cut(len(ids), capacity, smallest):
                    full = bins.place((doc, start, ids[start : start + length].copy(), len(ids)))
                    start += length
                    if full:
                        close(full)
            if out:
                yield flushed()
        for pieces in bins.rest():
            close(pieces)
        if out:
            yield flushed()

    fields = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, fields + ", ids array<int>" * with_ids)
