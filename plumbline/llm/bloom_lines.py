"""Line dedup (operator 11): two Bloom filters, for hashes seen once and seen twice; only suspects are shuffled.

A line's key is the line stripped of ASCII white space at both ends, A-Z lower-cased. Keys of at least MIN_CHARS code
points that stand in two documents or more lose all their lines except in the document with the smallest id.

1. Every task sets the bits of its keys in a filter `once`, and those of keys that it meets in a second document in a
   filter `twice`. The tasks' filters are cut into slices, compressed, and merged slice by slice: a bit that two tasks
   have set once is set in `twice`. What travels is some five bytes a distinct line of a task.
2. A line whose bits are not all set in `twice` stands in one document only. All others are suspects: their 128-bit
   digests are grouped over all documents, which settles exactly what repeats and where it stands first. Digests with
   more than 1 in HOT_KEYS of the suspected lines, so fewer than HOT_KEYS of them, meet their lines by broadcast, the
   others in a join: no line piles up in one task.
3. Documents without a suspect are done where they are read. The others meet the digests they lose, one list for each
   (id, text), and are cut.

The filters have 12 bits a line or more, a power of two, at most MAX_BITS (128 MB each), so what reaches the driver and
what is broadcast is bounded. Beyond about 90 million lines they fill up: more lines become suspects, up to all of
them, and the job becomes the plain grouping of digests. The result is the same at every size.

Rows with one id (null is an id too, the largest) are one document. Null and empty texts have one empty line. Repeated
rows come out as often as they came in; an empty table gives no rows; other columns are never touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.byte_words import LOWER, SLICE_BYTES, WHITE, mixed, run_hashes, slices, text_bytes
from plumbline.sources.storage import cut_lineage

MIN_CHARS = 10
BITS_A_LINE = 12
MIN_BITS, MAX_BITS = 1 << 20, 1 << 30
PROBES = 4
HOT_KEYS = 2000
SLICE = 1 << 16  # bytes of a filter that travel together
BLANK = " \t\n\x0b\x0c\r"


def line_keys(data: np.ndarray, at: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the keys that are long enough, in the bytes of many texts."""
    breaks = np.flatnonzero(data == 10)
    starts, ends = np.sort(np.append(at[:-1], breaks + 1)), np.sort(np.append(breaks, at[1:]))
    of = np.repeat(np.arange(len(at) - 1), 1 + np.diff(np.searchsorted(breaks, at)))
    solid = np.flatnonzero(~WHITE[data])
    if not len(solid):
        return of[:0], starts[:0], ends[:0]
    first, last = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    full = np.flatnonzero(first <= last)
    of, starts, ends = of[full], solid[first[full]], solid[last[full]] + 1
    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    enough = chars[ends] - chars[starts] >= min_chars
    return of[enough], starts[enough], ends[enough]


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of each hash in a filter, one row a hash."""
    step = mixed(hashes) | np.uint64(1)
    return ((hashes[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def all_set(filter_: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((filter_[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=1)


def set_all(filter_: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(filter_, places.ravel() >> 3, np.left_shift(1, places.ravel() & 7).astype(np.uint8))


def _packed(filter_: np.ndarray) -> bytes:
    return pa.compress(filter_.tobytes(), "zstd", asbytes=True)


def _unpacked(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, size, "zstd", asbytes=True), np.uint8)


def keys_seen_twice(
    rows: DataFrame, bits: int, keys: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], limit: int = SLICE_BYTES
) -> np.ndarray:
    """The filter of keys in two documents or more, from rows with a column `text`; a superset of the truth.

    `keys` gives (row, hash) of the keys in a batch of at most `limit` bytes, or of one text.
    """
    size = min(SLICE, bits // 8)
    schema = "slice int, once binary, twice binary"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for part in slices(batches, "text", limit):
            of, hashes = keys(part)
            order = np.lexsort((of, hashes))
            hashes, of = hashes[order], of[order]
            new = np.append(True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1]))[: len(hashes)]  # once a document
            kinds, n = np.unique(hashes[new], return_counts=True)
            places = probes(kinds, bits)
            set_all(twice, places[all_set(once, places) | (n > 1)])
            set_all(once, places)
        for k in range(bits // 8 // size):
            here = slice(k * size, (k + 1) * size)
            if once[here].any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "once": [_packed(once[here])], "twice": [_packed(twice[here])]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, a, b in zip(*(batch.column(c).to_pylist() for c in ("slice", "once", "twice"))):
                a, b = _unpacked(a, size), _unpacked(b, size)
                once, twice = merged.get(k) or (np.zeros(size, np.uint8), np.zeros(size, np.uint8))
                merged[k] = once | a, twice | b | (once & a)
        for k, (_, twice) in merged.items():
            if twice.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "twice": [_packed(twice)]})

    parts = rows.select("text").mapInArrow(build, schema).repartition("slice").mapInArrow(merge, "slice int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.toLocalIterator():  # at most bits / 8 bytes in all
        out[row["slice"] * size : (row["slice"] + 1) * size] = _unpacked(bytes(row["twice"]), size)
    return out


def hashed_lines(part: pa.RecordBatch, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of a batch, and (text, start, end, hash) of the keys in them."""
    data, at = text_bytes(part.column("text"))
    data = LOWER[data]
    of, starts, ends = line_keys(data, at, min_chars)
    return data, of, starts, ends, run_hashes(data, starts, ends, one_by_one=False)


def seen_twice(rows: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The same filter for the keys of lines."""
    return keys_seen_twice(rows, bits, lambda part: hashed_lines(part, min_chars)[1::3])


def _digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def line_key(line: str) -> str:
    return line.strip(BLANK)


def without_lines(text: str, lost: set[bytes], min_chars: int) -> tuple[str, int, list[tuple[int, int]]]:
    """The text without the lines whose digests are in `lost`, its lines, and (start, length) of the dropped ones."""
    kept, dropped, start = [], [], 0
    lines = text.split("\n")
    for line in lines:
        key = line_key(line)
        if len(key) >= min_chars and _digest(key.encode().lower()) in lost:
            dropped.append((start, len(line)))
        else:
            kept.append(line)
        start += len(line) + 1
    return "\n".join(kept), len(lines), dropped


def _n_lines(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def lines_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, text, n_lines, n_dropped, dropped) of every row: the text that stays, and the (start, length) of the lines that went.

    Places are code points of the original text; `n_lines` counts before dropping. Null texts come out empty.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    lines = rows.agg(F.sum(_n_lines(F.col("text")))).first()[0] or 0
    bits = min(MAX_BITS, max(MIN_BITS, 1 << int(lines * BITS_A_LINE).bit_length()))

    shared = rows.sparkSession.sparkContext.broadcast(seen_twice(rows, bits, min_chars))

    def suspects(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data, of, starts, ends, hashes = hashed_lines(part, min_chars)
        hit = all_set(shared.value, probes(hashes, bits))
        return data, of[hit], starts[hit], ends[hit]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, of, starts, ends = suspects(part)
            raw = data.tobytes()
            found = sorted({(t, _digest(raw[a:b])) for t, a, b in zip(of.tolist(), starts.tolist(), ends.tolist())})
            if found:
                of, keys = zip(*found)
                at = pa.array(of)
                yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("copy").take(at), pa.array(keys, pa.binary())], names=["id", "copy", "key"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            suspected = np.zeros(part.num_rows, bool)
            suspected[suspects(part)[1]] = True
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(suspected)], names=["id", "text", "suspected"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for part in slices(batches, "text", 16 << 20):
            texts, counts, dropped = [], [], []
            for text, lost in zip(part.column("text").to_pylist(), part.column("lost").to_pylist()):
                text, n, gone = without_lines(text, set(lost or ()), min_chars)
                texts.append(text)
                counts.append(n)
                dropped.append([{"start": s, "length": k} for s, k in gone])
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array([len(d) for d in dropped], pa.int64()), pa.array(dropped, spans)],
                names=[id_col, text_col, "n_lines", "n_dropped", "dropped"],
            )

    copy = F.xxhash64("text")
    seen = cut_lineage(rows.withColumn("copy", copy).mapInArrow(digests, f"id {kind}, copy long, key binary"))
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"))
    kept = seen.groupBy("key").agg(F.min(place).alias("kept"), F.max(place).alias("latest"), F.count("*").alias("n")).where("kept <> latest").select("key", "kept", "n")
    kept, total = cut_lineage(kept), seen.count()
    hot, cold = kept.where(F.col("n") * HOT_KEYS > total), kept.where(F.col("n") * HOT_KEYS <= total)
    rest = seen.join(F.broadcast(hot.select("key")), "key", "left_anti").join(cold, "key")
    lost = seen.join(F.broadcast(hot), "key").unionAll(rest).where(place != F.col("kept"))
    lists = lost.groupBy("id", "copy").agg(F.collect_set("key").alias("lost")).select(F.col("id").alias("of_id"), F.col("copy").alias("of_copy"), "lost")

    shape = f"`{id_col}` {kind}, `{text_col}` string, n_lines long, n_dropped long, dropped array<struct<start:bigint,length:bigint>>"
    split = rows.mapInArrow(marked, f"id {kind}, text string, suspected boolean")
    clean = split.where("not suspected").select(
        F.col("id").alias(id_col), F.col("text").alias(text_col), _n_lines(F.col("text")).alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"),
        F.array().cast("array<struct<start:bigint,length:bigint>>").alias("dropped"),
    )
    same = F.col("id").eqNullSafe(F.col("of_id")) & (copy == F.col("of_copy"))
    return clean.unionAll(split.where("suspected").join(lists, same, "left").select("id", "text", "lost").mapInArrow(cut, shape))
