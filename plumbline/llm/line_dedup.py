"""Substring dedup (operator 5): hashed pieces of lines, the earliest of equal passages kept.

A unit is a piece of a line: it ends with the line, or after a word whose code points add up to an even number. Words
decide where units end, so a passage that stands in two documents is cut alike in both, wherever it begins in its
lines. A passage is UNITS consecutive units of a document, normalised (A-Z lower-cased, words joined by one space).
Passages are digested and grouped over all documents; the document with the smallest id that holds a passage keeps it,
and every other document loses it. What is lost is reported as maximal runs with their places in the original text.
No unit is too short to count; a repetition shorter than UNITS units (some thirty words) is no passage.

Passages are many and few repeat, so two Bloom filters (`keys_seen_twice` of operator 11) first tell which can repeat at all;
where the filters are full, all passages go on, with the same result. Suspects are written as (id, copy, digest, place);
digests are grouped with minima inside the tasks first, and a digest with a large share of all suspects meets
its passages by broadcast. Texts that lose nothing are never shuffled.

Null and empty texts have no units. Rows under a null id rank behind all others. Rows under one id are one document:
none takes a passage from another, and where it keeps one is a place in one of its texts. Repeated rows come out as often as they came in. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.bloom_lines import HOT_KEYS, MAX_BITS, MIN_BITS, all_set, keys_seen_twice, probes
from plumbline.llm.byte_words import GRAPHIC, LOWER, run_hashes, slices, text_bytes, word_runs
from plumbline.sources.storage import scratch_path

UNITS = 16
#: Bytes of text for each passage, about, and bits of the filters for each.
PASSAGE_BYTES, PASSAGE_BITS = 15, 8
#: Bytes of text that are cut into passages at once; what a worker needs for that is some fifty times as much.
AT_ONCE = 1 << 19
BROADCAST_ROWS = 200_000


class Passages:
    """The passages of many texts: for each its text, its bytes in `words` (normalised) and its place in the original."""

    def __init__(self, column: pa.Array, units: int):
        data, at = text_bytes(column)
        low = LOWER[data]
        starts, ends, bounds = word_runs(low, at, GRAPHIC)
        inside = GRAPHIC[low]
        behind = np.append(False, inside[:-1]) & ~inside if len(inside) else inside  # one space is kept behind a word
        # Two texts may touch without white space; a passage never crosses, so no space is missed inside one.
        low[behind] = 32
        kept = inside | behind
        self.words = low[kept]
        place = np.cumsum(kept, dtype=np.int32) - 1
        # The lowest bit of a character is that of its last byte in UTF-8.
        last = np.append((data[1:] & 0xC0) != 0x80, True) if len(data) else np.zeros(0, bool)
        odd = np.cumsum(np.append(False, last & (low & 1).astype(bool)), dtype=np.int32)
        breaks = np.cumsum(np.append(False, data == 10), dtype=np.int32)
        stops = (odd[ends] - odd[starts]) % 2 == 0
        if len(starts):
            stops[:-1] |= breaks[starts[1:]] > breaks[ends[:-1]]
            stops[bounds[1:][bounds[1:] > 0] - 1] = True
        until = np.flatnonzero(stops)  # the last word of each unit
        since = np.append(0, until[:-1] + 1) if len(until) else until
        of = np.searchsorted(bounds, since, "right") - 1
        n = max(len(until) - units + 1, 0)
        same = of[:n] == of[len(of) - n :] if n else of[:0].astype(bool)
        first, end = since[:n][same], until[len(until) - n :][same]
        self.of = of[:n][same]
        self.starts, self.ends = place[starts[first]], place[ends[end] - 1] + 1
        chars = np.cumsum(np.append(False, (data & 0xC0) != 0x80), dtype=np.int32)
        self.place = chars[starts[first]] - chars[at[self.of]]
        self.length = chars[ends[end]] - chars[starts[first]]

    def hashes(self) -> np.ndarray:
        return run_hashes(self.words, self.starts, self.ends, one_by_one=False)


def filter_bits(size: int) -> int:
    """Bits of each filter for texts of `size` bytes."""
    return min(MAX_BITS // 2, max(MIN_BITS, 1 << int(size // PASSAGE_BYTES * PASSAGE_BITS).bit_length()))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: int = UNITS) -> DataFrame:
    """(id, copy, start, length, kept_id, kept_start) of every passage that a smaller id holds too, for each row of it."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = filter_bits(size)

    def keys(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        found = Passages(part.column("text"), units)
        return found.of, found.hashes()

    shared = rows.sparkSession.sparkContext.broadcast(keys_seen_twice(rows, bits, keys, AT_ONCE))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", AT_ONCE):
            p = Passages(part.column("text"), units)
            k = np.flatnonzero(all_set(shared.value, probes(p.hashes(), bits)))
            if len(k):
                raw, of = p.words.tobytes(), p.of[k]
                digests = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(p.starts[k].tolist(), p.ends[k].tolist())])
                keys = np.frombuffer(digests, "<i8").reshape(-1, 2)
                # Where the text has each passage first: of several places in one text, that one counts as kept.
                order = np.lexsort((np.arange(len(k)), keys[:, 1], keys[:, 0], of))
                new = np.append(True, (of[order[1:]] != of[order[:-1]]) | (keys[order[1:]] != keys[order[:-1]]).any(axis=1))
                first = np.empty(len(k), np.int64)
                first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
                at = pa.array(of)
                columns = [keys[:, 0], keys[:, 1], p.place[k], p.length[k], p.place[k][first]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(at), part.column("copy").take(at), *(pa.array(np.ascontiguousarray(c).astype(np.int64)) for c in columns)],
                    names=["id", "copy", "h1", "h2", "start", "length", "first"],
                )

    def written(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(df.sparkSession, label)
        df.write.parquet(path)
        return df.sparkSession.read.parquet(path)

    listed = rows.withColumn("copy", F.xxhash64("text")).mapInArrow(suspects, f"id {kind}, copy long, h1 long, h2 long, start long, length long, first long")
    seen, key = written(listed, "passages"), ["h1", "h2"]
    # Minima and maxima leave nulls out, so a null id ranks behind all others.
    kept = seen.groupBy(*key).agg(
        F.min("id").alias("kept_id"), F.max("id").alias("latest"), F.count("id").alias("known"), F.count("*").alias("n"), F.min_by("first", "id").alias("kept_start")
    )
    others = (F.col("kept_id") != F.col("latest")) | ((F.col("known") > 0) & (F.col("known") < F.col("n")))
    kept, total = written(kept.where(others).select(*key, "n", "kept_id", "kept_start"), "kept"), seen.count()
    hot, cold = kept.where(F.col("n") * HOT_KEYS > total), kept.where(F.col("n") * HOT_KEYS <= total)
    rest = seen.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold.hint("shuffle_hash"), key)
    lost = seen.join(F.broadcast(hot), key).unionAll(rest).where(~F.col("id").eqNullSafe(F.col("kept_id")))
    return lost.select("id", "copy", "start", "length", "kept_id", "kept_start")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: int = UNITS) -> DataFrame:
    """(id, copy, start, length, n_passages, kept_id, kept_start): maximal runs of passages that an earlier document holds.

    `copy` tells rows of one id with different texts apart; equal rows are listed once. Places are in code points.
    `kept_id` and `kept_start` are where the first passage of the run stays. Runs are found in windows over sorted rows,
    one window for each text, so that no list of passages is held as objects.
    """
    lost = repeated_passages(docs, id_col, text_col, units).withColumn("stop", F.col("start") + F.col("length"))
    text = Window.partitionBy("id", "copy").orderBy("start")
    before = F.max("stop").over(text.rowsBetween(Window.unboundedPreceding, -1))
    again = F.col("start").eqNullSafe(F.lag("start").over(text))  # the same passage of an equal row
    apart = lost.select("*", F.coalesce(F.col("start") > before, F.lit(True)).cast("int").alias("begins"), (~again).cast("int").alias("new"))
    numbered = apart.withColumn("run", F.sum("begins").over(text.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = numbered.groupBy("id", "copy", "run").agg(
        F.min("start").alias("begin"), F.max("stop").alias("stop"), F.sum("new").alias("n_passages"), F.min_by("kept_id", "start").alias("kept_id"), F.min_by("kept_start", "start").alias("kept_start")
    )
    return runs.select(
        F.col("id").alias(id_col), "copy", F.col("begin").alias("start"), (F.col("stop") - F.col("begin")).alias("length"), "n_passages",
        F.col("kept_id").alias(f"kept_{id_col}"), "kept_start",
    )


def without_spans(text: str | None, spans: list[tuple[int, int]] | None) -> str | None:
    """The text without the spans at (start, length); the white space behind a removed span goes with it."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for start, length in sorted(spans):
        out.append(text[at:start])
        at = max(at, start + length + 1)
    return "".join(out) + text[at:]


def repeats_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: int = UNITS) -> DataFrame:
    """The documents with repeated passages cut out of their texts; documents without any are as they were.

    A document of which nothing is left stays, with an empty text. Other columns are as they were. The (id, copy) that
    lose something are counted: up to BROADCAST_ROWS of them are broadcast, and only their rows meet what they lose in
    a join; beyond, all rows do.
    """
    tag = uuid.uuid4().hex
    spans, of_id, of_copy = (f"__{c}_{tag}" for c in ("spans", "id", "copy"))
    found = repeated_spans(docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")), "i", "t", units)
    path = scratch_path(docs.sparkSession, "spans")
    found.groupBy("i", "copy").agg(F.collect_list(F.struct("start", "length")).alias(spans)).select(F.col("i").alias(of_id), F.col("copy").alias(of_copy), spans).write.parquet(path)
    lists = docs.sparkSession.read.parquet(path)
    hit = F.col(f"`{id_col}`").eqNullSafe(F.col(of_id)) & (F.xxhash64(f"`{text_col}`") == F.col(of_copy))
    names, position = docs.columns, docs.columns.index(text_col)
    whole = [F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names)]  # names with dots don't reach a Python worker

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], f"c{position}", 16 << 20):
                columns = part.columns
                texts = [without_spans(t, s and [(x["start"], x["length"]) for x in s]) for t, s in zip(columns[position].to_pylist(), columns[-1].to_pylist())]
                columns[position] = pa.array(texts, columns[position].type)
                yield pa.RecordBatch.from_arrays(columns[:-1], names=names)

    if lists.count() > BROADCAST_ROWS:
        return docs.join(lists, hit, "left").select(*whole, spans).mapInArrow(run, docs.schema)
    losing = F.broadcast(lists.select(of_id, of_copy))
    cut = docs.join(losing, hit, "left_semi").join(lists, hit).select(*whole, spans).mapInArrow(run, docs.schema)
    return docs.join(losing, hit, "left_anti").unionAll(cut)
