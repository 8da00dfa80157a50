"""Benchmark decontamination (operator 3): an FM-index of every training shard.

A shard is a slice of a partition, cut by bytes of text. Its words are numbered by the benchmark's vocabulary; a word
outside of it cannot be part of a window, so it separates, and stretches shorter than the shortest window are not
indexed. Over the rest stand a suffix array (prefix doubling), its Burrows-Wheeler transform in a wavelet tree, and
sampled suffix positions. All windows are searched backward at once through wavelet-tree ranks; occurrences are
located by steps back to the next sample, and merged into the spans to remove.

The benchmark travels to the tasks in blocks of at most BLOCK_BYTES of text (the stated query set, in blocks), one
pass over the documents for each. Null texts have no words; items without an id are left out; equal item_ids are one
item; rows with null or repeated ids are rows of their own; an empty table or benchmark gives zero hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.byte_words import ALNUM, LOWER, per_text, run_hashes, slices, text_bytes, word_runs

WINDOW = 13
BLOCK_BYTES = 8 << 20
SAMPLE = 16
SHARD_BYTES = 4 << 20


class WaveletTree:
    """Ranks in a sequence of numbers below 2**levels: one bit vector a level, split by the bits from the highest on."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels = levels
        self.ones = []  # how many ones stand before each place of the level
        now = values
        for level in reversed(range(levels)):
            bit = (now >> level & 1).astype(bool)
            self.ones.append(np.append(0, np.cumsum(bit, dtype=np.int32)).astype(np.int32))
            now = np.concatenate([now[~bit], now[bit]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        lo, hi = np.zeros(len(place), np.int64), place.astype(np.int64)
        for level, ones in zip(reversed(range(self.levels)), self.ones):
            one = (symbol >> level & 1).astype(bool)
            zeros = len(ones) - 1 - int(ones[-1])
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        start, now, symbol = np.zeros(len(place), np.int64), place.astype(np.int64), np.zeros(len(place), np.int64)
        for ones in self.ones:
            zeros = len(ones) - 1 - int(ones[-1])
            one = ones[now + 1] > ones[now]
            a, b = ones[start], ones[now]
            start, now = np.where(one, zeros + a, start - a), np.where(one, zeros + b, now - b)
            symbol = symbol * 2 + one
        return symbol, now - start


class FMIndex:
    """Backward search and location in a sequence of numbers; an end below all of them is added."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.text = np.append(text + 1, 0).astype(np.int64)
        symbols += 1
        order = suffix_array(self.text)
        self.tree = WaveletTree(self.text[order - 1], max(1, int(symbols - 1).bit_length()))
        self.before = np.append(0, np.cumsum(np.bincount(self.text, minlength=symbols)))
        sampled = order % SAMPLE == 0
        self.sampled = np.append(0, np.cumsum(sampled))
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows lo..hi of the suffixes that begin with each phrase; a phrase stands at the right of its row."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.text), np.int64)
        for step in range(phrases.shape[1]):
            go = np.flatnonzero((lengths > step) & (hi > lo))
            symbol = phrases[go, phrases.shape[1] - 1 - step] + 1
            lo[go] = self.before[symbol] + self.tree.rank(symbol, lo[go])
            hi[go] = self.before[symbol] + self.tree.rank(symbol, hi[go])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of the suffix in each row."""
        now, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            here = now[todo]
            done = self.sampled[here + 1] > self.sampled[here]
            out[todo[done]] = self.samples[self.sampled[here[done]]] + steps[todo[done]]
            todo = todo[~done]
            symbol, rank = self.tree.at(now[todo])
            now[todo] = self.before[symbol] + rank
            steps[todo] += 1
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order, by prefix doubling; only suffixes that are not settled are sorted on."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.append(True, text[order][1:] != text[order][:-1])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 1
    while True:
        tied = np.append(~new[1:], False) | ~new
        rows = np.flatnonzero(tied)
        if not len(rows):
            return order
        own = order[rows]
        ahead = own + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        first = rank[own]
        again = np.lexsort((second, first))
        order[rows] = own[again]
        first, second = first[again], second[again]
        differs = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        new[rows] = differs
        rank[order[rows]] = rows[np.maximum.accumulate(np.where(differs, np.arange(len(rows)), 0))]
        step *= 2


class Phrases:
    """The windows of a block of the benchmark, as numbers of its vocabulary (from 1 on)."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int):
        data, at = text_bytes(texts)
        data = LOWER[data]
        starts, ends, bounds = word_runs(data, at, ALNUM)
        hashes = run_hashes(data, starts, ends)
        self.vocabulary, words = np.unique(hashes, return_inverse=True)
        size = np.diff(bounds)
        count = np.where(size >= window, size - window + 1, (size > 0).astype(np.int64))
        item = np.repeat(np.arange(len(ids)), count)
        begin = np.repeat(bounds[:-1], count) + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(size, window)[item]
        column = np.arange(window) - (window - length[:, None])  # phrases end at the right edge
        phrases = np.where(column >= 0, words[np.minimum(begin[:, None] + np.maximum(column, 0), max(len(words) - 1, 0))] + 1, 0) if len(words) else np.zeros((0, window), np.int64)
        self.phrases, at = np.unique(phrases, axis=0, return_inverse=True)
        self.lengths = (self.phrases > 0).sum(axis=1)
        order = np.argsort(at.ravel(), kind="stable")
        self.items = item[order]  # items of phrase k: items[of[k]:of[k + 1]]
        self.of = np.searchsorted(at.ravel()[order], np.arange(len(self.phrases) + 1))
        self.ids = np.array(ids, object)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, 0 outside of the vocabulary."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        k = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[k] == hashes, k + 1, 0)

    def occurrences(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first word) of all occurrences in the numbered words of a shard's texts."""
        none = np.zeros(0, np.int64)
        if not len(self.phrases) or not len(words):
            return none, none
        inside = words > 0
        edge = np.zeros(len(words) + 1, bool)
        edge[bounds] = True
        begins = np.flatnonzero(inside & (edge[:-1] | np.append(True, ~inside[:-1])))
        ends = np.flatnonzero(inside & (edge[1:] | np.append(~inside[1:], True))) + 1
        long = ends - begins >= self.lengths.min()
        begins, ends = begins[long], ends[long]
        if not len(begins):
            return none, none
        size = ends - begins + 1  # and a separator
        upto = np.cumsum(size)
        where = np.arange(upto[-1]) - np.repeat(upto - size, size) + np.repeat(begins, size)
        text = np.where(where < np.repeat(ends, size), words[np.minimum(where, len(words) - 1)], 0)
        index = FMIndex(text, len(self.vocabulary) + 1)
        lo, hi = index.search(self.phrases, self.lengths)
        found = np.flatnonzero(hi > lo)
        count = (hi - lo)[found]
        phrase = np.repeat(found, count)
        rows = np.repeat(lo[found], count) + np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count)
        return phrase, where[index.locate(rows)]


def merged(begin: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The spans in order, overlapping and adjoining ones as one."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    inside = np.cumsum(step)[:-1] > 0
    edges = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _blocks(benchmark: DataFrame, window: int) -> list[Phrases]:
    """The benchmark's items in blocks of bounded text, each gathered on its own."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // BLOCK_BYTES
    out = []
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).toArrow()
        if rows.num_rows:
            out.append(Phrases(rows.column("item").to_pylist(), rows.column("text"), window))
    return out


def _hits(phrases: Phrases, part: pa.RecordBatch) -> tuple[np.ndarray, list[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """Words of each text, items of each text, merged spans (text, first word, word behind), and the words' places."""
    data, at = text_bytes(part.column("text"))
    data = LOWER[data]
    starts, ends, bounds = word_runs(data, at, ALNUM)
    phrase, first = phrases.occurrences(phrases.numbers(run_hashes(data, starts, ends)), bounds)
    begin, end = merged(first, first + phrases.lengths[phrase], len(starts)) if len(phrase) else (first, first)
    if len(begin):  # spans that adjoin across two texts are two
        seams = np.unique(bounds)
        parts = np.unique(np.concatenate([begin, seams[np.searchsorted(begin, seams, "right") > np.searchsorted(end, seams, "right")]]))
        inside = np.searchsorted(begin, parts, "right") > np.searchsorted(end, parts, "right")
        parts = parts[inside]
        end = np.minimum(end[np.searchsorted(begin, parts, "right") - 1], seams[np.minimum(np.searchsorted(seams, parts, "right"), len(seams) - 1)])
        begin = parts
    items: list[list[str]] = [[] for _ in range(part.num_rows)]
    if len(phrase):
        text = np.searchsorted(bounds, first, "right") - 1
        pairs = np.unique(np.stack([text, phrase]), axis=1)
        count = phrases.of[pairs[1] + 1] - phrases.of[pairs[1]]
        of = np.repeat(phrases.of[pairs[1]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        for t, i in np.unique(np.stack([np.repeat(pairs[0], count), phrases.items[of]]), axis=1).T.tolist():
            items[t].append(phrases.ids[i])
    text = np.searchsorted(bounds, begin, "right") - 1
    return np.diff(bounds), items, (text, begin - bounds[text], end - bounds[text]), starts, bounds


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, items, spans) of every row: the items that occur and the words (first, behind) to remove."""
    span = pa.struct([("first", pa.int64()), ("behind", pa.int64())])
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"), F.array().cast("array<string>").alias("items"),
        F.array().cast("array<struct<first:long,behind:long>>").alias("spans"),
    )
    for phrases in _blocks(benchmark, window) or [Phrases([], pa.array([], pa.string()), window)]:
        shared = docs.sparkSession.sparkContext.broadcast(phrases)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text", SHARD_BYTES):
                n_words, items, (text, begin, end), _, _ = _hits(shared.value, part)
                spans = part.column("spans").to_pylist()
                for t, b, e in zip(text.tolist(), begin.tolist(), end.tolist()):
                    spans[t].append({"first": b, "behind": e})
                items = [sorted({*old, *new}) for old, new in zip(part.column("items").to_pylist(), items)]
                spans = [_union(s) for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("text"), pa.array(n_words), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(span))],
                    names=["id", "text", "n_words", "items", "spans"],
                )

        rows = rows.mapInArrow(run, rows.schema)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["behind"] - s["first"])
    return rows.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), "items", "spans")


def _union(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["first"]):
        if out and s["first"] <= out[-1]["behind"]:
            out[-1]["behind"] = max(out[-1]["behind"], s["behind"])
        else:
            out.append(dict(s))
    return out


def contaminated(share: int = 20):
    """The contract's rule: hit words, and at least one in `share` of all."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """The documents that are not contaminated; the others go whole. Columns are as they are."""
    blocks = _blocks(benchmark, window)
    if not blocks:
        return docs
    if len(blocks) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(blocks[0])
        position = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text_col, SHARD_BYTES):
                own = pa.RecordBatch.from_arrays([part.column(position)], names=["text"])
                n_words, _, (text, begin, end), _, _ = _hits(shared.value, own)
                n_hit = np.bincount(text, end - begin, minlength=part.num_rows).astype(np.int64)
                yield part.filter(pa.array((n_hit == 0) | (n_hit * share < n_words)))

        return docs.mapInArrow(run, docs.schema)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    judged = contamination(keyed, benchmark, "row", "text", window)
    return judged.where(~contaminated(share)).select("row.*")
