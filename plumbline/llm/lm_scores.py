"""LM scoring (operator 6): a causal self-attention model over subword ids, and a unigram base over all words.

Words are runs without white space, A-Z lower-cased; every text ends with an end token. For the model each word is
the byte-level BPE ids of a space and the word, so ids and words give each other back, and the probability of a word
is that of its ids: the class of each id given those before it (`attention`), times the share of the id in its class,
sharpened by the corpus's counts of pairs and triples of ids (each order gives what it has not seen to the one below,
and the lowest is the attention model). Words that the corpus knows are better predicted by their frequency than by their spelling: the score of a word is
log10((1 - b) * u + b * q) with the attention model's q and the word's discounted share u of all training words. b is
fitted by expectation-maximisation, where each text's own words and n-grams are taken out of the counts.

Everything is learned from all training rows. All texts are encoded once and their ids written to the shared folder.
One pass counts words and pairs of ids (ids and pairs of classes are sums of these), one triples of ids behind the
frequent pairs. One pass trains the attention weights: every task starts from the same weights and takes steps over
all its windows, and the weights are averaged. That pass also gathers what b needs, a histogram of the ratio of q to u
over all training words, with q from the weights as they were before a step on that window. The model keeps pairs and triples with at least one in NGRAMS of their counts. A last pass scores
every row.

Counts of words can't be sent to every task. Words with at least one in HEAVY of all training tokens can (there are
at most HEAVY of them); the others leave the tasks as rows (word, text, q), meet their counts in a join and come back
as sums. A rare word by definition has few rows, so these joins have no hot key.

Null and empty texts are the end token alone. Null ids are the empty text where rows are split. Repeated rows are
rows of their own. Without training rows nothing is known (N = 0, V = 0). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from plumbline.llm import attention
from plumbline.llm.byte_words import per_text, run_hashes, slices, text_bytes
from plumbline.llm.language_id import crc_part
from plumbline.llm.tokenizing import tokenizer, word_encoder
from plumbline.sources.storage import scratch_path

HEAVY = 1 << 19
PLACES = 1 << 17  # ids that are worked on at once: a few arrays of them stay in the cache
COUNTED = 1 << 21  # ids whose n-grams are counted at once
TABLE = 1 << 21  # keys that a task adds up before it sends them, and how many it sends at once
WORD = 1 << 17  # marks the first id of a word, and the end, in what is written; ids are smaller
SINGLE = 31  # ids with a class of their own
NGRAMS = 1 << 21
PRIOR = 20.0  # how many counts the lower order is worth
DISCOUNT = 0.5
FINE, FAR = 64, 100  # steps of the histogram of ratios for each unit of the logarithm, and where it ends


def spaced_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with one space before every word, starts and ends of these stretches, and their bounds by text."""
    data, at = text_bytes(text)
    raw = data.tobytes()
    lines = [raw[a:b].lower().split() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    joined = np.frombuffer(b"".join(b" " + b" ".join(words) for words in lines if words), np.uint8)
    bounds = np.append(0, np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines))))
    starts = np.flatnonzero(joined == 32)
    return joined, starts, np.append(starts[1:], len(joined)), bounds


class Classes:
    """The class of every id: the end, the most frequent ids, and ranges of equal weight of the rest, by whether they begin a word."""

    def __init__(self, path: str, counts: np.ndarray, classes: int = attention.CLASSES, single: int = SINGLE):
        t = tokenizer(path)
        size = t.get_vocab_size()
        self.end, self.size = size, size + 1
        counts = np.append(counts, np.zeros(size))[:size]
        order = np.argsort(-counts, kind="stable")
        self.of = np.zeros(size + 1, np.int64)
        self.of[order[:single]] = 1 + np.arange(min(single, size))
        begins = np.array([(t.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        rest, each = order[single:], (classes - 1 - single) // 2
        for side in (0, 1):
            own = rest[begins[rest] == bool(side)]
            weight = np.cumsum(counts[own] + 0.1)
            self.of[own] = 1 + single + side * each + np.minimum((weight / weight[-1] * each).astype(np.int64), each - 1)
        self.classes = classes


class Lines:
    """Texts as words and as ids with the end behind each text, from what `encoded` gives."""

    def __init__(self, ids: pa.Array):
        marked, self.id_bounds = id_numbers(ids)
        self.ids = (marked & (WORD - 1)).astype(np.int64)
        self.parts = np.flatnonzero(marked >= WORD)  # first id of each word, and of the end after each text's words
        self.last = np.searchsorted(self.parts, self.id_bounds[1:]) - 1
        self.bounds = np.append(0, self.last - np.arange(len(self.last)))  # words of text k: bounds[k] to bounds[k + 1]

    def hashes(self) -> np.ndarray:
        """A number for each word, told apart by the ids, which spell the word."""
        is_word = self.is_word()
        stops = np.append(self.parts[1:], len(self.ids))
        return run_hashes(self.ids.astype(np.int32).view(np.uint8), 4 * self.parts[is_word], 4 * stops[is_word]).view(np.int64)

    def is_word(self) -> np.ndarray:
        out = np.ones(len(self.parts), bool)
        out[self.last] = False
        return out


def id_numbers(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that the bytes of all texts are, four bytes each, and their bounds by text."""
    ids = ids.cast(pa.large_binary())
    _, offsets, data = ids.buffers()
    at = np.frombuffer(offsets, np.int64)[ids.offset : ids.offset + len(ids) + 1]
    return np.frombuffer(data or b"", np.int32, (at[-1] - at[0]) // 4, at[0]), (at - at[0]) // 4


def encoded(path: str, end: int, text: pa.Array) -> pa.Array:
    """The ids of each text and the end behind them, with WORD on the first of each word and on the end.

    They are bytes, four for each id: Spark copies these as they are, where it would take a list apart.
    """
    joined, starts, ends, bounds = spaced_words(text)
    known = word_encoder(path)
    flat, upto = known.flat(known.rows(joined, starts, ends))
    begins = np.append(0, upto)
    stops = np.cumsum(np.diff(begins[bounds]) + 1)
    ids = np.full(stops[-1] if len(stops) else 0, end, np.int32)
    inside = np.ones(len(ids), bool)
    inside[stops - 1] = False
    ids[inside] = flat
    ids[begins[:-1] + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] |= WORD
    ids[stops - 1] |= WORD
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(4 * np.append(0, stops)), pa.py_buffer(ids)]).cast(pa.binary())


def id_slices(batches: Iterator[pa.RecordBatch], limit: int = PLACES) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of at most `limit` ids; a longer text is a piece of its own."""
    for batch in batches:
        _, at = id_numbers(batch.column("ids"))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def before(ids: np.ndarray, bounds: np.ndarray, end: int) -> np.ndarray:
    """The id before each; the end before the first of a text."""
    out = np.append(end, ids[:-1])[: len(ids)]
    out[bounds[:-1]] = end
    return out


def ngram_keys(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each id with the one before it, as one number, and the same of the place before (-1 at the first of a text)."""
    pairs = before(ids, bounds, end) << 17 | ids
    context = np.append(-1, pairs[:-1])[: len(ids)]
    context[bounds[:-1]] = -1
    return pairs, context


def kinds(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A number from 0 for each distinct pair of two numbers; the second are below 2**17."""
    return pd.factorize(first.astype(np.int64) << 17 | second)[0]


def times(kind: np.ndarray, counted: np.ndarray | None = None) -> np.ndarray:
    """For each place how many have its kind, or how many of those that are `counted`."""
    return np.bincount(kind, counted)[kind] if len(kind) else np.zeros(0)


@dataclass
class NGrams:
    """Counts of pairs and triples of ids, as sorted numbers, and how much of its context's count each order keeps."""

    pairs: np.ndarray
    pair_n: np.ndarray
    triples: np.ndarray
    triple_n: np.ndarray
    id_n: np.ndarray

    def __post_init__(self):
        self.pair_rows, self.triple_rows = HashRows(self.pairs), HashRows(self.triples)
        self.id_kept = np.bincount(self.pairs >> 17, self.pair_n, minlength=len(self.id_n))
        row, hit = find(self.pairs, self.triples >> 17)
        self.pair_kept = np.bincount(row[hit], self.triple_n[hit], minlength=len(self.pairs))

    def sharpened(self, ids: np.ndarray, bounds: np.ndarray, end: int, lowest: np.ndarray, alone: bool = False) -> np.ndarray:
        """Probability of each id, given that by the lowest order; `alone` takes each text's own counts off."""
        if not len(ids):
            return lowest
        pairs, context = ngram_keys(ids, bounds, end)
        row, hit = self.pair_rows.find(pairs)
        last = pairs >> 17
        n = self.pair_n[row] * hit if len(self.pairs) else np.zeros(len(ids))
        total, kept = self.id_n[last], self.id_kept[last]
        if alone:
            own_last = kinds(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), last)
            own_pair = kinds(own_last, ids)
            n, total, kept = n - times(own_pair) * hit, total - times(own_last), kept - times(own_last, hit)
        p = (n + (PRIOR + total - kept) * lowest) / (total + PRIOR)
        if len(self.triples):
            above = np.append(0, row[:-1])  # the pair before is the context
            go = np.flatnonzero((context >= 0) & np.append(False, hit[:-1]) & (self.pair_kept[above] > 0))
            above, total = above[go], n[go - 1]
            row, hit = self.triple_rows.find(context[go] << 17 | ids[go])
            n, kept = self.triple_n[row] * hit, self.pair_kept[above]
            if alone:
                own_context = own_pair[go - 1]
                n, kept = n - times(kinds(own_context, ids[go])) * hit, kept - times(own_context, hit)
            p[go] = (n + (PRIOR + total - kept) * p[go]) / (total + PRIOR)
        return p


class HashRows:
    """Where numbers stand in an array of distinct numbers: a table four times as large, probed in place."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.slots = np.full(1 << int(np.uint64(64) - self.shift), -1, np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), self._start(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            wait = self.slots[at] != todo
            todo, at = todo[wait], (at[wait] + 1) % len(self.slots)

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each number (0 if it is not there), and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = self._start(wanted)
        row = self.slots[at]
        hit = (self.keys[row] == wanted) & (row >= 0)
        todo = np.flatnonzero(~hit & (row >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self.slots)
            there = self.slots[at[todo]]
            found = (self.keys[there] == wanted[todo]) & (there >= 0)
            row[todo[found]], hit[todo[found]] = there[found], True
            todo = todo[~found & (there >= 0)]
        row[~hit] = 0
        return row, hit


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each number among sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    row = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return row, keys[row] == wanted


@dataclass
class Model:
    path: str
    classes: Classes
    weights: dict[str, np.ndarray] | None
    bigram: np.ndarray
    share: np.ndarray  # natural logarithm of each id's share in its class
    ngrams: NGrams | None = None

    def read(self, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
        """log10 of q for each word and for the end of each text."""
        return self.words(lines, attention.score(self.weights, self.bigram, self.classes.of[lines.ids], lines.id_bounds))

    def words(self, lines: Lines, logs: np.ndarray, alone: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The same from the logarithms of the classes' probabilities.

        `alone` takes the n-grams of each text, which must be a training text, out of the counts that it meets.
        """
        places = logs + self.share[lines.ids]
        if self.ngrams:
            places = np.log(self.ngrams.sharpened(lines.ids, lines.id_bounds, self.classes.end, np.exp(places), alone))
        q = np.add.reduceat(places, lines.parts) / np.log(10) if len(places) else places
        return q[lines.is_word()], q[lines.last]


def bigram_logs(counts: np.ndarray) -> np.ndarray:
    """Smoothed log-probabilities of a class after a class."""
    share = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * len(counts))
    return np.log((counts + 10 * share) / (counts.sum(axis=1, keepdims=True) + 10)).astype(np.float32)


def class_pairs(pairs: DataFrame, classes: Classes) -> np.ndarray:
    """Counts of a class after a class, summed from those of pairs of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes.classes**2)
        for batch in batches:
            key, n = (batch.column(c).to_numpy() for c in ("key", "n"))
            total += np.bincount(classes.of[key >> 17] * classes.classes + classes.of[key & (WORD - 1)], n, len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": at.astype(np.int32), "n": total[at]})

    found = pairs.select("key", "n").mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most classes ** 2 rows
    return np.bincount(found.column("at").to_numpy(), found.column("n").to_numpy(), classes.classes**2).reshape(classes.classes, -1)


def frequent(counts: DataFrame, key: str, n: str, most: int = NGRAMS, total: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The keys with at least one in `most` of all counts, which are at most `most` rows, sorted, and their counts."""
    if total is None:
        total = counts.agg(F.sum(n)).first()[0] or 0
    kept = counts.where(F.col(n) * most >= F.lit(total)).select(key, n).toArrow()
    keys, n_ = kept.column(key).to_numpy().astype(np.int64), kept.column(n).to_numpy().astype(np.float64)
    order = np.argsort(keys)
    return keys[order], n_[order]


def mixed_log(usual: np.ndarray | float, q: np.ndarray, weight: float) -> np.ndarray:
    """log10((1 - weight) * usual + weight * 10**q), also where the power is too small for a number."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log((1 - weight) * np.asarray(usual, np.float64)), q * np.log(10) + np.log(weight)) / np.log(10)


def ratio_bins(q: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Where log(q / u) stands in the histogram; q comes as its log10."""
    with np.errstate(divide="ignore"):
        far = np.clip(q * np.log(10) - np.log(u), -FAR, FAR)
    return np.rint(far * FINE).astype(np.int64) + FAR * FINE


def learned(
    rows: DataFrame, model: Model, known_words: DataFrame, often: tuple[np.ndarray, np.ndarray], rare, texts: int, mass: float, places: float, steps: int
) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Attention weights after a pass over the windows of all rows, which have `places` ids, and a histogram of their words.

    Every task starts from the same weights; theirs are averaged by the windows they have seen. There are at most as
    many tasks as have windows for `steps` steps; a task with fewer goes over its windows again. The histogram has
    the logarithms of q / u in steps of 1/FINE, and how many words and ends have each; a text's own words and n-grams
    are taken out of all counts. Words not among `often` (their hashes and counts) meet their counts in a join; `rare`
    is their condition.
    """
    shapes = attention.start(1, model.classes.classes)
    shared = rows.sparkSession.sparkContext.broadcast((model, *often))
    usual = lambda c: np.maximum(c - DISCOUNT, 0) / mass
    names = ["h", "own", "q", "bin", "n", "w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, keys, counts = shared.value
        frequent_words, bins = HashRows(keys), np.zeros(2 * FAR * FINE + 1, np.int64)
        trainer, again = attention.Trainer(model.bigram), []
        for part in id_slices(batches):
            lines = Lines(part.column("ids"))
            found = attention.training_windows(model.classes.of[lines.ids], lines.id_bounds)
            if trainer.steps < steps:
                again.append(found)
            q, q_end = model.words(lines, trainer.learn(*found), alone=True)
            hashes = lines.hashes()
            k, hit = frequent_words.find(hashes)
            of = np.repeat(np.arange(part.num_rows), np.diff(lines.bounds))
            own = times(pd.factorize(of << 40 | pd.factorize(hashes)[0])[0]).astype(np.int64)
            bins += np.bincount(ratio_bins(q[hit], usual(counts[k[hit]] - own[hit])), minlength=len(bins))
            bins += np.bincount(ratio_bins(q_end, usual(np.full(len(q_end), texts - 1.0))), minlength=len(bins))
            rest = np.flatnonzero(~hit)
            none = [pa.nulls(len(rest), t) for t in (pa.int32(), pa.int64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[rest]), pa.array(own[rest].astype(np.int32)), pa.array(q[rest].astype(np.float32)), *none], names=names)
        while again and trainer.steps < steps:
            for found in again:
                trainer.learn(*found, most=steps - trainer.steps)
        if trainer.seen:  # weights have numbers below 0, ratios from 0 on
            flat = np.concatenate([trainer.weights[k].ravel() for k in shapes]).astype(np.float64) * trainer.seen
            at = np.concatenate([-1 - np.arange(len(flat)), np.flatnonzero(bins)])
            n = np.concatenate([np.full(len(flat), trainer.seen), bins[bins > 0]])
            none = [pa.nulls(len(at), t) for t in (pa.int64(), pa.int32(), pa.float32())]
            w = pa.array(np.append(flat, np.zeros(len(at) - len(flat))))
            yield pa.RecordBatch.from_arrays([*none, pa.array(at.astype(np.int32)), pa.array(n.astype(np.int64)), w], names=names)

    tasks = max(1, int(places // (steps * attention.BATCH * attention.WINDOW)))
    made = rows.select("ids").coalesce(tasks).mapInArrow(run, "h long, own int, q float, bin int, n long, w double")
    left = (F.col("c") - F.col("own") - DISCOUNT) / mass
    ratio = F.when(left > 0, F.col("q").cast("double") * float(np.log(10)) - F.log(left)).otherwise(F.lit(float(FAR)))
    placed = (F.rint(F.greatest(F.lit(-float(FAR)), F.least(F.lit(float(FAR)), ratio)) * FINE) + FAR * FINE).cast("int")
    joined = made.join(known_words.where(rare).hint("shuffle_hash"), "h", "left").select(F.coalesce("bin", placed).alias("bin"), F.coalesce("n", F.lit(1)).alias("n"), "w")
    sums = joined.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).orderBy("bin").toArrow()  # the bins and the model's weights
    bin_, n, w = (sums.column(c).to_numpy() for c in ("bin", "n", "w"))
    if not len(bin_):
        return shapes | {"out": np.zeros_like(shapes["out"])}, bin_, n
    flat = (w / n)[bin_ < 0][::-1]
    bounds = np.append(0, np.cumsum([v.size for v in shapes.values()]))
    weights = {k: flat[a:b].reshape(v.shape).astype(np.float32) for (k, v), a, b in zip(shapes.items(), bounds[:-1], bounds[1:])}
    return weights, (bin_[bin_ >= 0] - FAR * FINE) / FINE, n[bin_ >= 0]


def mixture_weight(model: Model, ratios: np.ndarray, n: np.ndarray, rounds: int = 100) -> float:
    """The share b of the `model` beside the word frequencies, by EM over a histogram of the logarithms of q / u."""
    b, r = 0.5, np.exp(ratios)
    for _ in range(rounds if len(n) else 0):
        b = float(np.sum(n * (b * r / ((1 - b) + b * r))) / n.sum())
    return min(max(b, 1e-4), 1 - 1e-4)


def added(keys: np.ndarray, n: np.ndarray, more: np.ndarray, more_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of distinct keys with their counts as one."""
    keys = np.concatenate([keys, more])
    order = np.argsort(keys, kind="stable")  # which only merges what is sorted in two runs
    keys, n = keys[order], np.concatenate([n, more_n])[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def counted(batches: Iterator[pa.RecordBatch], of, limit: int = COUNTED, table: int = TABLE) -> Iterator[pa.RecordBatch]:
    """(kind, key, n) of the keys that `of` gives for Lines, added up over pieces of `limit` ids until a kind has over `table` keys."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sent(kind: int) -> Iterator[pa.RecordBatch]:
        keys, n = held.pop(kind)
        for lo in range(0, len(keys), table):
            own, own_n = keys[lo : lo + table], n[lo : lo + table]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(own), pa.array(own_n.astype(np.int64))], names=["kind", "key", "n"])

    for part in id_slices(batches, limit):
        for kind, found in of(Lines(part.column("ids"))):
            new = np.unique(found, return_counts=True)
            held[kind] = added(*held[kind], *new) if kind in held else new
            if len(held[kind][0]) > table:
                yield from sent(kind)
    for kind in list(held):
        yield from sent(kind)


def corpus_counts(rows: DataFrame, keys) -> DataFrame:
    """(kind, key, n): how often each key stands in all rows, of the kinds that `keys` gives for Lines; stored.

    A task adds keys up in two arrays of bounded length. Spark's own sums before the shuffle would take a table of all
    the task's keys in the executor's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept in (word_encoder, tokenizer):  # texts are encoded by now, and this worker may have done it
            kept.cache_clear()
        yield from counted(batches, keys())

    path = scratch_path(rows.sparkSession, "counts")
    made = rows.select("ids").mapInArrow(run, "kind int, key long, n long").repartition("key")
    made.groupBy("kind", "key").agg(F.sum("n").alias("n")).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def words_and_pairs(rows: DataFrame, end: int) -> tuple[DataFrame, DataFrame]:
    """How often each word (by hash) and each pair of ids stands in all rows."""
    counts = corpus_counts(rows, lambda: lambda lines: ((0, lines.hashes()), (1, ngram_keys(lines.ids, lines.id_bounds, end)[0])))
    return counts.where("kind = 0"), counts.where("kind = 1")


def triples_behind(rows: DataFrame, contexts: np.ndarray, end: int) -> DataFrame:
    """How often each triple of ids behind one of the pairs `contexts` stands in all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(contexts)

    def keys():
        known = HashRows(shared.value)

        def found(lines: Lines):
            _, context = ngram_keys(lines.ids, lines.id_bounds, end)
            at = np.flatnonzero(known.find(context)[1])
            yield 2, context[at] << 17 | lines.ids[at]

        return found

    return corpus_counts(rows, keys)


def ids_of(rows: DataFrame, path: str, end: int) -> DataFrame:
    """(id, held_out, ids) of every row, as `encoded` gives them; stored."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), encoded(path, end, part.column("text"))], names=["id", "held_out", "ids"])

    stored = scratch_path(rows.sparkSession, "ids")
    rows.select("id", "held_out", "text").mapInArrow(run, f"id {kind}, held_out boolean, ids binary").write.option("compression", "zstd").parquet(stored)
    return rows.sparkSession.read.parquet(stored)


def lm_scores(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", parts: int = 10, held: int = 0, heavy: int = HEAVY, steps: int = 500
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10 probabilities."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", crc_part("id", parts) == held)
    end = tokenizer(path).get_vocab_size()
    rows = ids_of(rows, path, end)
    training = rows.where("not held_out")
    words, pairs = words_and_pairs(training, end)

    total, distinct = words.agg(F.sum("n"), F.count("*")).first()
    found = pairs.groupBy(F.col("key").bitwiseAND(WORD - 1).cast("int").alias("id")).agg(F.sum("n").alias("n")).toArrow()  # at most the vocabulary
    id_n = np.bincount(found.column("id").to_numpy(), found.column("n").to_numpy(), end + 1)
    texts = int(id_n[end])
    n_train, n_types = int(total or 0) + texts, distinct + (texts > 0)
    classes = Classes(path, id_n[:end])
    bigram = bigram_logs(class_pairs(pairs, classes))
    ids = id_n + 0.1
    share = np.log(ids / np.bincount(classes.of, ids, minlength=classes.classes)[classes.of])
    most = frequent(pairs, "key", "n")
    ngrams = NGrams(*most, *frequent(triples_behind(training, most[0], end), "key", "n"), id_n)
    model = Model(path, classes, None, bigram, share, ngrams)
    known_words = words.select(F.col("key").alias("h"), F.col("n").alias("c"))
    mass = max(n_train - DISCOUNT * n_types, DISCOUNT)
    usual = lambda c: np.maximum(c - DISCOUNT, 0) / mass
    often, often_c = frequent(known_words, "h", "c", heavy, n_train)
    rare_words = F.col("c") * heavy < n_train
    model.weights, *histogram = learned(training, model, known_words, (often, often_c), rare_words, texts, mass, id_n.sum(), steps)
    weight = mixture_weight(model, *histogram)
    below = n_train + 0.1 * (n_types + 1)
    base = lambda c: np.log10((c + 0.1) / below)
    shared = spark.sparkContext.broadcast((model, often, base(often_c), usual(often_c)))
    end_base, end_usual = float(base(texts)), float(usual(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, keys, logs, shares = shared.value
        frequent_words = HashRows(keys)
        row = TaskContext.get().partitionId() << 36
        for part in id_slices(batches):
            lines = Lines(part.column("ids"))
            q, q_end = model.read(lines)
            hashes, bounds = lines.hashes(), lines.bounds
            k, hit = frequent_words.find(hashes)
            k = k[hit]
            sums, scores = np.zeros(len(hashes)), np.zeros(len(hashes))
            sums[hit], scores[hit] = logs[k], mixed_log(shares[k], q[hit], weight)
            known = per_text(hit, bounds, np.int64) + (texts > 0)
            sums, scores = per_text(sums, bounds) + end_base, per_text(scores, bounds) + mixed_log(end_usual, q_end, weight)
            n, uid = part.num_rows, row + np.arange(part.num_rows)
            row += n
            values = [part.column("id"), part.column("held_out"), pa.array(np.diff(bounds) + 1), pa.array(known), pa.array(sums), pa.array(scores)]
            docs_ = pa.StructArray.from_arrays(values, names=["id", "held_out", "n_tokens", "n_known", "base", "score"])
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(uid), pa.array(np.zeros(n, np.float32)), docs_], names=["uid", "h", "q", "doc"])
            rest = np.flatnonzero(~hit)
            of = np.searchsorted(bounds, rest, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid[of]), pa.array(hashes[rest]), pa.array(q[rest].astype(np.float32)), pa.nulls(len(rest), kind)], names=["uid", "h", "q", "doc"]
            )

    id_type = rows.schema["id"].dataType.simpleString()
    doc = f"struct<id:{id_type},held_out:boolean,n_tokens:long,n_known:long,base:double,score:double>"
    kind = to_arrow_type(StructType.fromDDL(doc[7:-1]))
    made = rows.mapInArrow(run, f"uid long, h long, q float, doc {doc}")
    joined = made.join(known_words.where(rare_words).hint("shuffle_hash"), "h", "left")
    rare, q, seen = F.col("doc").isNull(), F.col("q").cast("double"), F.col("c") > DISCOUNT
    log_base = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / below)
    share_ = (1 - weight) * (F.col("c") - DISCOUNT) / mass
    log_score = F.when(seen, F.log10(share_ + weight * F.pow(F.lit(10.0), q))).otherwise(q + float(np.log10(weight)))
    flat = joined.select(
        "uid", F.col("doc.id").alias("id"), F.col("doc.held_out").cast("int").alias("held"), "doc.n_tokens",
        F.when(rare, F.when(F.col("c") > 0, 1).otherwise(0)).otherwise(F.col("doc.n_known")).alias("n_known"),
        F.when(rare, log_base).otherwise(F.col("doc.base")).alias("base"),
        F.when(rare, log_score).otherwise(F.col("doc.score")).alias("score"),
    )
    sums = flat.groupBy("uid").agg(F.max("id").alias("id"), F.max("held").alias("held"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    return sums.select(
        F.col("id").alias(id_col), (F.col("held") == 1).alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score",
    )
