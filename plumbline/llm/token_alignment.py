"""Cross-tokenizer alignment (operator 12): token ids of two tokenizers, matched where their byte ranges end together.

Both tokenizers run over whole texts (each distinct stretch between safe cuts once a worker). Running sums of token
lengths give the byte offset of every token's end; ends that both have are shared. Anchors are shared ends before which
a space follows in both tokenisations (the next token of each begins with a space), and the ends of texts. Anchors cut
the two id sequences into windows, short pairs of id tuples, and the alignment of a window depends on nothing but its
two tuples, so a worker keeps alignments by them. A window gives groups (ids between shared ends) and links (the last
ids of a group, whose ranges end together).

Links are counted by id pair over the whole corpus. In a pair that ends together one token's bytes end with the
other's, so there are at most as many pairs as the bytes of both vocabularies (times the few ids that share their
bytes), whatever the corpus: the counted table has a bound and is broadcast. Documents and their link counts are
written to the shared folder once, so texts are tokenised once.

Null and empty texts, and texts whose tokens do not spell a space and the text byte for byte (a literal U+2581 for
instance), have no tokens: zeros and an empty string. Rows with null or repeated ids stay rows of their own; repeated
rows count as often as they stand; an empty table gives no rows; other columns are never touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.byte_words import per_text, slices, text_bytes
from plumbline.llm.tokenizing import Encoder, Rows, Stretches, distinct_runs, spaced_stretches, tokenizer
from plumbline.sources.storage import scratch_path

#: Stands for a stretch that the tokens do not spell.
UNSPELT = -1
#: Windows of more ids are aligned where they are met; a worker keeps at most MEMO_BYTES of the others.
MEMO_IDS, MEMO_BYTES = 64, 32 << 20
#: Text that is aligned at once; what is made of it takes about a hundred times as much.
ALIGNED_BYTES = 1 << 20


def byte_level(token: str) -> bytes:
    """The bytes of an entry of a byte-level vocabulary, whose characters stand for one byte each."""
    return bytes(_byte_of()[c] for c in token)


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """Printable Latin-1 characters stand for themselves, the other bytes for the characters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Side:
    """One tokenizer: the bytes of its ids, and the ids of stretches, checked against their bytes."""

    def __init__(self, spelt: list[bytes], encode):
        self.lengths = np.array([len(b) for b in spelt], np.int64)
        self.spaced = np.array([b[:1] == b" " for b in spelt])
        self.names = pa.array([str(i) for i in range(len(spelt))])

        def checked(stretches: list[bytes]) -> list[list[int]]:
            ids = encode([s.decode("utf-8", "replace") for s in stretches])
            return [i if b"".join(map(spelt.__getitem__, i)) == s else [UNSPELT] for i, s in zip(ids, stretches)]

        self.encoder = Encoder(checked)


@lru_cache(maxsize=2)
def byte_side(path: str) -> Side:
    t = tokenizer(path, special_as_text=True)
    entries = {i: token for token, i in t.get_vocab(with_added_tokens=True).items()}
    added = {i: a.content.encode() for i, a in t.get_added_tokens_decoder().items()}
    spelt = [added[i] if i in added else byte_level(entries.get(i, "")) for i in range(max(entries) + 1)]
    return Side(spelt, lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)])


@lru_cache(maxsize=2)
def piece_side(path: str) -> Side:
    """The tokenizer puts a space before what it gets, and every stretch begins with one, which is left out here."""
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=path)
    names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    spelt = [bytes([int(n[3:5], 16)]) if pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    if any(" " in n.replace("▁", " ").lstrip(" ") for n in names):
        raise ValueError("a piece has a space behind another character: texts cannot be cut before spaces")
    alone = [pieces.piece_to_id("▁")]  # a last space by itself; nothing is put before an empty text
    return Side(spelt, lambda texts: [ids if t != " " else alone for t, ids in zip(texts, pieces.encode([t[1:] for t in texts], num_threads=1))])


@dataclass(frozen=True)
class Cuts:
    """Bounds of the groups in both id sequences, and bounds of the windows in the groups."""

    groups_a: np.ndarray
    groups_b: np.ndarray
    windows: np.ndarray


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one range after the other, and the bounds of the ranges among them."""
    upto = np.append(0, np.cumsum(ends - starts))
    return np.arange(upto[-1]) + np.repeat(starts - upto[:-1], ends - starts), upto


def id_tuples(a: np.ndarray, b: np.ndarray, cuts: Cuts) -> tuple[np.ndarray, list[bytes]]:
    """For each window the number of its two id tuples in a list of the distinct ones: a's ids, -1, b's ids, as 32-bit numbers."""
    starts_a, starts_b = cuts.groups_a[cuts.windows], cuts.groups_b[cuts.windows]
    n_a, n_b = np.diff(starts_a), np.diff(starts_b)
    upto = np.append(0, np.cumsum(n_a + n_b + 1))
    packed = np.full(upto[-1], -1, np.int32)
    packed[np.arange(len(a)) + np.repeat(upto[:-1] - starts_a[:-1], n_a)] = a
    packed[np.arange(len(b)) + np.repeat(upto[:-1] + n_a + 1 - starts_b[:-1], n_b)] = b
    data = packed.view(np.uint8)
    return distinct_runs(data, 4 * upto[:-1], 4 * upto[1:])


class Windows:
    """Alignments of windows by their two id tuples."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.links, self.size = Rows(np.int64), 0

    def rows(self, a: np.ndarray, b: np.ndarray, cuts: Cuts) -> np.ndarray:
        """For each window the row of its alignment; valid until the next call."""
        if self.size > MEMO_BYTES:
            self._clear()
        codes, kinds = id_tuples(a, b, cuts)
        example = np.empty(len(kinds), np.int64)
        example[codes[::-1]] = np.arange(len(codes))[::-1]
        memo, out, fresh = self.memo, [], []
        for k, key in enumerate(kinds):
            row = memo.get(key)
            if row is None:
                row = len(self.texts) + len(fresh)
                fresh.append(int(example[k]))
                if len(key) <= 4 * MEMO_IDS:
                    memo[key] = row
            out.append(row)
        self._align(fresh, a, b, cuts)
        return np.array(out, np.int64)[codes]

    def _align(self, fresh: list[int], a: np.ndarray, b: np.ndarray, cuts: Cuts) -> None:
        """Adds the groups (as text) and the links (one number for a pair of ids) of the windows with these numbers."""
        if not fresh:
            return
        k = np.array(fresh)
        groups, per_window = ranges(cuts.windows[k], cuts.windows[k + 1])
        sides, last = [], []
        for ids, ends, names in ((a, cuts.groups_a, self.a.names), (b, cuts.groups_b, self.b.names)):
            at, per_group = ranges(ends[groups], ends[groups + 1])
            sides.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(per_group, pa.int32()), names.take(pa.array(ids[at]))), ","))
            last.append(ids[ends[groups + 1] - 1].astype(np.int64))
        pairs = pc.binary_join_element_wise(*sides, "|")
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(per_window, pa.int32()), pairs), ";").to_pylist()
        self.texts += texts
        self.links.add_flat(last[0] * len(self.b.names) + last[1], np.diff(per_window))
        self.size += sum(map(len, texts)) + 16 * len(groups) + 240 * len(texts)


@lru_cache(maxsize=1)
def known_windows(path_a: str, path_b: str) -> Windows:
    return Windows(byte_side(path_a), piece_side(path_b))


def cuts_of(a: np.ndarray, b: np.ndarray, text_a: np.ndarray, left: Side, right: Side) -> tuple[Cuts, np.ndarray]:
    """Where the two id sequences are cut, and how many windows end up to each text's end.

    `a` and `b` spell the same bytes; `text_a` holds where each text ends in `a`.
    """
    ends_a, ends_b = np.cumsum(left.lengths[a]), np.cumsum(right.lengths[b])
    total = int(ends_a[-1])
    mark, spaced = np.zeros(total + 1, np.uint8), np.zeros(total + 1, np.uint8)
    mark[ends_a] = 1
    mark[ends_b] |= 2
    spaced[ends_a[np.append(left.spaced[a[1:]], True)]] = 1
    spaced[ends_b[np.append(right.spaced[b[1:]], True)]] |= 2
    stops = np.append(0, ends_a)[text_a]
    anchors = (mark == 3) & (spaced == 3)
    anchors[stops[stops > 0]] = True
    shared, anchors = np.flatnonzero(mark == 3), np.flatnonzero(anchors)
    groups = [np.append(0, np.searchsorted(ends, shared) + 1) for ends in (ends_a, ends_b)]
    windows = np.append(0, np.searchsorted(shared, anchors) + 1)
    return Cuts(*groups, windows), np.searchsorted(anchors, stops, "right")


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, with_groups: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, links, times) of every row, and the groups if asked for.

    `links` are the distinct id pairs, a pair as a * (size of b's vocabulary) + b, and `times` how often each is linked.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = [id_col, "n_a", "n_b", "n_groups", "groups_sha256", "links", "times", *["groups"] * with_groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = known_windows(path_a, path_b)
        left, right = windows.a, windows.b
        for part in slices(batches, "text", ALIGNED_BYTES):
            data, at = text_bytes(part.column("text"))
            n = len(at) - 1
            data = np.insert(data, at[:-1], 32)
            starts, ends, bounds = spaced_stretches(data, at + np.arange(n + 1))
            sides, stretches = [], Stretches(data, starts, ends)
            for side in (left, right):
                ids, upto = side.encoder.flat(side.encoder.rows_of(stretches))
                sides.append((ids, np.append(0, upto)[bounds]))
            bad = at[1:] == at[:-1]
            for ids, upto in sides:
                bad |= per_text((ids == UNSPELT).astype(np.int64), upto, "int64") > 0
            counts, kept = [], []
            for ids, upto in sides:
                length = np.where(bad, 0, np.diff(upto))
                kept.append(ids[~np.repeat(bad, np.diff(upto))])
                counts.append(length)
            (a, b), stops = kept, np.cumsum(counts[0])
            n_groups, shas, texts = np.zeros(n, np.int64), [""] * n, [""] * n
            codes, times, of = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(a):
                cuts, upto = cuts_of(a, b, stops, left, right)
                found = windows.rows(a, b, cuts)
                flat, link_ends = windows.links.flat(found)
                link_upto = np.append(0, link_ends)[np.append(0, upto)]
                n_groups = np.diff(link_upto)
                at_window, known = np.append(0, upto).tolist(), windows.texts
                for k in np.flatnonzero(~bad).tolist():
                    text = ";".join([known[r] for r in found[at_window[k] : at_window[k + 1]].tolist()])
                    shas[k] = sha256(text.encode()).hexdigest()
                    if with_groups:
                        texts[k] = text
                of = np.repeat(np.arange(n), n_groups)
                order = np.lexsort((flat, of))
                of, flat = of[order], flat[order]
                first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (flat[1:] != flat[:-1])))
                codes, times, of = flat[first], np.diff(np.append(first, len(flat))), of[first]
            per = pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=n))), pa.int32())
            lists = [pa.ListArray.from_arrays(per, pa.array(values, pa.int64())) for values in (codes, times)]
            columns = [part.column("id"), *map(pa.array, counts), pa.array(n_groups), pa.array(shas, pa.string()), *lists]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_groups, names=names)

    fields = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>, times array<long>"
    return rows.mapInArrow(run, fields + ", groups string" * with_groups)


def pair_counts(aligned: DataFrame, vocabulary: int) -> DataFrame:
    """(link, n, best): how often each id pair is linked in all documents, and whether none of its b id's pairs is more often."""
    counts = aligned.select(F.inline(F.arrays_zip("links", "times"))).groupBy(F.col("links").alias("link")).agg(F.sum("times").alias("n"))
    most = counts.groupBy((F.col("link") % vocabulary).alias("b")).agg(F.max("n").alias("most"))
    return counts.join(most, F.col("link") % vocabulary == F.col("b")).select("link", "n", (F.col("n") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row, and the groups if asked for.

    `path_a` is a byte-level BPE file of the tokenizers library, `path_b` a sentencepiece model.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "aligned")
    aligned_documents(docs, path_a, path_b, id_col, text_col, with_groups).write.parquet(path)
    aligned = spark.read.parquet(path)
    counts = pair_counts(aligned, len(piece_side(path_b).lengths)).toArrow().sort_by("link")  # bounded by the vocabularies
    shared = spark.sparkContext.broadcast(tuple(counts.column(c).to_numpy() for c in ("link", "n", "best")))
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link, n, best = shared.value
        for batch in batches:
            lists, times = batch.column("links"), batch.column("times").flatten().to_numpy()
            upto = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            k = np.searchsorted(link, lists.flatten().to_numpy())
            sums = [per_text(v, upto, "int64") for v in (times, times * best[k], times * n[k])]
            groups = [batch.column("groups")] if with_groups else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (id_col, "n_a", "n_b", "n_groups")), *map(pa.array, sums), batch.column("groups_sha256"), *groups], names=names)

    kind = aligned.schema[id_col].dataType.simpleString()
    fields = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return aligned.mapInArrow(summed, fields + ", groups string" * with_groups)
