"""Language identification (operator 10): prediction by partial matching over bytes.

For every language a tree of byte contexts up to order 3 is counted over all its training texts. A text's code
length under a language is the sum over its bytes of -log2 of the predicted probability: the longest context that has
been seen predicts, and a byte that never followed it costs an escape to the next shorter context, down to 8 bits for a
byte never seen at all (escape probability: distinct followers / (all + distinct followers)). Statistics are frozen,
so every text is scored on its own. The language with the shortest code wins; ties go to the first name.

Bytes are folded first: A-Z lower-cased, all ASCII but letters one space, runs of spaces one. Counting is a grouped
sum over (language, four bytes). Strings of up to three bytes are all in the trees (at most 2^24 a language).
Four-byte strings rarer than 1 in MODEL_ROWS of those of their own language are left out, so a language has at most
MODEL_ROWS of them, whatever the corpus and the other languages; what is left out costs escapes to order 2.

Null texts and texts without a letter are `und` with score 0, as is everything if no row has a language. Null ids
count as the empty text where rows are split by the id's CRC-32. Repeated rows are rows of their own; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.byte_words import LOWER, slices, text_bytes
from plumbline.sources.storage import cut_lineage

MODEL_ROWS = 1 << 20
#: Bits per byte beyond which a text is no text of any learned language: storing its bytes would be shorter.
MOST_BITS = 8.0
_AT_ONCE = 1 << 20

_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_FOLD[0] = 0


def folded(data: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes of the chosen texts, three zero bytes before each, and the n + 1 bounds of the texts."""
    size = at[rows + 1] - at[rows]
    ends = np.cumsum(size)
    take = np.arange(ends[-1] if len(rows) else 0) + np.repeat(at[rows] - (ends - size), size)
    bytes_ = _FOLD[data[take]]
    bytes_[bytes_ == 0] = 32
    new = np.ones(len(bytes_), bool)
    new[1:] = (bytes_[1:] != 32) | (bytes_[:-1] != 32)
    begins = ends - size
    new[begins[size > 0]] = True
    kept = np.append(0, np.cumsum(new))
    size = kept[ends] - kept[begins]
    bytes_ = bytes_[new]
    bounds = np.append(0, np.cumsum(size + 3))
    out = np.zeros(bounds[-1], np.uint8)
    place = np.arange(len(bytes_)) + np.repeat(3 * np.arange(1, len(rows) + 1), size)
    out[place] = bytes_
    return out, bounds


def grams(part: np.ndarray) -> np.ndarray:
    """The four bytes that end at each place from the fourth on, as one number."""
    wide = part.astype(np.uint32)
    return wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows (`lang`, `text`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, at = text_bytes(part.column("text"))
            names = part.column("lang").dictionary_encode()
            of = names.indices.to_numpy()
            for k, name in enumerate(names.dictionary.to_pylist()):
                line, _ = folded(data, at, np.flatnonzero(of == k))
                if len(line) < 4:
                    continue
                found = grams(line)
                found, n = np.unique(found[line[3:] != 0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"]
                )

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Trees:
    """Code lengths of all languages: a row of costs for every seen string, with the escapes it takes in each."""

    languages: list[str]
    keys: dict[int, np.ndarray]  # by length of the string: sorted strings
    costs: dict[int, np.ndarray]  # bits of the string's last byte after the others, by language
    escapes: dict[int, np.ndarray]  # by length of a context: bits to leave it, by language, for the rows of `contexts`
    contexts: dict[int, np.ndarray]

    def bits(self, line: np.ndarray) -> np.ndarray:
        """Code length of each place from the fourth byte on, by language; zero bytes cost nothing."""
        found = grams(line)
        codes = np.zeros((len(found), len(self.languages)), np.float32)
        todo = np.flatnonzero(line[3:] != 0)
        for order in (4, 3, 2, 1):
            if not len(todo):
                break
            own = found[todo] & np.uint32((1 << 8 * order) - 1)
            row, hit = _find(self.keys[order], own)
            codes[todo[hit]] += self.costs[order][row[hit]]
            todo, own = todo[~hit], own[~hit]
            if order > 1:
                row, hit = _find(self.contexts[order - 1], own >> np.uint32(8))
                codes[todo[hit]] += self.escapes[order - 1][row[hit]]
        codes[todo] += self.escapes[0][0] + np.float32(8)
        return codes


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    row = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return row, keys[row] == wanted


def build_trees(
    languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, lower: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
) -> Trees:
    """Trees from the counts n of strings of four bytes by language (an index).

    `lower` has the same of strings of three bytes, for the shorter strings; without it they follow from the four bytes.
    """
    size = len(languages)
    keys, counts, costs, contexts, escapes = {}, {}, {}, {}, {}
    for order in (1, 2, 3, 4):
        lang_, gram_, n_ = (lang, gram, n) if order == 4 or lower is None else lower
        own = gram_ & ((1 << 8 * order) - 1)
        keys[order], at = np.unique(own.astype(np.uint32), return_inverse=True)
        counts[order] = np.zeros((len(keys[order]), size))
        np.add.at(counts[order], (at, lang_), n_)
    for order in (1, 2, 3, 4):  # followers of the contexts that are one byte shorter
        contexts[order - 1], at = np.unique(keys[order] >> np.uint32(8) if order > 1 else np.zeros(len(keys[1]), np.uint32), return_inverse=True)
        total, distinct = (np.zeros((len(contexts[order - 1]), size)) for _ in range(2))
        np.add.at(total, at, counts[order])
        np.add.at(distinct, at, counts[order] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0)  # an unseen context is left for nothing
            known = -np.log2(counts[order] / (total + distinct)[at])
        shorter = np.full(counts[order].shape, 8.0)
        if order > 1:
            row, hit = _find(keys[order - 1], keys[order] & np.uint32((1 << 8 * (order - 1)) - 1))
            shorter = costs[order - 1][row]
        escapes[order - 1] = escape.astype(np.float32)
        costs[order] = np.where(counts[order] > 0, known, escape[at] + shorter).astype(np.float32)
    if not len(keys[1]):
        escapes[0] = np.zeros((1, size), np.float32)
    return Trees(languages, keys, costs, escapes, contexts)


def learn(rows: DataFrame, model_rows: int = MODEL_ROWS) -> Trees:
    """Trees from the rows (`lang`, `text`) whose language is not null."""
    counts = cut_lineage(gram_counts(rows.where("lang is not null and text is not null")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))  # one row a language
    often = counts.join(F.broadcast(totals), "lang").where(F.col("n") * model_rows >= F.col("total"))
    kept = often.select("lang", "gram", "n").toArrow().to_pandas()  # at most model_rows rows a language
    short = F.col("gram").bitwiseAND((1 << 24) - 1).alias("gram")
    lower = counts.groupBy("lang", short).agg(F.sum("n").alias("n")).toArrow().to_pandas()  # at most 2^24 rows a language
    languages = sorted(lower["lang"].unique())
    index = {name: k for k, name in enumerate(languages)}
    four, three = (
        (t["lang"].map(index).to_numpy(np.int64), t["gram"].to_numpy(np.int64), t["n"].to_numpy(np.float64)) for t in (kept, lower)
    )
    return build_trees(languages, *four, three)


def code_lengths(trees: Trees, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text its code length in every language, and the number of coded bytes."""
    line, bounds = folded(data, at, np.arange(len(at) - 1))
    out = np.zeros((len(at) - 1, len(trees.languages)))
    for lo in range(3, len(line), _AT_ONCE):
        bits = trees.bits(line[lo - 3 : lo + _AT_ONCE])
        first = int(np.searchsorted(bounds, lo, "right")) - 1
        last = int(np.searchsorted(bounds, lo + len(bits), "left"))
        own = np.clip(bounds[first : last + 1] - lo, 0, len(bits))
        full = np.flatnonzero(own[1:] > own[:-1])
        out[first + full] += np.add.reduceat(bits, own[full], axis=0, dtype=np.float64)
    return out, bounds[1:] - bounds[:-1] - 3


def has_letter(data: np.ndarray, at: np.ndarray, texts: pa.Array) -> np.ndarray:
    letters = np.append(0, np.cumsum((LOWER[data] >= 97) & (LOWER[data] <= 122)))
    found = letters[at[1:]] > letters[at[:-1]]
    wide = np.append(0, np.cumsum(data >= 128))
    for k in np.flatnonzero(~found & (wide[at[1:]] > wide[at[:-1]])):
        found[k] = any(c.isalpha() for c in texts[int(k)].as_py())
    return found


def judge(trees: Trees, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits per byte of each text."""
    data, at = text_bytes(texts)
    known = has_letter(data, at, texts) & bool(trees.languages)
    if not trees.languages:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    bits, size = code_lengths(trees, data, at)
    best = bits.argmin(axis=1)
    least = bits[np.arange(len(best)), best]
    # the usual posterior of code lengths, tempered: neighbouring bytes are not independent evidence
    share = np.exp2(-(bits - least[:, None]) / np.sqrt(np.maximum(size, 1))[:, None])
    score = np.where(known, 1 / share.sum(axis=1), 0.0)
    return [trees.languages[b] if k else "und" for b, k in zip(best, known)], score, least / np.maximum(size, 1)


def crc_part(id_col: str, parts: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, held: int = 2) -> DataFrame:
    """(id, held_out, lang_pred, score, bits_per_byte) of every row, learned from the rows that are not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    held_out = (crc_part("id", parts) == held).alias("held_out")
    shared = docs.sparkSession.sparkContext.broadcast(learn(rows.where(~held_out)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            name, score, bits = judge(shared.value, part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("held_out"), pa.array(name, pa.string()), pa.array(score), pa.array(bits)],
                names=[id_col, "held_out", "lang_pred", "score", "bits_per_byte"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    fields = f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, bits_per_byte double"
    return rows.select("id", held_out, "text").mapInArrow(run, fields)


def known_languages_only(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_bits: float = MOST_BITS
) -> DataFrame:
    """The documents without those that are `und` or cost more than `most_bits` per byte in every language."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    trees = learn(rows)
    if not trees.languages:
        return docs  # no language to know: nothing is rejected
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            name, _, bits = judge(shared.value, part.column(text_col))
            yield part.filter(pa.array((np.array(name) != "und") & (bits <= most_bits)))

    return docs.mapInArrow(run, docs.schema)
