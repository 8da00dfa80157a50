"""Toxicity (operator 4): weak supervision.

Voters are cheap rules that may fire on a text:

* lexicon voters: beginnings of words (4 to 8 bytes, which also finds stems) that stand in toxic training texts far
  more often than in others, by the likelihood ratio of their document counts;
* pattern voters written by hand: shouting, exclamation, masked words, second person, one word over and over, and
  the absence of all lexicon voters.

A generative label model explains which voters fire by a hidden class: expectation-maximisation estimates the class
share and how often each voter fires in each class. The given label is one more voter, so wrong labels are outvoted.
Correlations that the class does not explain are estimated too, and a voter counts the less the more it repeats
others. A linear classifier (logistic regression over voter counts) is then trained on the posterior labels, and
gives every whole text its score.

Labels are learned from at most `max_labelled` labelled rows (those with the smallest hash of the id) that are not
held out; their ids travel to the documents in a broadcast of that size. Voters are mined and votes are cast in
tasks; what reaches the driver is one row of votes for each of these rows. Every document is scored.

Null and empty texts have no words and get the score of a text without votes. Null ids are the empty text where
rows are split. An id with several labels is left out of the training; an id with several rows is learned from the one
whose text has the smallest hash, so no id outweighs the others. Without labels of both classes the score is
the share of toxic labels (0.5 without labels). Repeated rows are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.byte_words import ALNUM, LOWER, per_text, slices, text_bytes, word_runs
from plumbline.sources.storage import cut_lineage

MAX_LABELLED = 20_000
VOTERS = 512
LEAST_RATIO = 15.0
PREFIXES = (4, 5, 6, 7, 8)
PATTERNS = ("shouting", "exclamation", "masked", "second person", "one word", "no lexicon voter")
_YOU = np.array(sorted(int.from_bytes(w.ljust(8, b"\0"), "big") for w in (b"you", b"your", b"du", b"dein", b"tu", b"vous", b"usted")), np.uint64)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each word as one number, filled up with zeros."""
    padded = np.append(data, np.zeros(8, np.uint8))
    out = np.zeros(len(starts), np.uint64)
    for k in range(8):
        byte = np.where(starts + k < ends, padded[starts + k], 0).astype(np.uint64)
        out |= byte << np.uint64(56 - 8 * k)
    return out


def _words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, at = text_bytes(text)
    low = LOWER[data]
    starts, ends, bounds = word_runs(low, at, ALNUM)
    return data, at, starts, ends, bounds, word_codes(low, starts, ends)


def _beginnings(codes: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: the words that are long enough, and their beginnings."""
    for n in PREFIXES:
        rows = np.flatnonzero(size >= n)
        yield n, rows, codes[rows] >> np.uint64(64 - 8 * n) << np.uint64(64 - 8 * n)


@dataclass
class Votes:
    """Voters, and the classifier once it is trained."""

    lexicon: dict[int, np.ndarray]  # by length: sorted beginnings
    weights: np.ndarray | None = None
    share: float = 0.5

    @property
    def size(self) -> int:
        return sum(map(len, self.lexicon.values())) + len(PATTERNS)

    def cast(self, text: pa.Array) -> np.ndarray:
        """How strongly each voter fires on each text: log(1 + count) for the lexicon, 0 or 1 for patterns."""
        data, at, starts, ends, bounds, codes = _words(text)
        n = len(at) - 1
        out = np.zeros((n, self.size), np.float32)
        of = np.repeat(np.arange(n), np.diff(bounds))
        first = 0
        for length, rows, keys in _beginnings(codes, ends - starts):
            known = self.lexicon.get(length, np.zeros(0, np.uint64))
            if len(known):
                k = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = np.flatnonzero(known[k] == keys)
                np.add.at(out, (of[rows[hit]], first + k[hit]), 1)
            first += len(known)
        out[:, :first] = np.log1p(out[:, :first])
        count = lambda mask: per_text(mask, at, np.int64)
        small, big = count((data >= 97) & (data <= 122)), count((data >= 65) & (data <= 90))
        words = np.maximum(np.diff(bounds), 1)
        you = per_text(_YOU[np.minimum(np.searchsorted(_YOU, codes), len(_YOU) - 1)] == codes, bounds, np.int64)
        again = np.append(False, codes[1:] == codes[:-1]) if len(codes) else np.zeros(0, bool)
        masked = (data == 35) | (data == 36) | (data == 37) | (data == 38) | (data == 42) | (data == 64)
        for k, mask in enumerate((
            big > small, 10 * count(data == 33) > words, 4 * count(masked) > words, 50 * you > words,
            2 * per_text(again, bounds, np.int64) > words, ~out[:, :first].any(axis=1),
        )):
            out[:, first + k] = mask
        return out

    def score(self, text: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(text), self.share)
        return 1 / (1 + np.exp(-np.clip(self.cast(text) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def mine(rows: DataFrame, voters: int = VOTERS, least_ratio: float = LEAST_RATIO) -> Votes:
    """Lexicon voters from labelled rows (`text`, `toxic`)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            _, _, starts, ends, bounds, codes = _words(part.column("text"))
            toxic = part.column("toxic").to_numpy().astype(bool)
            of = np.repeat(np.arange(len(toxic)), np.diff(bounds))
            for n, rows_, keys in _beginnings(codes, ends - starts):
                pairs = pd.DataFrame({"key": keys.view(np.int64), "of": of[rows_]}).drop_duplicates()
                pairs["pos"] = toxic[pairs["of"]]
                sums = pairs.groupby("key", sort=False)["pos"].agg(["sum", "count"])
                pos = sums["sum"].to_numpy(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(sums), n, np.int32)), pa.array(sums.index.to_numpy(np.int64)), pa.array(pos), pa.array(sums["count"].to_numpy(np.int64) - pos)],
                    names=["n", "key", "pos", "neg"],
                )

    all_pos, all_ = rows.agg(F.sum("toxic"), F.count("*")).first()
    if not all_pos or all_pos == all_:
        return Votes({}, None, (all_pos or 0) / all_ if all_ else 0.5)
    counted = rows.select("text", "toxic").mapInArrow(count, "n int, key long, pos long, neg long")
    counted = counted.groupBy("n", "key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    share = all_pos / all_
    seen = F.col("pos") + F.col("neg")
    part = lambda x, p: F.when(x > 0, x * F.log(x / (seen * p))).otherwise(0.0)
    ratio = 2 * (part(F.col("pos"), share) + part(F.col("neg"), 1 - share))
    best = counted.withColumn("ratio", ratio).where((F.col("ratio") >= least_ratio) & (F.col("pos") > 2 * share * seen))
    kept = best.orderBy(F.desc("ratio"), "n", "key").limit(voters).toArrow().to_pandas()
    lexicon = {n: np.sort(own["key"].to_numpy(np.int64).view(np.uint64)) for n, own in kept.groupby("n")}
    return Votes(lexicon, None, share)


def label_model(fired: np.ndarray, labels: np.ndarray, rounds: int = 25, trust: float = 0.97) -> np.ndarray:
    """Posterior share of class 1 for each row, from voters (0 or 1) and given labels of the accuracy `trust`."""
    votes = fired.astype(np.float32)
    given = np.where(labels > 0, 1, -1) * np.log(trust / (1 - trust))
    posterior = np.where(labels > 0, trust, 1 - trust)
    for _ in range(rounds):
        share = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
        usual = votes.mean(axis=0)
        rate1 = np.clip((posterior @ votes + usual) / (posterior.sum() + 1), 1e-4, 1 - 1e-4)
        rate0 = np.clip(((1 - posterior) @ votes + usual) / ((1 - posterior).sum() + 1), 1e-4, 1 - 1e-4)
        # what is left of each voter once the class is known, and how much of it other voters repeat
        rest = votes - np.outer(posterior, rate1 - rate0).astype(np.float32) - rate0.astype(np.float32)
        together = (rest.T @ rest).astype(np.float64) / len(rest)
        spread = np.sqrt(np.diag(together)) + 1e-9
        correlation = np.abs(together / np.outer(spread, spread))
        weight = 1 / np.maximum(1, (correlation * (correlation > 0.25)).sum(axis=0))
        fires, silent = np.log(rate1) - np.log(rate0), np.log1p(-rate1) - np.log1p(-rate0)
        total = votes @ ((fires - silent) * weight) + silent @ weight + given + np.log(share / (1 - share))
        new = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        change, posterior = np.abs(new - posterior).max(), new
        if change < 1e-4:
            break
    return posterior


def train(strength: np.ndarray, target: np.ndarray, rounds: int = 30, ridge: float = 0.2) -> np.ndarray:
    """Logistic regression with soft targets by Newton steps; the last weight is the intercept."""
    x = np.concatenate([strength, np.ones((len(strength), 1), np.float32)], axis=1).astype(np.float32, copy=False)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - target) + penalty * weights
        curved = x * (p * (1 - p) + 1e-9).astype(np.float32)[:, None]
        step = np.linalg.solve((curved.T @ x).astype(np.float64) + np.diag(penalty), slope)
        weights -= step
        if np.abs(step).max() < 1e-5:
            break
    return weights


def one_row_an_id(rows: DataFrame) -> DataFrame:
    """One of the rows (`id`, `text`, `toxic`) of each id, that whose text has the smallest hash; stored."""
    first = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"))).alias("first")
    return cut_lineage(rows.groupBy("id", "toxic").agg(first).select("id", "first.text", "toxic"))


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Votes:
    """Voters and classifier from documents (`id`, `text`) and labels (`id`, `toxic`)."""
    one = labels.where("id is not null and toxic is not null").groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
    chosen = one.where("toxic = other").select("id", F.col("toxic").cast("int")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    chosen = docs.sparkSession.createDataFrame(chosen.toArrow())  # at most max_labelled ids
    rows = one_row_an_id(docs.join(F.broadcast(chosen), "id"))
    votes = mine(rows)
    if not votes.lexicon:
        return votes
    shared = docs.sparkSession.sparkContext.broadcast(votes)

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            strength = shared.value.cast(part.column("text")).astype(np.float16)
            votes_ = pa.array([s.tobytes() for s in strength], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("toxic"), votes_], names=["id", "toxic", "votes"])

    kind = rows.schema["id"].dataType.simpleString()
    cast_ = rows.mapInArrow(cast, f"id {kind}, toxic int, votes binary").toArrow()  # at most max_labelled rows of votes
    cast_ = cast_.select(["toxic", "votes"]).take(pc.sort_indices(cast_.column("id")))
    strength = np.frombuffer(b"".join(cast_.column("votes").to_pylist()), np.float16).reshape(cast_.num_rows, -1).astype(np.float32)
    target = label_model(strength > 0, cast_.column("toxic").to_numpy())
    votes.weights = train(strength, target)
    return votes


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", parts: int = 5, held: int = 0
) -> DataFrame:
    """(id, held_out, score, predicted) of every row of the documents."""
    part = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))) % parts == held
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic"))
    shared = docs.sparkSession.sparkContext.broadcast(learn(rows, known.where(~part("id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part_ in slices(batches, "text"):
            score = shared.value.score(part_.column("text")).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [part_.column("id"), part_.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    fields = f"`{id_col}` {kind}, held_out boolean, score double, predicted int"
    return rows.select("id", part("id").alias("held_out"), "text").mapInArrow(run, fields)
