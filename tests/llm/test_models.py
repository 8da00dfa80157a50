"""Trained operators: toxicity and LM scores."""

from __future__ import annotations

import math
import random
import tracemalloc
from collections import Counter

import awkward as rows_of
import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import attention, byte_words, lm_scores, queries, reachable, tokenizing, toxicity

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(autouse=True)
def _reachable(spark):
    reachable(spark)


@pytest.fixture(scope="module", params=["awkward", "small", "empty"])
def docs(request, spark):
    if request.param == "small":
        return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = rows_of.awkward_rows() if request.param == "awkward" else []
    return spark.createDataFrame(rows, rows_of.SCHEMA).repartition(3)


def pairs(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


# ---- toxicity ------------------------------------------------------------------------------------


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("known", [[], [(1, 1, 1), (1, 1, 0), (None, 0, 1), (2, 1, None), (3, 0, 0)], [(k, 0, k % 2) for k in range(40)]])
def test_toxicity_of_awkward_rows(docs, spark, known):
    got = [tuple(r) for r in toxicity.toxicity(docs, labels(spark, known)).collect()]
    assert Counter((g[0], g[1]) for g in got) == Counter((d, brute.crc_part(d, 5) == 0) for d, _ in pairs(docs))
    assert all(0 <= g[2] <= 1 and g[3] == (g[2] >= 0.5) for g in got)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.score, truth[r.doc_id]) for r in queries.toxicity(spark, sf).where("held_out").collect() if r.doc_id in truth]
    pos, neg = ([s for s, y in rows if y == k] for k in (1, 0))
    assert np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) > 0.9
    assert np.mean([(s >= 0.5) == y for s, y in rows]) > 0.95


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    sf = "/root/testdata/sf0.01"
    docs, known = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = known.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")})
    a, b = (sorted(map(tuple, toxicity.toxicity(d, k).collect())) for d, k in ((docs, known), (other, changed)))
    assert a == b


def test_rows_of_a_repeated_id_are_learned_once(spark, monkeypatch):
    rows = [(k, f"you are an idiot and this is text {k}" if k % 4 == 1 else f"a friendly text about the number {k}") for k in range(40)]
    known = labels(spark, [(k, 0, int(k % 4 == 1)) for k in range(40)]).select(F.col("doc_id").alias("id"), "toxic")
    seen, label_model = [], toxicity.label_model
    monkeypatch.setattr(toxicity, "label_model", lambda fired, given: seen.append(given) or label_model(fired, given))

    def weights(rows):
        return toxicity.learn(spark.createDataFrame(rows, "id long, text string").repartition(3), known).weights

    once, copies = weights(rows), weights(rows + rows[1:2] * 500)
    weights(rows + [(1, f"another text {k} under that id") for k in range(500)])
    assert [len(given) for given in seen] == [40, 40, 40] and all(given.sum() == 10 for given in seen)
    assert np.array_equal(once, copies)


def test_label_model_outvotes_wrong_labels():
    rng = np.random.default_rng(0)
    truth = rng.random(2000) < 0.2
    fired = np.stack([np.where(truth, rng.random(2000) < 0.8, rng.random(2000) < 0.05) for _ in range(6)], axis=1)
    fired = np.concatenate([fired, fired[:, :1], fired[:, :1]], axis=1)  # two voters repeat the first
    given = truth ^ (rng.random(2000) < 0.03)
    posterior = toxicity.label_model(fired, given.astype(int))
    assert ((posterior > 0.5) == truth).mean() > (given == truth).mean()


def test_word_codes():
    text = "idiot stupidity é a".encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends = np.array([0, 6, 16, 19]), np.array([5, 15, 18, 20])
    codes = [int(c).to_bytes(8, "big").rstrip(b"\0") for c in toxicity.word_codes(data, starts, ends)]
    assert codes == [b"idiot", b"stupidit", "é".encode(), b"a"]


# ---- LM scores -----------------------------------------------------------------------------------


def test_base_scores(docs, spark, monkeypatch):
    rows = pairs(docs)
    words = [(d, brute.graphic_words(t)) for d, t in rows]
    training = [w for d, w in words if brute.crc_part(d, 10) != 0]
    counts = Counter(x for w in training for x in w)
    ends = len(training)
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    want = []
    for d, w in words:
        c = [counts[x] for x in w] + [ends]
        base = sum(math.log10((k + 0.1) / (n + 0.1 * (v + 1))) for k in c)
        want.append((d, brute.crc_part(d, 10) == 0, len(c), sum(k > 0 for k in c), n, round(base, 5)))
    scores = []
    for heavy in (1 << 19, 50):  # all counts sent to the tasks, or most of them joined
        got = lm_scores.lm_scores(docs, BYTE_BPE, heavy=heavy, steps=20).collect()
        assert Counter((*tuple(r)[:5], round(r.base_score, 5)) for r in got) == Counter(want)
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
        scores.append(sorted(round(r.score, 2) for r in got))
    assert np.allclose(*scores, atol=0.05, rtol=1e-4)


def test_gradients():
    rng = np.random.default_rng(0)
    m = {k: w.astype(np.float64) for k, w in attention.start(0, 7, 4).items()}
    bigram, x, y = rng.standard_normal((7, 7)), rng.integers(0, 7, (3, attention.WINDOW)), rng.integers(0, 7, (3, attention.WINDOW))
    weight = (rng.random(x.shape) < 0.7).astype(float)
    _, grads = attention.loss_and_gradients(m, bigram, x, y, weight)
    for k in m:
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in m[k].shape)
            old, found = m[k][at], []
            for step in (1e-4, -1e-4):
                m[k][at] = old + step
                found.append(attention.loss_and_gradients(m, bigram, x, y, weight)[0])
            m[k][at] = old
            assert np.isclose((found[0] - found[1]) / 2e-4, grads[k][at], atol=1e-5, rtol=1e-2), k


def test_windows_score_every_place_once_and_look_back_only():
    rng = np.random.default_rng(1)
    bounds = np.array([0, 1, 1, 40, 41 + attention.STEP, 150])
    classes = rng.integers(0, attention.CLASSES, 150)
    _, target, _ = attention.windows(classes, bounds)
    assert sorted(target[target >= 0]) == list(range(150))
    m, bigram = attention.start(3), np.zeros((attention.CLASSES, attention.CLASSES), np.float32)
    whole = attention.score(m, bigram, classes, bounds)
    changed = classes.copy()
    changed[120:] = rng.integers(0, attention.CLASSES, 30)
    assert np.allclose(attention.score(m, bigram, changed, bounds)[:120], whole[:120])
    alone = attention.score(m, bigram, classes[1:40], np.array([0, 39]))
    assert np.allclose(alone, whole[1:40], atol=1e-5)  # a text's score does not depend on the batch


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    m, bigram = attention.start(4), rng.standard_normal((attention.CLASSES, attention.CLASSES)).astype(np.float32)
    x = rng.integers(0, attention.CLASSES, (5, attention.WINDOW))
    assert np.allclose(np.exp(attention.log_probabilities(m, bigram, x)).sum(axis=-1), 1, atol=1e-5)
    ids, size = rng.integers(0, 12, 4000), 13
    bounds = np.array([0, 2000, 4000])
    pairs_, context = lm_scores.ngram_keys(ids, bounds, 12)
    two, n2 = np.unique(pairs_, return_counts=True)
    keep = n2 > 20
    three, n3 = np.unique(context[context >= 0] << 17 | ids[context >= 0], return_counts=True)
    known = np.isin(three >> 17, two[keep]) & (n3 > 2)
    id_n = np.bincount(ids, minlength=size).astype(float)
    id_n[12] = 2
    grams = lm_scores.NGrams(two[keep], n2[keep].astype(float), three[known], n3[known].astype(float), id_n)
    for a, b in ((3, 4), (12, 5), (0, 0)):
        total = 0.0
        for c in range(size):
            line = np.array([a, b, c])
            total += grams.sharpened(line, np.array([0, 3]), 12, np.full(3, 1 / size))[2]
        assert np.isclose(total, 1)


def test_own_ngrams_are_taken_off():
    """A training text scored alone gets what the counts of all other texts give."""
    rng = np.random.default_rng(7)
    ids, bounds, end = rng.integers(0, 6, 300), np.array([0, 90, 90, 200, 300]), 6
    ids[bounds[1:] - 1] = end
    two, context = lm_scores.ngram_keys(ids, bounds, end)
    three = context << 17 | ids
    pairs_, triples = np.unique(two)[::2], np.unique(three[context >= 0])[::3]
    of = np.repeat(np.arange(4), np.diff(bounds))
    lowest = rng.random(300)

    def grams(rows):
        count = lambda keys, found: np.array([(found[rows] == k).sum() for k in keys], float)
        return lm_scores.NGrams(pairs_, count(pairs_, two), triples, count(triples, three), np.bincount(ids[rows], minlength=7).astype(float))

    got = grams(of >= 0).sharpened(ids, bounds, end, lowest, alone=True)
    for k in (0, 2, 3):
        own = of == k
        want = grams(~own).sharpened(ids[own], np.array([0, own.sum()]), end, lowest[own])
        assert np.allclose(got[own], want)


def test_ngrams_are_counted_over_all_training_rows(spark, monkeypatch):
    """Also where the sample is all there is, and where one text has many copies."""
    seen, weight = [], lm_scores.mixture_weight
    monkeypatch.setattr(lm_scores, "mixture_weight", lambda model, *rest: seen.append(model.ngrams) or weight(model, *rest))
    rows = [(k, "one text with very many copies of itself" if k % 3 else f"the text of number {k}") for k in range(90)]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        lm_scores.lm_scores(docs, BYTE_BPE, steps=5)
        assert seen[-1].pair_n.sum() == seen[-1].id_n.sum() > 0 and len(seen[-1].triples)


def test_scores_are_better_than_the_base_of_a_text_that_repeats_itself(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    rows = [(k, " ".join(w + " " + w for w in rng.choice(words, 120))) for k in range(150)]
    got = lm_scores.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), BYTE_BPE).where("held_out").collect()
    assert got and np.mean([r.score > r.base_score for r in got]) > 0.9


def test_everything_is_learned_from_long_texts_too(spark, monkeypatch):
    """Rows of more than 128 KB are training rows like any other: classes, weights, contexts of triples and the mixture."""
    seen, weight = [], lm_scores.mixture_weight
    monkeypatch.setattr(lm_scores, "mixture_weight", lambda model, *rest: seen.append((model, *rest)) or weight(model, *rest))
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(rng.choice(["red", "green", "blue", "yellow"], 30_000))) for k in (1, 2, 3)]
    lm_scores.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), BYTE_BPE, steps=20)
    model, _, n = seen[0]
    assert model.weights["out"].any() and (model.classes.of > 0).any() and len(model.ngrams.triples) >= 4**3
    training = [t for k, t in rows if brute.crc_part(k, 10) != 0]
    assert n.sum() == sum(len(t.split()) + 1 for t in training)  # the mixture weight is fitted on every word and end


def test_training_takes_every_place_once():
    rng = np.random.default_rng(9)
    bounds, classes = np.array([0, 1, 1, 40, 3000]), rng.integers(0, 8, 3000)
    x, target, y = attention.training_windows(classes, bounds)
    assert sorted(target[target >= 0]) == list(range(3000)) and (y[target >= 0] == classes[target[target >= 0]]).all()
    flat = np.log(np.full((8, 8), 1 / 8)).astype(np.float32)
    trainer = attention.Trainer(flat)
    first = trainer.learn(x, target, y)
    assert first.shape == (3000,) and trainer.seen == len(x) and trainer.steps == -(-len(x) // attention.BATCH)
    same = attention.Trainer(flat).learn(x, target, y, most=1)
    assert np.array_equal(same[same != 0], first[same != 0]) and (same != 0).sum() < 3000


def test_training_steps_keep_their_arrays():
    """New arrays in every step (3.4 MB at once before) have to be mapped and cleared by the system each time."""
    rng = np.random.default_rng(10)
    classes, bounds = rng.integers(0, attention.CLASSES, 40 * attention.BATCH * attention.WINDOW), np.arange(41) * attention.BATCH * attention.WINDOW
    trainer = attention.Trainer(np.zeros((attention.CLASSES, attention.CLASSES), np.float32))
    found = attention.training_windows(classes, bounds)
    trainer.learn(*found, most=1)
    one = [part[: attention.BATCH] for part in found]
    tracemalloc.start()
    trainer.learn(*one, most=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 20


def test_training_steps_use_their_arrays_again():
    """The arrays of a step took 3.8 MB before, several times a core's cache."""
    rng = np.random.default_rng(11)
    classes, bounds = rng.integers(0, attention.CLASSES, 2 * attention.BATCH * attention.WINDOW), np.arange(3) * attention.BATCH * attention.WINDOW
    trainer = attention.Trainer(np.zeros((attention.CLASSES, attention.CLASSES), np.float32))
    trainer.learn(*attention.training_windows(classes, bounds))
    assert sum(a.nbytes for a in trainer.room.kept.values()) < 2 << 20


@pytest.mark.parametrize("scale", [1, 30])
def test_large_weights_stay_finite(scale):
    """Scores and logits that have to be clipped, in training and in scoring."""
    rng = np.random.default_rng(12)
    m = {k: w * scale for k, w in attention.start(6).items()}
    x, y = (rng.integers(0, attention.CLASSES, (40, attention.WINDOW)) for _ in range(2))
    bigram = np.zeros((attention.CLASSES, attention.CLASSES), np.float32)
    logs, grads = attention.logs_and_gradients(m, bigram, x, y, np.ones(x.shape))
    assert np.isfinite(logs).all() and (logs <= 1e-4).all() and all(np.isfinite(g).all() for g in grads.values())
    assert np.isfinite(attention.score(m, bigram, x.ravel(), np.array([0, 1, x.size]))).all()


@pytest.mark.parametrize("table", [1, 50, 1 << 20])
def test_a_task_adds_up_counts_over_its_pieces(table):
    """Every piece sent its own counts before."""
    rng = np.random.default_rng(13)
    texts = [np.append(rng.integers(0, 9, rng.integers(0, 60)), 9 | lm_scores.WORD).astype(np.int32) for _ in range(200)]
    ids = pa.array([t.tobytes() for t in texts], pa.binary())
    batches = [pa.RecordBatch.from_arrays([part], names=["ids"]) for part in (ids[:70], ids[70:])]
    of = lambda lines: ((3, lines.ids), (4, lm_scores.ngram_keys(lines.ids, lines.id_bounds, 9)[0]))
    sent = [(k, key, n) for b in lm_scores.counted(iter(batches), of, 100, table) for k, key, n in zip(*(c.to_pylist() for c in b.columns))]
    got = Counter()
    for kind, key, n in sent:
        got[kind, key] += n
    whole = lm_scores.Lines(ids)
    assert got == Counter((k, key) for k, found in of(whole) for key in found.tolist())
    assert (len(sent) == len(got)) == (table > 100)


def test_many_words_are_encoded_as_one_text():
    wide = ["\u3000word", "word\u00a0", "a\u2028b", "\u0085", "日本語", "déjà", "“quoted”"]
    words = [*wide, "plain", "it's", "s", "'s", "x<|endoftext|>y", "<|endoftext|>", "12,5", "\x1c", "\x00a", "Ġodd", "🙂", "naïve"]
    rng = random.Random(4)
    stretches = [f" {rng.choice(words)}{rng.choice(['', rng.choice(words)])}".encode() for _ in range(3_000)] + [b" \xff\xc3", b" \xe2\x80"]
    rng.shuffle(stretches)
    one_by_one = tokenizing.encoder(BYTE_BPE).encode(stretches)
    assert tokenizing.word_encoder(BYTE_BPE).encode(stretches) == one_by_one
    assert tokenizing.word_encoder(BYTE_BPE).encode([]) == [] and tokenizing.word_encoder(BYTE_BPE).encode([b" <|endoftext|>"]) == tokenizing.encoder(BYTE_BPE).encode([b" <|endoftext|>"])


def test_scoring_gives_what_training_sees():
    rng = np.random.default_rng(6)
    m, x = attention.start(5), rng.integers(0, attention.CLASSES, (9, attention.WINDOW))
    whole = attention.hidden(m, x)[-1][:, attention.WINDOW - attention.STEP :]
    assert np.allclose(attention.scored_states(m, x), whole.reshape(-1, whole.shape[-1]), atol=1e-4)


@pytest.mark.parametrize("n", [0, 1, 5, 5000])
def test_hash_rows(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(-(2**60), 2**60, n)) if n < 5000 else np.unique(np.concatenate([np.arange(2500), rng.integers(0, 2**51, 2500)]))
    table = lm_scores.HashRows(keys)
    wanted = np.concatenate([keys, rng.integers(0, 5000, 4000), rng.integers(0, 2**51, 1000)])
    rows, hit = table.find(wanted)
    assert (hit == np.isin(wanted, keys)).all() and (keys[rows[hit]] == wanted[hit]).all() and not rows[~hit].any()


def test_ids_travel_as_bytes(spark):
    texts = ["", "one", "Two words,  and more\nlines", "caf\u00e9 \u2460 <|endoftext|>", None, "a" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("held_out"))
    t = tokenizing.tokenizer(BYTE_BPE)
    end = t.get_vocab_size()
    stored = lm_scores.ids_of(docs, BYTE_BPE, end)
    assert stored.schema["ids"].dataType.simpleString() == "binary"
    got = {r.id: np.frombuffer(r.ids, np.int32) & (lm_scores.WORD - 1) for r in stored.collect()}
    for k, text in enumerate(texts):
        words = (text or "").lower().split()
        assert got[k].tolist() == [i for w in words for i in t.encode(" " + w, add_special_tokens=False).ids] + [end]
    column = stored.orderBy("id").select("ids").toArrow().column("ids").combine_chunks()
    ids, bounds = lm_scores.id_numbers(column.slice(1, 3))
    assert [(part & (lm_scores.WORD - 1)).tolist() for part in np.split(ids, bounds[1:-1])] == [got[k].tolist() for k in (1, 2, 3)]


def test_hashing_takes_little_memory_at_once():
    data = np.full(byte_words.SLICE_BYTES, 97, np.uint8)
    starts = np.arange(0, len(data), 32)
    byte_words.run_hashes(data[:64], starts[:2], starts[:2] + 31)
    tracemalloc.start()
    hashes = byte_words.run_hashes(data, starts, starts + 31)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(hashes.tolist())) == 1 and peak < 16 << 20
