"""Every operator against a plain version of it, on awkward rows and on the test tables."""

from __future__ import annotations

import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import awkward as rows_of
import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import reachable
from plumbline.llm import byte_words, decontamination, fingerprints, language_id, line_dedup, packing, queries, sharding, simhash, token_counts

SMALL = "/root/testdata/sf0.001"
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(autouse=True)
def _reachable(spark):
    reachable(spark)


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(rows_of.awkward_rows(), rows_of.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], rows_of.SCHEMA)


def pairs(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module", params=["awkward", "small", "empty"])
def docs(request, spark):
    if request.param == "small":
        return spark.read.parquet(f"{SMALL}/documents.parquet")
    return request.getfixturevalue("awkward" if request.param == "awkward" else "nothing")


def test_fingerprints(docs):
    got = [tuple(r) for r in fingerprints.edited_fingerprints(docs).collect()]
    want = brute.edited(pairs(docs))
    assert Counter(r[:3] for r in got) == Counter(r[:3] for r in want)
    texts = {(d, n, s): (t, e) for d, n, s, t, e, _ in want}
    by_text = defaultdict(set)
    for d, n, s, own, new, near, near_next in got:
        by_text[texts[d, n, s][0]].add(own)
        by_text[texts[d, n, s][1]].add(new)
        assert 0 <= near <= 1 and 0 <= near_next <= 1
    assert all(len(v) == 1 for v in by_text.values())
    same = defaultdict(set)  # the fingerprint is that of a multiset of lines
    for text, found in by_text.items():
        same[next(iter(found))].add(tuple(sorted(text.split("\n"))))
    assert all(len(v) == 1 for v in same.values())


def test_fingerprints_are_sums(spark):
    rows = [(1, "a b c\nd e f g"), (2, "d e f g\na b c"), (3, "a b c"), (4, "d e f g"), (5, "d e f g\na b c\nx")]
    lanes = {r["doc_id"]: list(r["lanes"]) for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert lanes[1] == lanes[2] != lanes[5]
    assert lanes[1] == [(a + b) % 2**32 for a, b in zip(lanes[3], lanes[4])]
    both = spark.createDataFrame([(lanes[1], lanes[4])], "a array<long>, b array<long>")
    assert both.select(fingerprints.combined("a", "b", -1)).first()[0] == lanes[3]


def test_likeness_tells_edited_texts_from_others(spark):
    rows = queries.fingerprints(spark, SMALL).where("n_chars > 400").collect()
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.95
    assert np.mean([r.near_edited for r in rows]) > 0.4 and np.mean([r.near_next for r in rows]) < 0.15


def test_sharding(docs):
    got = [r.asDict() for r in sharding.shards(docs, 8).collect()]
    n = len(got)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in pairs(docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sorted(r["row_number"] for r in got) == sorted(r["position"] for r in got) == list(range(n))
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - n / 8) < 1
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["row_number"])]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_bijection(n):
    place = sharding.permute(np.arange(n), n, 7)
    assert sorted(place) == list(range(n))
    assert n < 64 or abs(np.corrcoef(np.arange(n), place)[0, 1]) < 0.5


ITEMS = [
    (1, "lorem ipsum dolor sit amet"), (2, None), (3, ""), (4, "?!"), (None, "the of"), (5, "This line of some twenty words repeats in several of the documents and has"),
    (6, "THE cat"), (6, "cat sat"), (7, "x1 x1"), (8, "été"), (9, "This line of some twenty words repeats in several of the documents and has to be taken out of all but one today"),
]


def check_contamination(docs, items, spark):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long"), F.sha2(F.array_join(F.sort_array("items"), ","), 256), decontamination.contaminated()
    )
    want = Counter(brute.contamination(pairs(docs), items))
    assert Counter(tuple(r) for r in got.collect()) == want
    kept = decontamination.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({d: n for d, n in Counter(r[0] for r in want.elements() if not r[5]).items()})


def test_contamination(docs, spark, monkeypatch):
    check_contamination(docs, ITEMS, spark)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 60)  # several blocks
    check_contamination(docs, ITEMS, spark)


def test_contamination_of_test_tables(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    check_contamination(docs, [tuple(r) for r in bench.collect()], spark)


def test_empty_benchmark(awkward, spark):
    found = decontamination.contamination(awkward, spark.createDataFrame([], "item_id long, text string"))
    assert found.count() == awkward.count() and found.where("n_hit > 0").isEmpty()


@pytest.mark.parametrize("seed", range(4))
def test_fm_index(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, 4, 400)
    text[100:300] = text[np.arange(200) % 7]
    index = decontamination.FMIndex(text, 4)
    assert index.locate(np.arange(len(text) + 1)).tolist() == sorted(range(len(text) + 1), key=lambda k: text[k:].tolist())
    for n in (1, 2, 5):
        phrases = rng.integers(1, 4, (20, n))
        lo, hi = index.search(phrases, np.full(20, n))
        for p, a, b in zip(phrases, lo, hi):
            there = [k for k in range(len(text) - n + 1) if (text[k : k + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == there


def check_passages(docs):
    rows = pairs(docs)
    texts = Counter(d for d, _ in set(rows))
    place = lambda r: (*r[:5], r[5] if texts[r[4]] == 1 else "in one of its texts")
    got = Counter(place(tuple(r)) for r in line_dedup.repeated_spans(docs).select("doc_id", "start", "length", "n_passages", "kept_doc_id", "kept_start").collect())
    runs = brute.repeated_runs(rows)
    assert got == Counter(place((d, *run)) for (d, _), found in runs.items() for run in found)
    kept = line_dedup.repeats_removed(docs)
    assert kept.columns == docs.columns
    assert Counter(pairs(kept)) == Counter((d, line_dedup.without_spans(t, [r[:2] for r in runs[d, t]])) for d, t in rows)
    return runs


def test_passages(docs):
    check_passages(docs)


def passage_rows(rng, n):
    """Texts of their own words, wrapped anywhere, in which passages stand: one in a third of them, some in two, one twice."""
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) + rng.choice(["", "", ".", ","])
    prose = lambda k: [word() for _ in range(k)]
    hot, shared = prose(70), [prose(rng.choice([20, 60, 90])) for _ in range(12)]
    rows = []
    for k in range(n):
        words = prose(rng.randint(0, 60))
        for passage in [hot] * (k % 3 == 0) + [rng.choice(shared)] * rng.choice([0, 0, 1, 2]):
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() if k % 5 == 0 else w for w in passage]
        rows.append((rng.choice([k, k, k, None, 7]), "".join(w + rng.choice([" "] * 9 + ["\n", "  ", "\t"]) for w in words)))
    return rows


@pytest.mark.parametrize("way", ["as it is", "full filters", "hot and joined"])
def test_planted_passages(spark, monkeypatch, way):
    rng = random.Random(7)
    rows = passage_rows(rng, 150)
    rows += [rows[3]] * 40
    if way == "full filters":
        monkeypatch.setattr(line_dedup, "MIN_BITS", 64)
        monkeypatch.setattr(line_dedup, "MAX_BITS", 128)
    if way == "hot and joined":
        monkeypatch.setattr(line_dedup, "HOT_KEYS", 10)
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    runs = check_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sum(map(len, runs.values())) > 40


def test_passages_are_cut_out():
    assert line_dedup.without_spans("a\nb\nc", [(4, 1)]) == "a\nb\n" and line_dedup.without_spans("a\nb\nc", [(0, 1), (2, 1)]) == "c"
    assert line_dedup.without_spans("one two three", [(4, 3)]) == "one three" and line_dedup.without_spans(None, [(0, 1)]) is None


def test_a_repeated_row_lists_its_passages_once(spark):
    text = " ".join(f"word{k}" for k in range(200))
    rows = [(1, text)] + [(2, text + " more")] * 300
    spans = line_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert [(r.doc_id, r.start, r.kept_doc_id) for r in spans] == [(2, 0, 1)]


def test_runs_of_passages_are_no_lists(spark):
    """Lists of passages are objects of the JVM; the executor with both workers then took more than its 3000 MB."""
    docs = spark.createDataFrame([(1, "a " * 40), (2, "a " * 40)], "doc_id long, text string")
    plan = line_dedup.repeated_spans(docs)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "collect_" not in plan and "Window" in plan


def test_passages_are_found_in_small_pieces():
    """A worker's arrays are some fifty times what it cuts at once (two MB before, 230 MB of memory)."""
    text = pa.array([" ".join(f"word{k}" for k in range(j, j + 300)) for j in range(2_000)])
    parts = list(byte_words.slices([pa.RecordBatch.from_arrays([text], names=["text"])], "text", line_dedup.AT_ONCE))
    tracemalloc.start()
    for part in parts:
        line_dedup.Passages(part.column("text"), line_dedup.UNITS).hashes()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(parts) > 4 and peak < 64 << 20


def test_passages_with_names_of_its_own(spark):
    text = " ".join(f"word{k}" for k in range(200))
    docs = spark.createDataFrame([(1, text, 5, "x", 1), (2, text, 6, "y", 2)], "doc_id long, text string, __id long, `a.b` string, copy long")
    kept = line_dedup.repeats_removed(docs)
    assert sorted(tuple(r) for r in kept.collect()) == [(1, text, 5, "x", 1), (2, "", 6, "y", 2)]


def test_simhash(docs):
    rows = pairs(docs)
    want = brute.components([(d, brute.simhash(t)) for d, t in rows])
    assert Counter(tuple(r) for r in simhash.simhash_components(docs).collect()) == Counter(want)
    kept = simhash.near_duplicates_removed(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(got) == sorted({d for d, _, c in want if d is not None and d == c})


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_bit_sliced_links(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, 30, dtype=np.uint64)
    fps = base[rng.integers(0, 30, 700)]
    for _ in range(radius):
        fps ^= np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64) * (rng.random(700) < 0.6)
    groups = np.sort(rng.integers(0, 5, 700))
    sides = rng.integers(0, 3, 700)
    for own in (None, sides):
        want = {
            (i, j) for i in range(700) for j in range(i + 1, 700)
            if groups[i] == groups[j] and int(fps[i] ^ fps[j]).bit_count() <= radius and (own is None or 0 in (own[i], own[j]) or own[i] != own[j])
        }
        if own is not None:
            want = {(i, j) for i, j in want if not (own[i] and own[j] == 0)}  # side 0 never shares a group with the others
            got = {(i, j) for i, j in zip(*map(np.ndarray.tolist, simhash.bit_sliced_links(fps, groups, radius, own))) if not (own[i] and own[j] == 0)}
        else:
            got = set(zip(*map(np.ndarray.tolist, simhash.bit_sliced_links(fps, groups, radius))))
        assert got == want


def test_a_dense_family_takes_little_memory():
    """Millions of pairs of near copies are contracted as they are found: some 45 bytes a pair were held at once before."""
    rng = np.random.default_rng(8)
    fps = np.uint64(1) << rng.integers(0, 64, 6000).astype(np.uint64)
    groups, names = np.repeat([0, 1], 3000), rng.permutation(6000).astype(np.int64)
    tracemalloc.start()
    found = dict(zip(*map(np.ndarray.tolist, simhash.forest(names, simhash.bit_sliced_parts(fps, groups, 3, most=1 << 14)))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    lowest = [int(names[groups == g].min()) for g in (0, 1)]
    assert found == {int(n): lowest[g] for n, g in zip(names, groups) if n not in lowest}
    assert sum(len(i) for i, _ in simhash.bit_sliced_parts(fps, groups, 3, most=1 << 14)) == 2 * (3000 * 2999 // 2)
    assert max(len(i) for i, _ in simhash.bit_sliced_parts(fps, groups, 3, most=1 << 14)) < (1 << 14) + 64
    assert peak < 64 << 20


def test_links_of_hot_keys(spark):
    """Many near copies under one key, dealt out as pairs of chunks, and long chains."""
    rng = np.random.default_rng(3)
    fps = {int(rng.integers(0, 2**20)) for _ in range(300)} | {(1 << 40) + (1 << k) - 1 for k in range(20)} | {int(x) for x in rng.integers(0, 2**63, 200)}
    nodes = spark.createDataFrame([(f, f) for f in fps], "fp long, rep long")
    want = {(d, c) for d, _, c in brute.components([(f, f) for f in fps])}
    for cell in (16, 2048):
        from plumbline.llm.components import components

        edges = simhash.links(nodes, cell=cell)
        found = {r.node: r.component for r in components(edges).collect()}
        assert {(f, found.get(f, f)) for f in fps} == want


def test_token_counts(docs):
    library = Tokenizer.from_file(BYTE_BPE)
    want = [(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in pairs(docs)]
    got = [tuple(r) for r in token_counts.token_counts(docs, BYTE_BPE).collect()]
    assert Counter(got) == Counter((*w, w[2] > 512) for w in want)


def test_packing(docs):
    library = Tokenizer.from_file(WORD_BPE)
    want = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in pairs(docs)]
    rows = packing.pack(docs, WORD_BPE, with_ids=True).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, tuple(r.ids)))
    fill = []
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        fill.append(sum(n for _, n in own))
    assert all(n <= 2048 for n in fill)
    whole = defaultdict(list)
    for d, ids in want:
        whole[d, len(ids)].append(ids)
    assert set(whole) == set(pieces)
    for key, texts in whole.items():
        every = Counter((k, i) for ids in texts for k, i in enumerate(ids))
        assert every == Counter((start + k, i) for start, ids in pieces[key] for k, i in enumerate(ids))
    if len(want) > 100:
        padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in fill)
        assert padding < 0.03 * sum(fill)


def test_cut():
    for n in range(1, 5000, 7):
        own = packing.cut(n, 2048, 64)
        assert sum(own) == n and all(o in (2048, 1024, 512, 256, 128, 64) for o in own[:-1])


def test_language_id(docs, spark):
    got = [tuple(r) for r in language_id.languages(docs).collect()]
    rows = pairs(docs)
    assert Counter(g[0] for g in got) == Counter(d for d, _ in rows)
    names = {r.lang for r in docs.select("lang").distinct().collect()} - {None} | {"und"}
    assert all(g[2] in names and 0 <= g[3] <= 1 and g[1] == (brute.crc_part(g[0], 4) == 2) for g in got)
    letters = Counter((d, not any(c.isalpha() for c in t or "")) for d, t in rows)
    assert Counter((g[0], g[2] == "und") for g in got) == letters
    kept = language_id.known_languages_only(docs)
    assert kept.columns == docs.columns
    assert kept.count() >= 0.5 * len(rows) - 10 and not [r for r in kept.collect() if not any(c.isalpha() for c in r.text or "")]


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.language_id(spark, sf).where("held_out").collect()
    assert np.mean([true[r.doc_id] == r.lang_pred for r in got]) > 0.97


def test_a_small_language_beside_a_hot_one_keeps_its_tree(spark):
    """The floor for four-byte strings is one of each language, and shorter strings are counted in full."""
    hot = [(k, "the cat sat on the mat and the dog sat on the log", "en") for k in range(2000)]
    small = [(3000, "η γάτα κάθεται στο χαλί και ο σκύλος στο ξύλο", "el"), (3001, "el gato duerme en la casa y el perro corre", "es")]
    docs = spark.createDataFrame(hot + small, "doc_id long, text string, lang string")
    whole, floored = language_id.learn(docs), language_id.learn(docs, 1 << 6)
    assert floored.languages == whole.languages == ["el", "en", "es"]
    texts = pa.array(["ο σκύλος κάθεται", "el perro duerme en casa", "the dog and the cat"])
    assert language_id.judge(floored, texts)[0] == language_id.judge(whole, texts)[0] == ["el", "es", "en"]
    for order in (1, 2, 3):
        assert (floored.keys[order] == whole.keys[order]).all() and np.allclose(floored.costs[order], whole.costs[order])
    lone = language_id.learn(docs, 1)  # no four bytes reach such a floor
    assert lone.languages == whole.languages and not len(lone.keys[4])
    assert language_id.judge(lone, texts)[0] == ["el", "es", "en"]


def test_code_lengths_are_those_of_the_trees():
    """The tables give what escaping down the tree gives, step by step."""
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abc "), 80)) for _ in range(6)]
    counts = [Counter(), Counter()]
    for k, t in enumerate(texts):
        line = b"\0\0\0" + " ".join(t.split(" ")).encode()
        while b"  " in line:
            line = line.replace(b"  ", b" ")
        counts[k % 2].update(line[i - 3 : i + 1] for i in range(3, len(line)))
    flat = [(k, int.from_bytes(g, "big"), n) for k in (0, 1) for g, n in counts[k].items()]
    lang, gram, n = (np.array(x) for x in zip(*flat))
    trees = language_id.build_trees(["a", "b"], lang, gram, n.astype(float))

    def bits(k, line, i):
        total = 0.0
        for order in (3, 2, 1, 0):
            followers = Counter()
            for g, n in counts[k].items():
                if order == 0 or g[3 - order : 3] == line[i - order : i]:
                    followers[g[3]] += n
            if not followers:
                continue
            all_ = sum(followers.values()) + len(followers)
            if line[i] in followers:
                return total - np.log2(followers[line[i]] / all_)
            total -= np.log2(len(followers) / all_)
        return total + 8

    text = "abca bcab zz cab"
    data = np.frombuffer(text.encode(), np.uint8)
    got, _ = language_id.code_lengths(trees, data, np.array([0, len(data)]))
    line = b"\0\0\0" + text.encode()
    assert np.allclose(got[0], [sum(bits(k, line, i) for i in range(3, len(line))) for k in (0, 1)], rtol=1e-5)
