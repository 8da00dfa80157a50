"""Operators 11 to 13 against plain versions, on awkward rows and on the test tables."""

from __future__ import annotations

import random
from collections import Counter

import awkward as rows_of
import brute
import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from plumbline.llm import bloom_lines, byte_words, filter_audit, line_dedup, queries, reachable, token_alignment, tokenizing

SMALL = "/root/testdata/sf0.001"
BYTE_BPE, WORD_BPE, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


@pytest.fixture(autouse=True)
def _reachable(spark):
    reachable(spark)


@pytest.fixture(scope="module", params=["awkward", "small", "empty"])
def docs(request, spark):
    if request.param == "small":
        return spark.read.parquet(f"{SMALL}/documents.parquet")
    return spark.createDataFrame(rows_of.awkward_rows() if request.param == "awkward" else [], rows_of.SCHEMA).repartition(3)


def pairs(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def check_lines(docs):
    got = Counter((r.doc_id, r.text, r.n_lines, tuple(map(tuple, r.dropped))) for r in bloom_lines.lines_deduplicated(docs).collect())
    assert got == Counter(brute.deduplicated_lines(pairs(docs)))


def test_lines(docs):
    check_lines(docs)


def line_rows(rng, n):
    """Lines from few and many kinds, blank and short ones, odd spaces and line ends, and a line in a third of all texts."""
    kinds = [f"line number {k} of a set" for k in range(40)] + ["", " ", "short", "  A  short one\t", "exactly10c", "nine char", "äöüßäöüßä", "äöüßäöüßäö", "THE SAME line\r", " the same LINE", "\x0bthe same line\x0c", "　wide space line", "nul\x00inside it"]
    rows = []
    for k in range(n):
        lines = [rng.choice(kinds) if rng.random() < 0.6 else f"a line of its own {rng.random()}" for _ in range(rng.randint(0, 8))]
        if k % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), "a line that every third text has")
        rows.append((rng.choice([k, k, k, None, 7]), "\n".join(lines) if rng.random() < 0.95 else None))
    return rows


def test_lines_of_many_kinds(spark):
    rng = random.Random(3)
    rows = line_rows(rng, 400)
    rows += [rows[5]] * 50  # one row many times
    check_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))


def test_lines_with_full_filters(spark, monkeypatch):
    monkeypatch.setattr(bloom_lines, "MIN_BITS", 1 << 6)
    monkeypatch.setattr(bloom_lines, "MAX_BITS", 1 << 6)
    check_lines(spark.createDataFrame(line_rows(random.Random(4), 200), "doc_id long, text string").repartition(5))


def test_filters_find_few_suspects(spark):
    rows = [(k, "\n".join(f"line {k} {j} that stands once" for j in range(20))) for k in range(500)] + [(1000 + k, "this line stands in two texts") for k in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    twice = bloom_lines.seen_twice(frame, 1 << 18, 10)
    data, at = byte_words.text_bytes(frame.toArrow().column("text"))
    hashes = byte_words.run_hashes(byte_words.LOWER[data], *bloom_lines.line_keys(byte_words.LOWER[data], at, 10)[1:])
    suspects = bloom_lines.all_set(twice, bloom_lines.probes(hashes, 1 << 18))
    assert 2 <= suspects.sum() < 30


def test_alignment(docs):
    byte_bpe = Tokenizer.from_file(BYTE_BPE)
    byte_bpe.encode_special_tokens = True
    want = brute.alignment_rows(pairs(docs), byte_bpe, SentencePieceProcessor(model_file=PIECES))
    got = token_alignment.alignments(docs, BYTE_BPE, PIECES)
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)


ODD = [
    "a ▁ b", "▁", "tab\tand space end ", "   ", "x  y   z", "a  b", "words<s> and</s><|endoftext|> more", "한국어 텍스트 입니다", "日本語のテキスト、スペースなし。", "﻿bom at the start", "é combining é",
    "trailing spaces   ", "line\nbreaks\n\n and\r\n more", "12345 67890 3.14", "I'll don't we've", "\x00\x01 control", "ﬁne ligature", "👩‍👩‍👧 family",
]


def test_alignment_of_odd_texts(spark):
    byte_bpe = Tokenizer.from_file(BYTE_BPE)
    byte_bpe.encode_special_tokens = True
    rng = random.Random(6)
    texts = ODD + [" ".join(rng.choice(ODD) for _ in range(rng.randint(2, 5))) for _ in range(40)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.alignment_rows(rows, byte_bpe, SentencePieceProcessor(model_file=PIECES))
    got = token_alignment.alignments(docs, BYTE_BPE, PIECES, with_groups=True)
    assert Counter(tuple(r) for r in got.drop("groups").collect()) == Counter(want)
    texts_of = {r.doc_id: r.groups for r in got.collect() if r.doc_id is not None}
    assert texts_of[4].count("|") == [w[3] for w in want if w[0] == 4][0]


def test_windows_cut_at_spaces_only(spark):
    """Windows are short, and a long one is not kept."""
    windows = token_alignment.Windows(token_alignment.byte_side(BYTE_BPE), token_alignment.piece_side(PIECES))
    text = b" the cat sat on the mat and the cat sat on the mat " + b"x" * 500
    ids = [side.encoder.flat(side.encoder.rows(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)])))[0] for side in (windows.a, windows.b)]
    cuts, _ = token_alignment.cuts_of(*ids, np.array([len(ids[0])]), windows.a, windows.b)
    rows = windows.rows(*ids, cuts)
    assert len(rows) > 10 and len(set(rows.tolist())) < len(rows)
    assert all(len(key) <= 4 * token_alignment.MEMO_IDS for key in windows.memo) and len(windows.memo) < len(windows.texts)


def test_audit(docs, spark):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    marks = [(d, k % 2, k % 3 == 0) for k, (d, _, _) in enumerate(rows) if k % 4] + [(5, None, 1), (5, 1, None), (None, 1, 1), (10**12, 1, 1)]
    labels = spark.createDataFrame([(d, q, None if t is None else int(t)) for d, q, t in marks], "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(docs, labels).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute.audited(rows, marks))


def test_audit_of_all_patterns(spark):
    rng = random.Random(9)
    rows = []
    for k in range(600):
        n = rng.choice([0, 1, 20, 99, 100, 101, 130])
        words = [rng.choice("abc") if rng.random() < 0.2 else f"w{j}" for j in range(n)]
        text = rng.choice([" ", "\n", "\t "]).join(words) + rng.choice(["", "", "#", " A" * 30, "|" + "Z" * 90])
        rows.append((rng.choice([k, k, None, 4]), rng.choice([text, text, rows[k // 2][1] if k else text, None]), rng.choice(["en", "de", "", None])))
    marks = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 600, 2)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    assert Counter(tuple(r) for r in filter_audit.filter_audit(docs, labels).collect()) == Counter(brute.audited(rows, marks))


def test_audit_is_native(spark):
    plan = queries.filter_interactions(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def thue_morse(n):
    return "".join("ab"[k.bit_count() & 1] for k in range(n))


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096])
def test_complementary_words_are_different(n, spark):
    """The words on which a polynomial modulo 2**64 cannot tell a text from its complement."""
    one = thue_morse(n)
    other = one.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((one + " " + other).encode(), np.uint8)
    starts, ends = np.array([0, n + 1]), np.array([n, 2 * n + 1])
    assert len(set(byte_words.run_hashes(data, starts, ends).tolist())) == 2
    for path in (BYTE_BPE, WORD_BPE):
        library, known = Tokenizer.from_file(path), tokenizing.Encoder(lambda s: [library.encode(t.decode(), add_special_tokens=False).ids for t in s])
        flat, upto = known.flat(known.rows(data, starts, ends))
        assert flat[: upto[0]].tolist() == library.encode(one, add_special_tokens=False).ids
        assert flat[upto[0] :].tolist() == library.encode(other, add_special_tokens=False).ids


def test_complementary_words_in_packing_and_decontamination(spark):
    from plumbline.llm.decontamination import contamination
    from plumbline.llm.packing import pack

    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(0, one), (1, other)], "doc_id long, text string").coalesce(1)
    library = Tokenizer.from_file(WORD_BPE)
    ids = {}
    for r in sorted(pack(docs, WORD_BPE, with_ids=True).collect(), key=lambda r: (r.doc_id, r.start)):
        ids.setdefault(r.doc_id, []).extend(r.ids)
    assert [ids[k][:-1] for k in (0, 1)] == [library.encode(t, add_special_tokens=False).ids for t in (one, other)]
    hits = contamination(docs, spark.createDataFrame([(1, one)], "item_id long, text string"))
    assert {r.doc_id: r.n_hit for r in hits.collect()} == {0: 1, 1: 0}


def test_encoder_starts_anew_beyond_its_bytes(monkeypatch):
    monkeypatch.setattr(tokenizing, "KEPT_BYTES", 2000)
    library = Tokenizer.from_file(WORD_BPE)
    known = tokenizing.Encoder(lambda s: [library.encode(t.decode(), add_special_tokens=False).ids for t in s])
    for k in range(20):
        words = [f"word{k}x{j}" for j in range(15)]
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        starts, ends, _ = tokenizing.word_stretches(data, np.array([0, len(data)]))
        flat, upto = known.flat(known.rows(data, starts, ends))
        assert flat.tolist() == [i for w in words for i in library.encode(w, add_special_tokens=False).ids]
        assert known.size < 2000 + 15 * 400


def test_encoder_hands_over_few_stretches_at_once():
    """What a library makes of its stretches takes far more memory than is kept."""
    asked = []
    known = tokenizing.Encoder(lambda s: asked.append(len(s)) or [[len(t)] for t in s])
    words = [f"word{j}" for j in range(20_000)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = tokenizing.word_stretches(data, np.array([0, len(data)]))
    flat, _ = known.flat(known.rows(data, starts, ends))
    assert flat.tolist() == [len(w) for w in words]
    assert sum(asked) == 20_000 and max(asked) <= 4_000


def test_passage_filters_have_their_bits_at_half_a_gigabyte():
    """Fuller filters let passages through that stand in one document only, and these are written and shuffled."""
    size = 512 << 20
    assert line_dedup.filter_bits(size) >= size // line_dedup.PASSAGE_BYTES * line_dedup.PASSAGE_BITS


def test_many_words_are_packed_as_one_text(monkeypatch):
    """Words of letters, also with a mark behind them, reach the library in few texts, with the ids that they have alone."""
    words = ["plain", "Comma,", "stop.", "odd$$$", "dogs'", "tag<|", "\u0130stanbul", "\u03a3\u03a3\u03a3", "\u0958\u0915\u093c", "e\u0301a", "\u1e9b\u0323", "\ufb01n", "\u65e5\u672c\u8a9e", "\u01c5x;"]
    odd = ["it's", "'s", "x<|endoftext|>y", "<|endoftext|>", "12,5", "\x00a", "a\u00a0b", "\u00a0", "\u3000,", "(a)", "a.b.", "...", ",", "\U0001f642", "\u0301", "a\u200db", "\u0149"]
    rng = random.Random(4)
    stretches = [f"{rng.choice(words + odd)}{rng.choice(['', '', rng.choice(words + odd)])}".encode() for _ in range(3_000)] + [b"\xff\xc3", b"a\xe2\x80"]
    rng.shuffle(stretches)
    one_by_one = tokenizing.encoder(WORD_BPE).encode(stretches)
    assert tokenizing.marked_encoder(WORD_BPE).encode(stretches) == one_by_one
    assert tokenizing.marked_encoder(WORD_BPE).encode([]) == []
    handed = []

    class Counted:
        def __init__(self, library):
            self.library = library

        def __getattr__(self, name):
            return getattr(self.library, name)

        def encode_batch_fast(self, texts, **how):
            handed.extend(texts)
            return self.library.encode_batch_fast(texts, **how)

    monkeypatch.setattr(tokenizing, "tokenizer", lambda path: Counted(Tokenizer.from_file(path)))
    known = tokenizing.marked_encoder.__wrapped__(WORD_BPE)
    known.encode([f"w{chr(97 + k // 26 % 26)}{chr(97 + k % 26)},".encode() for k in range(600)])
    assert len(handed) <= 600 / tokenizing.FEW + 1
