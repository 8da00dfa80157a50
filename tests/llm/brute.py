"""Plain Python versions of the operators, row by row."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ordered(rows):
    """(doc_id, text) with nulls first."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_Z))


def graphic_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_Z))


def edited(rows):
    """doc_id, n_chars, sha, edited text, next text of each row in order."""
    rows = ordered(rows)
    out = []
    for k, (doc, text) in enumerate(rows):
        text, behind = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + behind[:half]
        out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), text, new, behind))
    return out


def contamination(rows, items, window=13):
    windows = defaultdict(set)
    for item, text in items:
        words = alnum_words(text)
        if item is not None and words:
            for k in range(max(1, len(words) - window + 1)):
                windows[tuple(words[k : k + window])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        words = alnum_words(text)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if (w := tuple(words[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[w]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(words)))
    return out


def simhash(text):
    words = graphic_words(text)
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=3):
    """(doc, fingerprint, component) with links between all pairs within the radius."""
    kinds = sorted({f for _, f in fps})
    root = {f: f for f in kinds}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(kinds):
        for b in kinds[:k]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for doc, f in fps:
        if doc is not None:
            least[find(f)].append(doc)
    return [(doc, f"{f:016x}", min(least[find(f)], default=None)) for doc, f in fps]


def repeated_runs(rows, n_units=16):
    """(doc, text) -> [(start, length, passages, kept doc, kept start)] of runs of passages that a smaller id holds."""
    place = lambda d: (d is None, d or 0)
    found, first = {}, {}
    for doc, text in set(rows):
        units, unit, lines, at = [], [], (text or "").split("\n"), 0
        for line in lines:
            words = [(m.start() + at, m.end() + at, m.group().translate(A_Z)) for m in re.finditer(r"[^\x20\x09-\x0D]+", line)]
            for k, word in enumerate(words):
                unit.append(word)
                if sum(map(ord, word[2])) % 2 == 0 or k + 1 == len(words):
                    units.append(unit)
                    unit = []
            at += len(line) + 1
        found[doc, text] = []
        for k in range(len(units) - n_units + 1):
            words = [w for u in units[k : k + n_units] for w in u]
            key = " ".join(w[2] for w in words)
            found[doc, text].append((words[0][0], words[-1][1], key))
            first[key] = min(first.get(key, (place(doc), words[0][0], doc)), (place(doc), words[0][0], doc))
    out = {}
    for (doc, text), passages in found.items():
        runs = []
        for start, stop, key in passages:
            if first[key][0] < place(doc):
                if runs and start <= runs[-1][1]:
                    runs[-1][1:3] = [max(runs[-1][1], stop), runs[-1][2] + 1]
                else:
                    runs.append([start, stop, 1, first[key][2], first[key][1]])
        out[doc, text] = [(a, b - a, n, kept, kept_at) for a, b, n, kept, kept_at in runs]
    return out


def crc_part(doc, parts):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % parts


def multiset(rows):
    return Counter(rows)


BLANK = " \t\n\x0b\x0c\r"


def deduplicated_lines(rows, min_chars=10):
    """(doc, kept text, lines, dropped places); rows with one id are one document, null is the largest id."""
    place = lambda d: (d is None, d or 0)
    key = lambda line: line.strip(BLANK).translate(A_Z)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(place(doc))
    out = []
    for doc, text in rows:
        kept, dropped, start = [], [], 0
        lines = (text or "").split("\n")
        for line in lines:
            if len(key(line)) >= min_chars and min(holders[key(line)]) < place(doc):
                dropped.append((start, len(line)))
            else:
                kept.append(line)
            start += len(line) + 1
        out.append((doc, "\n".join(kept), len(lines), tuple(dropped)))
    return out


def aligned_tokens(rows, byte_bpe, pieces):
    """Per row (doc, n_a, n_b, groups, links), from whole texts and byte offsets; groups and links are lists of id lists and id pairs."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    out = []
    for doc, text in rows:
        text = text or ""
        a = byte_bpe.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        spell_a = [bytes(byte_of[c] for c in byte_bpe.id_to_token(i)) for i in a]
        names = [pieces.id_to_piece(i) for i in b]
        spell_b = [bytes.fromhex(n[3:5]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode() for n in names]
        if b"".join(spell_a) != (" " + text).encode() or b"".join(spell_b) != (" " + text).encode():
            out.append((doc, 0, 0, [], []))
            continue
        end_a = {sum(map(len, spell_a[: k + 1])): k for k in range(len(a))} if len(a) < 300 else dict(zip(np.cumsum([*map(len, spell_a)]).tolist(), range(len(a))))
        end_b = dict(zip(np.cumsum([*map(len, spell_b)]).tolist(), range(len(b))))
        groups, links, i, j = [], [], 0, 0
        for end in sorted(end_a.keys() & end_b.keys()):
            groups.append((a[i : end_a[end] + 1], b[j : end_b[end] + 1]))
            links.append((a[end_a[end]], b[end_b[end]]))
            i, j = end_a[end] + 1, end_b[end] + 1
        out.append((doc, len(a), len(b), groups, links))
    return out


def alignment_rows(rows, byte_bpe, pieces):
    """What the query returns, in its order of columns."""
    found = aligned_tokens(rows, byte_bpe, pieces)
    count = Counter(link for r in found for link in r[4])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for doc, n_a, n_b, groups, links in found:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if n_a else ""
        best = sum(count[link] == most[link[1]] for link in links)
        out.append((doc, n_a, n_b, len(groups), len(links), best, sum(count[link] for link in links), sha))
    return out


def audited(rows, labels):
    """(part, order, step, kept, removed, redundant, unique, good, toxic, shapley) by applying every order; rows are (doc, text, lang)."""
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    place = lambda d: (d is None, d or 0)
    least = {}
    for doc, text, _ in rows:
        least[text or ""] = min(least.get(text or "", place(doc)), place(doc))
    parts = defaultdict(list)
    for doc, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": least[text] < place(doc),
        }
        parts[lang or ""].append((doc, {f for f in fails if fails[f]}))
    out, totals = [], Counter()
    for part, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                totals[part, f] += len(gone)
                failing = sum(f in d[1] for d in docs)
                out.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)))
    return [(*r, totals[r[0], r[1][r[2] - 1]]) for r in out]
