from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from granary.llm import periodic
from granary.llm.queries import op13_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, shortest=6, repeats=4):
    """All maximal stretches by trying every period."""
    n, runs = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(shortest, repeats * q):
                piece = words[i : i + length]
                if not any(all(piece[x] == piece[x + p] for x in range(length - p)) for p in range(1, q)):
                    runs.append((i, length, q))
            i = j + 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(r):
    kind, size, words = r.random(), r.choice([0, 3, 20, 90, 200]), []
    letters = "ab" if kind < 0.3 else "abcd" if kind < 0.6 else [f"w{i}" for i in range(40)]
    while len(words) < size:
        if r.random() < 0.5:
            words += [r.choice(letters) for _ in range(r.randint(1, 9))] * r.randint(1, 9)
        else:
            words += [r.choice(letters) for _ in range(r.randint(1, 12))]
    return words


@pytest.mark.parametrize("shortest,repeats", [(6, 4), (1, 3), (20, 5)])
def test_against_every_period(shortest, repeats):
    r = random.Random(shortest)
    docs = [some_words(r) for _ in range(150)]
    codes = {w: i for i, w in enumerate(sorted({w for d in docs for w in d}))}
    flat = np.array([codes[w] for d in docs for w in d])
    bounds = np.cumsum([0, *map(len, docs)])
    starts, lengths, periods = periodic.runs_of(flat, bounds, shortest, repeats)
    found = list(zip(starts.tolist(), lengths.tolist(), periods.tolist()))
    want = [(s + int(b), n, q) for d, b in zip(docs, bounds) for s, n, q in brute(d, shortest, repeats)]
    assert len(want) > 100 and found == want


def test_long_runs_within_long_periods():
    r = random.Random(3)
    inner = ["x"] * 40 + [str(i) for i in range(300)] + ["p", "q"] * 30 + [r.choice("ab") for _ in range(200)]
    words = ["before"] + inner * 6 + inner[:77]
    codes = np.unique(words, return_inverse=True)[1]
    found = list(zip(*(x.tolist() for x in periodic.runs_of(codes, np.array([0, len(codes)])))))
    assert (1, len(words) - 1, len(inner)) in found
    # Each copy has the two short ones, and the last piece another stretch of x.
    assert sum(q == 1 and n == 40 for _, n, q in found) == 7
    assert sum(q == 2 and n == 60 for _, n, q in found) == 6


def test_one_word_a_million_times_is_not_quadratic():
    codes = np.zeros(1_000_000, np.int64)
    assert [x.tolist() for x in periodic.runs_of(codes, np.array([0, len(codes)]))] == [[0], [1_000_000], [1]]


def test_edges(spark, make_docs):
    line = "All rights reserved here.\n"
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a a a a a"), (5, "a a\ta\na\x0ba a"), (6, "ü ü " * 6 + "end"),
        (7, line * 5), (7, line * 5), (None, line * 4 + "tail"), (8, "x " * 60_000), (9, "one two three"),
    ]
    got = periodic.periodic_runs(make_docs(rows))
    assert got.columns == ["doc_id", "n_words", "runs", "strongest", "collapsed"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, by.values())) == len(rows)
    for i, text in rows:
        words = WORD.findall(text or "")
        runs = brute(words) if len(words) < 1_000 else [(0, len(words), 1)]
        r = by[i][0]
        assert (r.n_words, [tuple(x) for x in r.runs]) == (len(words), runs)
        assert r.collapsed == collapsed(words, runs) and (r.strongest is None) == (not runs)
    assert len(by[7]) == 2 and by[6][0].runs[0].length == 6
    assert periodic.periodic_runs(make_docs([])).collect() == []
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(3, int), np.array([0, 3]), 6, 2)


def test_ties_of_the_strongest(spark, make_docs):
    rows = [(1, "a b " * 4 + "stop " + "c d " * 4), (2, "e " * 8 + "f g " * 8), (3, "h " * 9 + "i j " * 8)]
    best = {r.doc_id: tuple(r.strongest) for r in periodic.periodic_runs(make_docs(rows)).collect()}
    assert best == {1: (0, 8, 2), 2: (0, 8, 1), 3: (0, 9, 1)}


def edited(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def test_query_against_every_period(spark, sf_dir, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = op13_periodic_runs(spark, sf_dir).collect()
    assert len(rows) == len(texts) and sum(r.n_runs > 0 for r in rows) > 10
    tried = 0
    for r in rows:
        words = edited(r.doc_id, texts[r.doc_id])
        if len(words) > 1_500:
            continue
        tried += 1
        runs = brute(words)
        assert r.n_runs == len(runs)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if runs else (None,) * 3
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert tried > 150
