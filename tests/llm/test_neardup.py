from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from granary.llm import components, neardup
from granary.llm.common import WordHashes
from granary.llm.queries import op9_near_duplicates


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Component of each id by comparing all pairs that share a shingle."""
    sets, index, root = [shingles(t) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        others = {j for x in s for j in index[x]}
        for j in others:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
        for x in s:
            index[x].append(i)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids.setdefault(d, i)
            root[find(i)] = find(ids[d])
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows)]


def check(found, rows):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str)
    assert got == sorted(brute(rows), key=str)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in found)


def changed(r, words, share):
    return " ".join(r.choice("abcdefghij") + str(r.randrange(9999)) if r.random() < share else w for w in words)


def corpus(seed, groups, size, share):
    r, rows, n = random.Random(seed), [], 0
    for _ in range(groups):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(30, 200))]
        for _ in range(size):
            rows.append((n, changed(r, words, share)))
            n += 1
    r.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)]


def test_odd_rows(spark, make_docs):
    long = "the quick brown fox jumps over the lazy dog and runs away from all of them at once today"
    rows = [
        (5, long), (3, long.upper()), (9, long + " ok"), (1, None), (2, ""), (4, " \n "), (6, "two words"), (7, "Two\twords"),
        (8, "two words é"), (5, long), (None, long), (20, "a b c d e"), (21, "a b c d e"), (21, "other text of this id here"),
        (22, "other text of this id here"), (23, "É b c d e"), (24, "é b c d e"), (25, "two\x1cwords"), (26, "one " * 30_000),
        (27, "one one one one one"),
    ]
    check(neardup.near_duplicates(make_docs(rows)).collect(), rows)
    assert neardup.near_duplicates(make_docs([])).count() == 0


@pytest.mark.parametrize("share", [0.01, 0.025])
def test_groups(spark, make_docs, share):
    rows = corpus(3, 25, 8, share)
    check(neardup.near_duplicates(make_docs(rows)).collect(), rows)


def test_large_group_in_blocks(spark, make_docs, monkeypatch):
    """One original, its copies linked to it but hardly to one another, cut into many blocks."""
    r = random.Random(8)
    words = [f"w{r.randrange(9000)}" for _ in range(150)]
    rows = [(0, " ".join(words))] + [(i, changed(r, words, 0.022)) for i in range(1, 150)]
    docs = make_docs(rows)
    for block in (128, 16):
        monkeypatch.setattr(neardup.confirmed_links, "__defaults__", (block,))
        check(neardup.near_duplicates(docs).collect(), rows)


def test_estimates_and_signatures():
    r, words = random.Random(5), WordHashes()
    base = [f"w{i}" for i in range(400)]
    sets = [neardup.shingle_set(changed(r, base, s), words) for s in (0.0, 0.01, 0.03, 0.06)]
    sig = neardup.signatures(sets)
    for s, row in zip(sets, sig):
        both = len(np.intersect1d(s, sets[0])) / len(np.union1d(s, sets[0]))
        assert abs(np.mean(row == sig[0]) - both) < 0.15
    assert (neardup._intersections(sets, 64)[0] == [len(np.intersect1d(s, sets[0])) for s in sets]).all()


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1080)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {x.node: x.label for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_query_against_brute_force(spark, sf_dir, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    check(op9_near_duplicates(spark, sf_dir).collect(), rows)
