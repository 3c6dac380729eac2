from __future__ import annotations

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import fingerprint as fp
from granary.llm.common import WordHashes
from granary.llm.queries import op8_fingerprints

W = WordHashes()


def prose(r, n):
    return "".join(r.choice("abcdefgh") * r.randint(1, 5) + r.choice("    \n") for _ in range(n))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=12), st.text(alphabet="ab \n", max_size=12))
def test_equal_roots_are_equal_texts(a, b):
    assert (fp.fingerprint(a, W) == fp.fingerprint(b, W)) == (a == b)
    assert fp.likeness(fp.fingerprint(a, W), fp.fingerprint(a, W)) == 1


def test_levels_join_up_and_coarsen():
    r = random.Random(3)
    for n in (0, 1, 7, 300, 5000):
        text = prose(r, n)
        levels = fp.tree_levels(text, W)
        if not n:
            assert levels == [] and fp.fingerprint("", W) == "0:0:"
            continue
        root, level, nodes, ends = fp.parsed(fp.fingerprint(text, W))
        assert len(levels[-1]) == 1 and nodes.tolist() == levels[level].tolist() and len(nodes) <= fp.NODES
        while len(nodes) > 1:
            level += 1
            nodes, ends = fp._parents(nodes, ends, level)
            assert nodes.tolist() == levels[level].tolist()


def test_edits_stay_local():
    r = random.Random(9)
    text = prose(r, 4000)
    at = text.index(" ", 9000) + 1
    edited = text[:at] + "inserted words here " + text[at:]
    a, b = fp.fingerprint(text, W), fp.fingerprint(edited, W)
    assert fp.likeness(a, b) > 0.85 and 1 <= len(fp.differing(a, b)) <= 4
    assert fp.likeness(a, fp.fingerprint(prose(r, 4000), W)) < 0.1
    assert fp.likeness(a, fp.fingerprint(text * 3, W)) > 0.4  # other granularity, same nodes


def brute(rows):
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    out = {}
    for i, (doc, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1] or ""
        text = text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out[doc] = (len(text), edited, following)
    return out


def check(found, rows):
    want = brute(rows)
    assert len(found) == len(rows)
    for r in found:
        text = next(t for d, t in rows if d == r.doc_id) or ""
        n, edited, following = want[r.doc_id]
        prints = [fp.fingerprint(t, W) for t in (text, edited, following)]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == tuple(prints[:2])
        assert (r.near_edited, r.near_next) == (fp.likeness(*prints[:2]), fp.likeness(prints[0], prints[2]))


def test_odd_rows(spark, make_docs):
    r = random.Random(1)
    for rows in (
        [(7, "only one here")], [(3, None), (1, ""), (None, "é" * 7), (2, "x"), (-5, "🙂 b c")],
        [(i * 10, prose(r, r.choice([1, 5, 300]))) for i in range(50)] + [(999, "long " * 60_000)],
    ):
        check(fp.neighbour_edits(make_docs(rows)).collect(), rows)
    assert fp.neighbour_edits(make_docs([])).count() == 0
    same = fp.neighbour_edits(make_docs([(1, "a b c d")] * 3)).collect()
    assert len(same) == 3 and all(x.near_next == 1 for x in same)
    assert fp.document_fingerprints(make_docs([(1, None), (1, "x")])).count() == 2


def test_query_against_brute_force(spark, sf_dir, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    found = op8_fingerprints(spark, sf_dir).collect()
    check(found, rows)
    assert sum(r.near_edited > r.near_next for r in found) > 0.9 * len(found)
