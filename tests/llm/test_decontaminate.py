from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import decontaminate as dc
from granary.llm.queries import op5_decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items, window=10):
    words = WORD.findall(lowered(text))
    hit, found = set(), set()
    for name, item in items:
        other = WORD.findall(lowered(item))
        size = min(window, len(other))
        grams = {tuple(other[i : i + size]) for i in range(len(other) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(name)
    return len(words), len(hit), sorted(found)


words = st.lists(st.sampled_from("a b c".split()), max_size=14).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(words, max_size=5), st.lists(st.sampled_from("a b c d".split()), max_size=60).map(" ".join))
def test_automaton_against_brute_force(items, text):
    named = [(str(i), t) for i, t in enumerate(items)]
    automaton = dc.SuffixAutomaton([(n, dc.words_of(t)) for n, t in named], 4)
    spans, found = automaton.hits(dc.words_of(text))
    n, hit, names = brute(text, named, 4)
    assert sum(b - a for a, b in dc.merged(spans)) == hit and sorted(found) == names


def items_of(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], "item_id long, text string, key string")


ITEMS = [(2, "Uno dos TRES"), (10, "a b c d e f g h i j k l"), (3, "a b c d e f g h i j"), (4, ""), (5, None)]
DOCS = [
    (1, "x uno-dos,tres; y"), (2, "A b c d e f g h i j K x"), (3, None), (4, ""), (5, "b c d e f g h i j k l é"),
    (6, "a b c d e f g h i"), (7, "!!! "), (1, "x uno-dos,tres; y"), (None, "uno dos tres"), (8, "ünö uno dosé tres"),
    (9, "keep this " + "a b c d e f g h i j " + "and that one too " * 9),
]


def test_edges_and_blocks(spark, make_docs):
    docs, items = make_docs(DOCS), items_of(spark, ITEMS)
    for block in (100_000, 6):
        rows = dc.contamination(docs, items, block_words=block).collect()
        assert len(rows) == len(DOCS)
        for r in rows:
            text = next(t for i, t in DOCS if i == r.doc_id)
            n, hit, names = brute(text, [(str(i), t) for i, t in ITEMS])
            assert (r.n_words, r.n_hit, list(r["items"])) == (n, hit, names)
            assert sum(s.end - s.start for s in r.spans) == hit
    assert dc.contamination(make_docs([]), items).count() == 0
    assert {r.n_hit for r in dc.contamination(docs, items_of(spark, [])).collect()} == {0}


def test_cutting(spark, make_docs):
    docs, items = make_docs(DOCS), items_of(spark, ITEMS)
    for block in (100_000, 6):
        out = dc.decontaminate(docs, items, block_words=block)
        assert out.columns == docs.columns
        kept = {r.doc_id: r for r in out.collect()}
        assert set(kept) == {3, 4, 6, 7, 8, 9}
        assert kept[9].text == "keep this " + " " + "and that one too " * 9 and kept[9].n_chars == len(kept[9].text)
        assert kept[6].n_chars == -1 and kept[3].text is None
        for r in kept.values():
            assert brute(r.text, [(str(i), t) for i, t in ITEMS])[1] == 0


def test_cut_that_joins_a_new_window():
    automaton = dc.SuffixAutomaton([("1", dc.words_of("a b c")), ("2", dc.words_of("x y z"))], 3)
    assert dc.cleaned("q q q q q a x y z b c q q", automaton, 0.9) == "q q q q q  q q"


def test_coverage_over_all_blocks(spark, make_docs):
    """30 words hit by one item and 30 by another are 60 of 100, whichever blocks the items fall into."""
    runs = [" ".join(f"{c}{i}" for i in range(30)) for c in "pqrstu"]
    items = items_of(spark, list(enumerate(runs)))
    rest = " ".join(f"z{i}" for i in range(40))
    rows = [(k, f"{a} {rest} {b}") for k, (a, b) in enumerate((a, b) for a in runs for b in runs if a < b)] + [(99, runs[0] + " " + rest)]
    for block in (100_000, 60):
        assert [(r.doc_id, r.text) for r in dc.decontaminate(make_docs(rows), items, block_words=block).collect()] == [(99, " " + rest)]


def test_cuts_that_join_windows_of_other_blocks(spark, make_docs):
    draw = random.Random(3)
    items = [(i, " ".join(draw.choices("abcde", k=draw.randint(2, 5)))) for i in range(12)]
    rows = [(i, " ".join(draw.choices("abcdefgh", k=draw.randint(1, 40)))) for i in range(150)] + [(7, None), (None, "a, b; c"), (8, "")]
    automaton = dc.SuffixAutomaton([(str(i), dc.words_of(t)) for i, t in items], 3)
    want = [(i, t, -1) if n == t else (i, n, len(n)) for i, t in rows + rows for n in [t and dc.cleaned(t, automaton, 0.6)] if t is None or n is not None]
    for block in (100_000, 15):
        out = dc.decontaminate(make_docs(rows + rows), items_of(spark, items), 3, 0.6, block)
        assert Counter((r.doc_id, r.text, r.n_chars) for r in out.collect()) == Counter(want)


def test_query_against_brute_force(spark, sf_dir, documents):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = op5_decontamination(spark, sf_dir).collect()
    assert len(rows) == len(texts) and any(r.contaminated for r in rows)
    for r in rows:
        n, hit, names = brute(texts[r.doc_id], items)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(names), digest, hit > 0)


def test_blocks_are_held_one_at_a_time(spark, make_docs, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    items = [(f"item{i:02d}", " ".join(rng.choices(words, k=rng.choice([3, 10, 14])))) for i in range(40)]
    docs = []
    for i in range(60):
        text = rng.choices(words, k=30)
        for _, passage in rng.sample(items, 3):
            text[rng.randrange(30) : 0] = passage.split()
        docs.append((i if i % 9 else None, " ".join(text)))
    docs += [(70, None), (71, ""), docs[1], docs[1]]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    monkeypatch.setattr(dc, "MERGED_PARTS", 4)
    live, most = [], []
    share = spark.sparkContext.broadcast

    def broadcast(value):
        held = share(value)
        live.append(held)
        most.append(len(live))
        destroy = held.destroy
        held.destroy = lambda *x: (live.remove(held), destroy(*x))
        return held

    def found(block_words):
        out = dc.contamination(make_docs(docs), benchmark, block_words=block_words)
        return sorted(
            (str(r.doc_id), r.n_words, r.n_hit, [(s.start, s.end) for s in r.spans], list(r.items)) for r in out.collect()
        )

    one = found(100_000)
    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    assert found(25) == one
    assert len(most) > 8 and max(most) == 1 and len(one) == len(docs)
