from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from granary.llm import tokens
from granary.llm.queries import op2_edit_aware_token_counts, vocabulary
from granary.llm.tokenizing import Encoder


@pytest.fixture(scope="module")
def encoder():
    return Encoder(vocabulary())


TOKENIZER = Tokenizer.from_file(vocabulary())
TOKENIZER.encode_special_tokens = True


def full_count(text):
    return len(TOKENIZER.encode(text, add_special_tokens=False).ids)


texts = st.text(alphabet="ab  .'\n\t1é 　", max_size=60)


@settings(max_examples=300, deadline=None)
@given(texts, st.lists(st.tuples(st.integers(-3, 70), st.integers(-1, 20), texts), max_size=5))
def test_counts_after_edits(encoder, text, edits):
    tree = tokens.TokenTree(text, encoder, least=4)
    for at, delete, insert in edits:
        tree.edit(at, delete, insert)
        start = min(max(at, 0), len(text))
        text = text[:start] + insert + text[start + max(delete, 0) :]
        assert tree.text() == text and tree.chars == len(text)
        assert tree.tokens == full_count(text)


@pytest.mark.parametrize("unit", ["word and more ", "line\n", "中文字符。", "数据，", "a  b\t", "x=1;y=2;"])
def test_only_touched_leaves_are_encoded(encoder, unit):
    text = unit * (280_000 // len(unit))
    tree = tokens.TokenTree(text, encoder)
    before = tree.encoded
    tree.edit(140_000, 5, "something else")
    assert 0 < tree.encoded - before < 5 * tokens.LEAF
    assert tree.tokens == full_count(tree.text())


def test_leaves_come_and_go_along_their_paths(encoder, monkeypatch):
    text = "".join(f"word{i} and more, " for i in range(5_000))
    tree = tokens.TokenTree(text, encoder)
    monkeypatch.setattr(tokens.TokenTree, "_plant", None)  # nothing is laid out anew
    for at, delete, insert in [(9_000, 3_000, ""), (9_000, 0, "new words, " * 150), (5, 2_000, "x"), (60_000, 1, "y"), (10**6, 0, " end")]:
        before = tree.encoded
        tree.edit(at, delete, insert)
        text = text[:at] + insert + text[at + delete :]
        assert tree.text() == text and tree.tokens == full_count(text)
        assert tree.encoded - before < len(insert) + 12 * tokens.LEAF


def test_kept_trees(spark, make_docs, encoder):
    texts = {1: "some words, more. " * 3_000, 2: "", 3: "中文。" * 900, 4: None}
    docs = tokens.planted(make_docs(list(texts.items())), vocabulary())
    edits = spark.createDataFrame([(k, 1, 700, 20, " new ") for k in texts], "doc_id long, seq long, at long, n_delete long, inserted string")
    rows = tokens.edited_counts(tokens.with_edits(docs, edits), vocabulary()).collect()
    for r in rows:
        text = texts[r.doc_id] or ""
        assert (r.n_tokens, r.edited_tokens) == (full_count(text), full_count(text[:700] + " new " + text[720:]))
        assert r.reencoded_chars < 5 * tokens.LEAF
    assert len(rows) == 4
    # A column that only has the name of a kept tree is not looked at.
    other = make_docs([(1, "a b")]).selectExpr("*", "7 AS leaves")
    assert tokens.edited_counts(tokens.with_edits(other, edits), vocabulary()).count() == 1


def test_query_and_edit_table(spark, sf_dir, documents, make_docs):
    rows = {r.doc_id: r for r in op2_edit_aware_token_counts(spark, sf_dir).collect()}
    for r in documents.collect():
        text, n = r.text, len(r.text)
        edited = text[: n // 4] + " a few other words" + text[n // 4 + 12 :]
        edited = edited[: n // 2] + text[:200] + edited[n // 2 :]
        got = rows[r.doc_id]
        assert (got.n_tokens, got.edited_chars) == (full_count(text), len(edited + " The end."))
        assert got.edited_tokens == full_count(edited + " The end.")
    docs = make_docs([(1, "one two three"), (2, None), (1, "one two three"), (None, "x")])
    edits = spark.createDataFrame(
        [(1, 2, 0, 0, "B"), (1, 1, 0, 3, "A"), (2, None, None, None, "new text"), (9, 1, 0, 0, "?"), (None, 1, 0, 0, "?")],
        "doc_id long, seq long, at long, n_delete long, inserted string",
    )
    got = tokens.edited_counts(tokens.with_edits(docs, edits), vocabulary()).collect()
    assert sorted((r.doc_id or 0, r.edited_chars, r.edited_tokens) for r in got) == sorted(
        [(1, 12, full_count("BA two three"))] * 2 + [(2, 8, full_count("new text")), (0, 1, 1)]
    )
    assert tokens.edited_counts(tokens.with_edits(make_docs([]), edits), vocabulary()).count() == 0
