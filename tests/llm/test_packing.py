from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from granary.llm import packing
from granary.llm.queries import op10_packing, vocabulary
from granary.llm.tokenizing import Encoder


def plain_best_fit(lengths, window):
    """Best fit decreasing by looking at every open window."""
    left, where = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(c, k) for k, c in enumerate(left) if c >= lengths[i]]
        if fits:
            best = min(fits)[0]
            k = min(k for c, k in fits if c == best)
        else:
            left.append(window)
            k = len(left) - 1
        left[k] -= lengths[i]
        where[i] = k
    return sorted(left)


@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_leaves_the_same_room(lengths):
    number, offset = packing.best_fit_decreasing(lengths, 64)
    used = defaultdict(int)
    for n, o, size in sorted(zip(number, offset, lengths)):
        assert used[n] == o
        used[n] += size
    assert sorted(64 - u for u in used.values()) == plain_best_fit(lengths, 64)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(vocabulary()), Tokenizer.from_file(vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" ab.'\n\tÀé9_²ſ<|endoftext|>", max_size=40)))
def test_ids_are_the_tokenizers(encoder, text):
    ours, theirs = encoder
    theirs.encode_special_tokens = True
    ids = np.frombuffer(ours.packed_ids(text), "<u4").tolist()
    assert ids == theirs.encode(text, add_special_tokens=False).ids


def check_packed(rows, texts):
    tok = Tokenizer.from_file(vocabulary())
    tok.encode_special_tokens = True
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == {d for d, _ in texts}
    for doc, text in texts:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    room = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
        room += packing.WINDOW - at
    return room


def test_query(spark, sf_dir, documents):
    texts = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    rows = op10_packing(spark, sf_dir).collect()
    room = check_packed(rows, texts)
    assert room <= 0.02 * sum(r.length for r in rows) + 2 * packing.WINDOW


def test_shards_and_odd_rows(spark, make_docs):
    random.seed(5)
    rows = [(i, "word " * random.randint(0, 3000)) for i in range(60)] + [(100, None), (101, ""), (None, "x y")]
    docs = make_docs(rows)
    pieces = packing.token_pieces(docs, vocabulary())
    packed = packing.pack(pieces, shard_pieces=7).collect()
    check_packed(packed, rows)
    assert packing.pack_documents(make_docs([]), vocabulary()).count() == 0
    twice = packing.pack_documents(make_docs([(1, "same"), (1, "same")]), vocabulary()).collect()
    assert len(twice) == 2 and {(r.sequence_id, r.offset) for r in twice} == {(0, 0), (0, twice[0].length)}


def test_copies_of_one_row_are_dealt_to_many_shards(spark, make_docs):
    # Rows without an id and a text are all alike: 3,000 pieces of one id each.
    docs = make_docs([(None, None)] * 3_000)
    rows = packing.pack_documents(docs, vocabulary(), window=64, shard_pieces=100).collect()
    assert len(rows) == 3_000 and {r.length for r in rows} == {1}
    places = {(r.sequence_id, r.offset) for r in rows}
    assert len(places) == 3_000
    # Thirty shards, none with all rows: each leaves at most one window open.
    shards = {}
    for r in rows:
        shards[(r.sequence_id // 2) % 30] = shards.get((r.sequence_id // 2) % 30, 0) + 1
    assert len(shards) == 30 and max(shards.values()) < 200
