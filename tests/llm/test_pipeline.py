from __future__ import annotations

import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from granary.llm.queries import vocabulary
from tests.llm.test_decontaminate import brute as benchmark_hits
from tests.llm.test_neardup import brute as near_groups
from tests.llm.test_secrets import brute as secret_spans


def staged(spark, documents, sf_dir, tmp_path):
    """Every stage's result, written and read again as the driver does."""
    docs, out = documents, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out.append(docs)
    return out


def test_stages_against_brute_force(spark, sf_dir, documents, tmp_path):
    extra = spark.createDataFrame(
        [(900_001, None), (900_002, "12 34 !"), (900_003, "the end of it password: hunter22x for you"), (None, "the thing of that")],
        "doc_id long, text string",
    ).selectExpr("doc_id", "text", "cast(null as string) lang", "'x' source", "cast(length(text) as long) n_chars")
    documents = documents.select(extra.columns).unionByName(extra)
    results = staged(spark, documents, sf_dir, tmp_path)
    for r in results[:-1]:
        assert r.columns == documents.columns
    rows = [r.collect() for r in [documents, *results]]
    # Language: documents without a letter go, all others stay with their text.
    lettered = {(r.doc_id, r.text) for r in rows[0] if r.text and any(c.isalpha() for c in r.text)}
    assert {(r.doc_id, r.text) for r in rows[1]} == lettered and all(r.lang for r in rows[1])
    # Near-duplicates: the least id of each group stays.
    groups = near_groups([(r.doc_id, r.text) for r in rows[1]])
    assert sorted(r.doc_id for r in rows[2] if r.doc_id is not None) == sorted({c for _, _, c in groups if c is not None})
    # Benchmark: nothing is hit any more, and what was not hit is as it was.
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, after = ({r.doc_id: r for r in x} for x in rows[2:4])
    for doc, r in before.items():
        n, hit, _ = benchmark_hits(r.text, items)
        if not hit:
            assert after[doc] == r
        elif doc in after:
            assert benchmark_hits(after[doc].text, items)[1] == 0 and after[doc].n_chars == len(after[doc].text)
        else:
            assert hit > n / 2
    # Secrets: masked, no document is lost, texts without any are as they were.
    masked = {r.doc_id: r for r in rows[4]}
    assert set(masked) == set(after)
    for doc, r in after.items():
        assert not secret_spans(masked[doc].text)
        assert secret_spans(r.text) or re.search(r"\[secret removed\]", masked[doc].text) or masked[doc] == r
    # Packing: every id of every document, once, gapless in its sequence.
    tokenizer = Tokenizer.from_file(vocabulary())
    tokenizer.encode_special_tokens = True
    pieces, sequences = {}, {}
    for r in rows[5]:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(masked)
    for doc, parts in pieces.items():
        ids, at = [*tokenizer.encode(masked[doc].text, add_special_tokens=False).ids, 0], 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024


def test_one_id_with_several_texts(spark, make_docs):
    prose = "one plain sentence of quite ordinary words that goes on for a while"
    rows = [(1, prose), (1, "something else entirely is told here"), (1, prose), (2, prose), (3, "a third text"), (None, "x y"), (None, "x y")]
    docs = make_docs(rows)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted({rows[0], rows[1], rows[4], rows[5]}, key=repr)


def test_run(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.count() and {"doc_id", "sequence_id", "offset"} <= set(found.columns)
