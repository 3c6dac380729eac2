from __future__ import annotations

import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from granary.llm import infill
from granary.llm.queries import op12_fill_in_middle
from granary.llm.sql import ORACLE


def brute(doc_id, text, seed=7, rate=100, front=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < front:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_brute_force(spark, make_docs):
    r = random.Random(1)
    parts = ["\n", "\n\n", "word ", "é𝄞", "\r\n", "<P", ">", "<", "<M>", " ", "line\n", "   "]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 30)))) for i in range(600)]
    rows += [(600, None), (601, ""), (602, "\n"), (603, "no end"), (604, "a\n" * 200_000), (605, "x" * 3_000_000)]
    rows += [(606, "a<S>b\n"), (None, "one\ntwo\nthree\n"), (None, None), (5, rows[5][1]), (5, "other\ntext\n")]
    for rate, front in ((100, 50), (40, 20), (0, 0), (100, 100)):
        made = infill.fill_in_middle(make_docs(rows), rate=rate, suffix_first=front)
        made = made.withColumn("again", infill.restored(F.col("form"), F.col("output")))
        assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "again"]
        got = sorted((repr(x.doc_id), *map(repr, x[1:])) for x in made.collect())
        want = sorted((repr(i), *map(repr, brute(i, t, rate=rate, front=front)), repr(t or "")) for i, t in rows)
        assert got == want
    assert {brute(i, t)[1] for i, t in rows} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(make_docs([])).collect() == []


def test_query_against_sql_and_brute_force(spark, sf_dir, documents):
    got = {tuple(r) for r in op12_fill_in_middle(spark, sf_dir).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert got == set(con.execute(ORACLE["op12_fill_in_middle"]).fetchall())

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = set()
    for r in documents.collect():
        *head, output = brute(r.doc_id, r.text)
        want.add((r.doc_id, *head, sha(output), sha(r.text or "")))
    assert got == want
