from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest

from granary.llm import maxscore
from granary.llm.queries import op11_exact_top_k
from granary.llm.sql import ORACLE

SCHEMA = "vec_id long, embedding array<double>, label int, score long, shard long, query_id long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 3, 4, 5, 6) for i, v in rows], SCHEMA)


def brute(rows, k=5, every=50, scale=256):
    sound = [
        (i, [max(-(1 << 24), min(1 << 24, math.floor(scale * x))) for x in v])
        for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for at, (i, q) in enumerate(sound):
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v)), j is None, j or 0, j) for o, (j, v) in enumerate(sound) if o != at]
        out += [(i, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def answer(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def vectors(r, n, dims):
    centres = [[r.gauss(0, 0.2) for _ in range(dims)] for _ in range(4)]
    return [[c + r.gauss(0, 0.1) for c in r.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("shard_rows", [7, 40, 100_000])
def test_against_all_pairs(spark, shard_rows):
    r = random.Random(2)
    rows = list(enumerate(vectors(r, 260, 12)))
    rows += [(1_000 + i, rows[50][1]) for i in range(30)]  # more equal vectors than places
    rows += [(50, rows[50][1]), (50, rows[51][1]), (100, rows[51][1])]  # repeated ids and rows
    rows += [(300, None), (350, [1.0, None]), (400, [float("nan")] * 12), (450, [float("inf")] + [0.0] * 11)]
    rows += [(500, []), (550, [0.0] * 12), (600, [-0.5] * 12), (650, [0.3] * 4), (701, [1.0] * 15), (None, rows[100][1])]
    rows += [(-50, rows[7][1]), (750, [3e300, -1e-300] + [0.0] * 10), (751, [1e300] * 3)]
    assert answer(maxscore.top_k(table(spark, rows), shard_rows=shard_rows)) == brute(rows)


def test_few_rows(spark):
    assert answer(maxscore.top_k(table(spark, []))) == []
    assert answer(maxscore.top_k(table(spark, [(50, [1.0])]))) == []
    rows = [(0, [1.0, 2.0]), (50, [-1.0, 0.0]), (3, [0.5, 0.5])]
    assert answer(maxscore.top_k(table(spark, rows), shard_rows=1)) == brute(rows)
    assert answer(maxscore.top_k(table(spark, rows), k=1, every=1, scale=2)) == brute(rows, 1, 1, 2)


def test_postings_and_thresholds():
    r = np.random.default_rng(4)
    matrix = r.integers(-60, 60, (500, 9)).astype(np.int32) * (r.random((500, 9)) < 0.4)
    shard = maxscore.Shard(matrix)
    for query in r.integers(-60, 60, (20, 9)):
        scores = matrix.astype(np.int64) @ query
        for threshold in (None, -500, 0, 1, 900, 2_000, 5_000, 10**6):
            places, found = shard.search(query, threshold)
            want = np.flatnonzero(scores >= threshold) if threshold is not None else np.arange(500)
            assert places.tolist() == want.tolist() and found.tolist() == scores[want].tolist()
    bounds = [b for b, *_ in shard.postings(np.arange(9) - 4)]
    assert bounds == sorted(bounds, reverse=True) and len(bounds) == 8


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = sorted(con.execute(ORACLE["op11_exact_top_k"]).fetchall(), key=repr)
    assert answer(op11_exact_top_k(spark, sf_dir)) == want and len(want) >= 5
