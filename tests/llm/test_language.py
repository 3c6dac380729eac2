from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import functions as F

from granary.llm import language
from granary.llm.queries import op6_language_id


def plain_grams(text):
    """n-grams by slicing words, most frequent first, ties by code points."""
    words, run = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            run += c
        elif run:
            words.append(run)
            run = ""
    counts = Counter()
    blank = "\0"
    joined = blank + blank.join(words) + blank if words else ""
    for n in (1, 2, 3):
        for i in range(len(joined) - n + 1):
            g = joined[i : i + n]
            if g != blank and not (n == 3 and g[1] == blank):
                counts[g] += 1

    def code(g):
        value = 0
        for c in g:
            value = value << 21 | ord(c)
        return value

    merged = Counter()
    for g, n in counts.items():
        merged[code(g)] += n
    return sorted(merged.items(), key=lambda x: (-x[1], x[0]))


def test_grams_against_slicing():
    for text in ("Ab, ab! É 12 cc", "x", "", "  .", "ça va? ça va!", "日本 語", "a" * 5000, "naïve-NAÏVE \n _z_"):
        grams, counts = language.grams_of(text)
        assert list(zip(grams.tolist(), counts.tolist())) == plain_grams(text)


def test_odd_rows(spark, make_docs):
    profiles = spark.createDataFrame([("xx", ord("a"), 0), ("yy", ord("b"), 0)], "lang string, gram long, rank int")
    rows = [(1, "a a"), (2, "b"), (3, None), (4, ""), (5, "123 ."), (6, "ab"), (1, "a a"), (None, "b" * 50_000), (7, "日本")]
    docs = make_docs(rows)
    out = language.identify(docs, profiles)
    assert out.columns[-2:] == ["lang_pred", "score"] and out.columns.count("score") == 1
    got = sorted((r.doc_id or 0, r.lang_pred) for r in out.collect())
    assert got == [(0, "yy"), (1, "xx"), (1, "xx"), (2, "yy"), (3, "und"), (4, "und"), (5, "und"), (6, "xx"), (7, "xx")]
    assert all((r.score == 0) >= (r.lang_pred == "und") and 0 <= r.score <= 1 for r in out.collect())
    empty = language.language_profiles(make_docs([]))
    assert empty.count() == 0 and {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}


def test_profiles_and_query(spark, sf_dir, documents):
    rows = documents.collect()
    learnt = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang]
    counts = {}
    for r in learnt:
        for g, n in plain_grams(r.text):
            counts.setdefault(r.lang, Counter())[g] += n
    want = {
        (lang, g, k) for lang, c in counts.items()
        for k, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: language.PROFILE])
    }
    profiles = language.language_profiles(documents.where(~language.is_held_out(F.col("doc_id"))))
    assert {tuple(r) for r in profiles.collect()} == want
    got = {r.doc_id: r for r in op6_language_id(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)


def test_ranks_are_limited_before_the_shuffle(documents):
    plan = language.language_profiles(documents)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
