"""Language identification by rank-order profiles.

A language's profile is its most frequent letter n-grams in order of frequency,
counted over all labelled documents. A text is compared by the out-of-place
distance: for each of its own most frequent n-grams, how far its rank is from
the rank in the profile, with a fixed distance for those the profile lacks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from granary.llm.common import kept, map_batches, stored, texts_of

PROFILE = 400
#: A profile table larger than this is refused, not cut: it goes to every task.
MAX_LANGUAGES = 2_000
#: Distinct n-grams a counting task holds before it passes them on.
HELD_GRAMS = 500_000


def _is_letter() -> np.ndarray:
    return np.fromiter(
        (unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000
    )


def grams_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The 1- to 3-grams of a whole text with their counts, most frequent first.

    The text is lower-cased and read as words of letters with one blank on either
    side. A gram is packed into 63 bits, 21 per character; blanks alone are not
    counted, and no gram goes across a word's end. Ties are in order of the code.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = kept(("letters",), _is_letter)[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.concatenate([[0], np.where(letter, codes, 0), [0]])
    c = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    pairs = (c[:-1] << 21) | c[1:]
    triples = (pairs[:-1] << 21) | c[2:]
    grams = np.concatenate([c[c != 0], pairs, triples[c[1:-1] != 0]])
    grams.sort()
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    counts = np.diff(np.append(first, len(grams)))
    order = np.argsort(-counts, kind="stable")
    return grams[first][order], counts[order]


def language_profiles(labelled: DataFrame, profile: int = PROFILE) -> DataFrame:
    """Profiles of all languages in (lang, text) rows: lang, gram, rank from 0.

    Counts cover every labelled text. Tasks add up what they read before the
    shuffle; rows without a language or letters add nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            langs, grams, counts = [], [], []
            for lang, parts in held.items():
                g, n = _added(parts)
                langs += [lang] * len(g)
                grams.append(g)
                counts.append(n)
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(np.concatenate(grams)), pa.array(np.concatenate(counts))],
                ["lang", "gram", "count"],
            )

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
                grams, counts = grams_of(text)
                if len(grams):
                    held.setdefault(lang, []).append((grams, counts))
                    size += len(grams)
            if size > HELD_GRAMS:
                held = {lang: [_added(parts)] for lang, parts in held.items()}
                size = sum(len(p[0][0]) for p in held.values())
                if size > HELD_GRAMS:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    counts = map_batches(
        labelled.select("lang", "text").where("lang is not null and text is not null"),
        count, "lang string, gram long, count long",
    )
    totals = counts.groupBy("lang", "gram").agg(F.sum("count").alias("count"))
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "gram")
    # A bound on row_number itself lets every task drop what cannot be among the first.
    placed = totals.withColumn("place", F.row_number().over(order)).where(F.col("place") <= profile)
    return placed.select("lang", "gram", (F.col("place") - 1).alias("rank"))


def _added(parts: list) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    grams = np.concatenate([g for g, _ in parts])
    counts = np.concatenate([n for _, n in parts])
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.add.reduceat(counts, first)


class Profiles:
    """Ranks of all profiled n-grams in one sorted table."""

    def __init__(self, rows: Sequence[tuple[str, int, int]], size: int):
        self.langs = sorted({lang for lang, _, _ in rows})
        self.size = size
        self.grams = np.array(sorted({gram for _, gram, _ in rows}), np.int64)
        self.ranks = np.full((len(self.langs), len(self.grams)), -1, np.int64)
        number = {lang: i for i, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.ranks[number[lang], np.searchsorted(self.grams, gram)] = rank

    def nearest(self, text: str) -> tuple[str, float]:
        """The language with the least mean out-of-place distance, and its likeness."""
        grams = grams_of(text)[0][: self.size]
        if not len(grams) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        ranks = np.where(self.grams[at] == grams, self.ranks[:, at], -1)
        away = np.abs(ranks - np.arange(len(grams)))
        away = np.where(ranks < 0, self.size, np.minimum(away, self.size)).mean(axis=1)
        best = int(away.argmin())
        return self.langs[best], float(1 - away[best] / self.size)


def identify(docs: DataFrame, profiles: DataFrame, size: int = PROFILE) -> DataFrame:
    """All columns of `docs` with `lang_pred` and `score` added.

    The prediction looks at the whole `text` and nothing else. lang_pred is a
    profiled language, or `und` with score 0 where the text is null, has no
    letter, or no language was profiled; score, from 0 to 1, is one minus the
    mean out-of-place distance relative to the greatest. Ties go to the language
    that sorts first. Columns named lang_pred or score are replaced.
    """
    # Read twice below, and the counts behind them are over all labelled texts.
    rows = stored(profiles.select("lang", "gram", "rank"))
    languages = rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: their profiles are too large to send to every task")
    docs = docs.drop("lang_pred", "score")
    table = Profiles([tuple(r) for r in rows.collect()], size)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.nearest(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*batch.schema.names, "lang_pred", "score"],
            )

    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return map_batches(docs, predict, schema)


def is_held_out(doc_id: Column) -> Column:
    """True for a third of the ids, which no profile is learnt from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1
