"""Runs: stretches of words that repeat with a period, found by seeds and extension.

A run is a stretch of consecutive words with smallest period q that reaches at
least `repeats` periods (and `shortest` words) and that no neighbouring word
carries on. The stretch and its copy q words later overlap in at least
max(shortest - q, (repeats - 1) * q) words. Periods are taken in classes from
2^j to 2^(j+1) - 1; the least overlap from a class on is the length of the word
k-grams that are indexed for it. As that length is at least every period of the
class, the next occurrence of a run's first k-gram in its document is exactly one
smallest period away: only neighbouring occurrences are paired, n in a class of
any text. A pair stands on the diagonal of its lag; it is extended both ways, and
a table of the furthest word covered per lag keeps later pairs of the same run
from being extended again.

Only positions whose shorter gram recurs in the document go on to a longer one,
so ordinary prose is finished after two or three rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from granary.llm.common import map_batches

SHORTEST, REPEATS = 6, 4

_RUN = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])


def overlap(low: int, shortest: int, repeats: int) -> int:
    """The least overlap of a run with its own shift, over all periods from `low` on."""
    # Rising in q once (repeats - 1) * q is the larger of the two.
    return min(max(shortest - q, (repeats - 1) * q) for q in range(low, max(low, shortest) + 1))


class _Grams:
    """Names of equal word k-grams of the same document, at positions that still matter."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray, docs: np.ndarray):
        self.ends, self.size = ends, len(codes)
        self.names = np.full(self.size, -1, np.int64)
        self._name(np.arange(self.size), docs * (int(codes.max(initial=0)) + 1) + codes)
        self.k = 1

    def _name(self, at: np.ndarray, keys: np.ndarray) -> None:
        """Number the keys; positions whose key occurs once are given up."""
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, bool)
        group = np.cumsum(fresh) - 1
        again = np.bincount(group)[group] > 1 if len(keys) else fresh
        #: Positions by gram, ascending within each, and the gram's number beside them.
        self.at, self.group = at[again], group[again]
        self.names = np.full(self.size, -1, np.int64)
        self.names[self.at] = self.group

    def lengthen(self, k: int) -> None:
        """From grams of self.k words to grams of k words, at most twice as long at a time."""
        while self.k < k and len(self.at):
            longer = min(k, 2 * self.k)
            at = np.sort(self.at)
            at = at[at + longer <= self.ends[at]]
            right = self.names[at + (longer - self.k)]
            at, right = at[right >= 0], right[right >= 0]
            self._name(at, self.names[at] * np.int64(self.size) + right)
            self.k = longer

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of neighbouring occurrences: position and lag."""
        same = self.group[1:] == self.group[:-1]
        return self.at[:-1][same], (self.at[1:] - self.at[:-1])[same]


def _matching(codes: np.ndarray, at: int, lag: int, stop: int, step: int) -> int:
    """How many words from `at` on (towards `stop`, excluded) equal the word `lag` later."""
    length, block = 0, 16
    left = (stop - at) * step
    while left > 0:
        n = min(block, left)
        here = codes[at : at + n] if step > 0 else codes[at - n + 1 : at + 1][::-1]
        there = codes[at + lag : at + lag + n] if step > 0 else codes[at + lag - n + 1 : at + lag + 1][::-1]
        differ = np.flatnonzero(here != there)
        if len(differ):
            return length + int(differ[0])
        length, at, left, block = length + n, at + step * n, left - n, block * 2
    return length


def runs_of(
    codes: np.ndarray, bounds: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of many documents: start (over all words), length, period, by start and period.

    `codes` are the words of all documents as numbers, `bounds` where each
    document begins, and the end of the last.
    """
    if repeats < 3 or shortest < 1:
        raise ValueError("repeats must be 3 or more, shortest 1 or more")
    sizes = np.diff(bounds)
    docs = np.repeat(np.arange(len(sizes)), sizes)
    begins, ends = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
    grams = _Grams(codes.astype(np.int64), ends, docs)
    found: list[tuple[int, int, int]] = []
    low = 1
    while repeats * low <= int(sizes.max(initial=0)) and len(grams.at):
        high = 2 * low - 1
        k = overlap(low, shortest, repeats)
        grams.lengthen(k)
        at, lag = grams.neighbours()
        of_class = (lag >= low) & (lag <= high)
        at, lag = at[of_class], lag[of_class]
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        # Pairs side by side on one diagonal are one seed, as long as the chain.
        head = np.concatenate([[True], (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.empty(0, bool)
        heads = np.flatnonzero(head)
        tails = np.append(heads[1:], len(at))[: len(heads)] - 1
        covered: dict[int, int] = {}
        for i, j, q in zip(at[heads].tolist(), at[tails].tolist(), lag[heads].tolist()):
            if i < covered.get(q, 0):
                continue
            back = _matching(codes, i - 1, q, int(begins[i]) - 1, -1)
            ahead = _matching(codes, j + k, q, int(ends[i]) - q, 1)
            start, matched = i - back, j + k + ahead - (i - back)
            covered[q] = start + matched
            if matched + q >= max(shortest, repeats * q):
                found.append((start, matched + q, q))
        low *= 2
    found.sort(key=lambda r: (r[0], r[2]))
    table = np.array(found, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and where each text's begin (and the end)."""
    lists = pc.ascii_split_whitespace(texts)
    words, parents = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.not_equal(words, "")
    words, parents = words.filter(real), parents.filter(real).to_numpy()
    return words, np.searchsorted(parents, np.arange(len(texts) + 1))


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, repeats: int = REPEATS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, runs, strongest, collapsed.

    Words are what lies between blanks, tabs and line ends (space, \\x09 to \\x0D).
    `runs` has start (word number from 0), length and period of every run, by start
    and period; `strongest` is the one of greatest exact length / period (ties: least
    start, then period), null without runs. `collapsed` are the words, joined by one
    space, that no run holds behind its first period.

    A null or empty text has no words, no runs and an empty collapsed text. Repeated
    rows each give a row; a null doc_id stays null; other columns are not looked at.
    A text is worked on whole by one task, in time n log n of its words.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bounds = words_of(pc.fill_null(batch.column("text"), ""))
            codes = words.dictionary_encode().indices.to_numpy()
            starts, lengths, periods = runs_of(codes, bounds, shortest, repeats)
            change = np.zeros(len(codes) + 1, np.int64)
            np.add.at(change, starts + periods, 1)
            np.add.at(change, starts + lengths, -1)
            kept = np.cumsum(change[:-1]) == 0
            sums = np.concatenate([[0], np.cumsum(kept)])[bounds]
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(sums, pa.int32()), words.filter(pa.array(kept))), " ")
            cuts = np.searchsorted(starts, bounds)
            owner = np.searchsorted(bounds, starts, "right") - 1
            inner = starts - bounds[owner] if len(starts) else starts
            each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (inner, lengths, periods)], fields=list(_RUN))
            rows = list(zip(inner.tolist(), lengths.tolist(), periods.tolist()))
            best = [
                max(rows[a:b], key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if a < b else None
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())
            ]
            strongest = pa.array([b and dict(zip(("start", "length", "period"), b)) for b in best], _RUN)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), each), strongest, collapsed,
                ],
                ["doc_id", "n_words", "runs", "strongest", "collapsed"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    run = "struct<start: long, length: long, period: long>"
    return map_batches(
        docs.select("doc_id", "text"), scan,
        f"doc_id {key}, n_words long, runs array<{run}>, strongest {run}, collapsed string",
    )
