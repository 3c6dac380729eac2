"""Benchmark decontamination by a generalised suffix automaton.

The automaton of all normalised items tells, at every training token, the
longest suffix read so far that occurs in some item. Where that length reaches a
window, every token of it lies inside an occurrence.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import LOWER, kept, map_batches, stored, texts_of

WINDOW = 10
#: Words of items in one automaton; more items are worked through in blocks.
BLOCK_WORDS = 100_000
#: Tables of block hits that are brought into one, so that no plan has more of them.
MERGED_PARTS = 16

# Letters and digits in ASCII and everything above it are words; the rest parts them.
_WORD_BYTES = bytes(
    b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class SuffixAutomaton:
    """Of several word sequences; a state stands for the strings that end alike.

    `next[s]` maps a word to the following state, `link[s]` is the state of the
    longest shorter suffix, `length[s]` the longest string of s. `items[s]` are
    the items that hold a window ending in s, kept only where length allows it.
    """

    def __init__(self, items: Sequence[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.whole: dict[int, dict[int, list]] = {}
        self.items: dict[int, list] = {}
        for item, words in items:
            size = min(len(words), window)
            if not size:
                continue
            for state in {s for s, n in self.scan(words) if n >= size}:
                while self.link[state] >= 0 and self.length[self.link[state]] >= size:
                    state = self.link[state]
                if size == window:
                    self.items.setdefault(state, []).append(item)
                else:  # an item shorter than a window is one window of its own
                    self.whole.setdefault(state, {}).setdefault(size, []).append(item)
        self.ends = self._nearest_ends()

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new = self._state(self.length[last] + 1, {}, -1)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word: bytes, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, following: dict[bytes, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _nearest_ends(self) -> list[int]:
        """Per state, the nearest state on its suffix path that ends a window; -1 if none."""
        ends = [-1] * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            if s in self.items or s in self.whole:
                ends[s] = s
            elif s:
                ends[s] = ends[self.link[s]]
        return ends

    def scan(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Per word, the state and the length of the longest match that ends there."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(word, 0)
            length = length + 1 if state else 0
            yield state, length

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges [start, end) inside window occurrences, and the items found."""
        nexts, link, lengths, ends, window = self.next, self.link, self.length, self.ends, self.window
        root = nexts[0]
        spans: list[tuple[int, int]] = []
        found: set = set()
        state = length = 0
        for at, word in enumerate(words):
            if state:
                following = nexts[state].get(word)
                while following is None and state:
                    state = link[state]
                    length = lengths[state]
                    following = nexts[state].get(word)
                if following is None:
                    state = length = 0
                    continue
                state = following
                length += 1
            else:
                state = root.get(word, 0)
                if not state:
                    continue
                length = 1
            end = ends[state]
            if end < 0:
                continue
            if length >= window:
                spans.append((at + 1 - length, at + 1))
            while end >= 0:
                if length >= window and lengths[end] >= window and end in self.items:
                    found.update(self.items[end])
                for size, items in self.whole.get(end, {}).items():
                    if length >= size:
                        spans.append((at + 1 - size, at + 1))
                        found.update(items)
                end = ends[link[end]] if link[end] > 0 else -1
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _dealt(benchmark: DataFrame, block_words: int) -> tuple[int, Callable[[int], list[tuple[str, list[bytes]]]]]:
    """The number of blocks of about `block_words` item words, and a function that reads one of them.

    Items are dealt by a hash, so a block's size follows from the total; each
    block is small enough for a driver and a task, however many there are.
    """
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    total = items.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    count = max(1, -(-int(total) // block_words))

    def block(k: int) -> list[tuple[str, list[bytes]]]:
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()
        return sorted((r.item_id, words_of(r.text)) for r in rows)

    return count, block


def _automaton(shared, window: int, key: tuple) -> SuffixAutomaton:
    return kept(key, lambda: SuffixAutomaton(shared.value, window))


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Per (doc_id, text) row, which of its words occur in benchmark windows.

    Words are runs of ASCII letters and digits and all non-ASCII characters,
    A-Z lower-cased. A window is `window` consecutive words of an item, or all
    words of a shorter one. Columns doc_id, n_words, n_hit, spans (word ranges,
    start included, end not, merged and ascending) and items (ids as sorted
    strings).

    Null or empty texts have no words; null item ids read as empty strings;
    equal items count by their id; repeated documents each get their row. Empty
    tables on either side give no rows or no hits. Other columns are not looked
    at. With more than `block_words` words of items the documents are read once
    per block, one block after another: the driver and the tasks hold one block,
    its hits are written to the shared folder, and only rows with hits are
    brought together.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    schema = "doc_id long, text_hash long, n_words long, spans array<struct<start: long, end: long>>, items array<string>"
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    count, block = _dealt(benchmark, block_words)

    def scanned(shared) -> DataFrame:
        return map_batches(rows, _scanner(shared, window, ("automaton", uuid.uuid4().hex)), schema)

    if count == 1:
        return _counted(scanned(spark.sparkContext.broadcast(block(0)))).drop("text_hash")
    parts: list[DataFrame] = []
    for k in range(count):
        # A block's hits are written before the next block is read, so one block is held at a time.
        shared = spark.sparkContext.broadcast(block(k))
        parts.append(stored(scanned(shared).where(F.size("spans") > 0)))
        shared.destroy()
        if len(parts) == MERGED_PARTS:
            parts = [stored(reduce(DataFrame.unionByName, parts))]
    same = map_batches(rows, _count_words, "doc_id long, text_hash long, n_words long")
    hit = reduce(DataFrame.unionByName, parts)
    gathered = hit.groupBy(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), "text_hash").agg(
        F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    keyed = same.withColumns({"_id": F.coalesce("doc_id", F.lit(0)), "_none": F.col("doc_id").isNull()})
    joined = keyed.join(gathered, ["_id", "_none", "text_hash"], "left").drop("_id", "_none")
    return _counted(
        joined.withColumns({"spans": _merge_spans(F.coalesce("spans", F.array().cast("array<struct<start: long, end: long>>"))),
                            "items": F.coalesce("items", F.array().cast("array<string>"))})
    ).drop("text_hash")


def _merge_spans(spans):
    """Merge overlapping or touching ranges of an array, natively."""
    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")

    def step(done, x):
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(F.size(done) == 0, F.array(x)).when(
            x["start"] <= last["end"],
            F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined)),
        ).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), empty, step)


def _counted(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "text_hash", "n_words", hit.alias("n_hit"), "spans", "items")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = pa.array([len(words_of(t)) for t in texts_of(batch)], pa.int64())
        columns = [batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), counts]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_words"])


def _scanner(shared, window: int, key: tuple):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared, window, key)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            counts, spans, items = [], [], []
            for text in texts_of(batch):
                words = words_of(text)
                found, named = automaton.hits(words)
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in merged(found)])
                items.append(sorted(named))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array(counts, pa.int64()),
                    pa.array(spans, span), pa.array(items, pa.list_(pa.string())),
                ],
                ["doc_id", "text_hash", "n_words", "spans", "items"],
            )

    return scan


_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def cut(text: str, spans: list[tuple[int, int]], most: float | None) -> str | None:
    """The text without these word ranges; None where they cover all words or, if given, more than `most` of them."""
    at = [m.span() for m in _WORD.finditer(text)]
    covered = sum(b - a for a, b in spans)
    if covered == len(at) or most is not None and covered > most * len(at):
        return None
    for a, b in reversed(spans):
        text = text[: at[a][0]] + text[at[b - 1][1] :]
    return text


def cleaned(text: str, automaton: SuffixAutomaton, max_coverage: float) -> str | None:
    """The text without its hit word runs; None where they cover too much of it.

    What is left is looked at again, since a cut joins words that were apart.
    """
    most: float | None = max_coverage
    while text is not None and (spans := merged(automaton.hits(words_of(text))[0])):
        text, most = cut(text, spans, most), None
    return text


_KEYED_SPANS = "key string, spans array<struct<start: long, end: long>>"


def _united_spans(texts: DataFrame, count: int, block: Callable[[int], list], window: int) -> DataFrame:
    """key and the word ranges that items of any block hit, for the (key, text) rows with hits."""
    parts = []
    for k in range(count):
        shared = texts.sparkSession.sparkContext.broadcast(block(k))

        def scan(batches, shared=shared, key=("automaton", uuid.uuid4().hex)):
            automaton = _automaton(shared, window, key)
            for batch in batches:
                spans = [merged(automaton.hits(words_of(t))[0]) for t in texts_of(batch)]
                found = [[{"start": a, "end": b} for a, b in s] for s in spans]
                column = pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                hit = pa.array([bool(s) for s in spans], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("key").cast(pa.string()), column], ["key", "spans"]).filter(hit)

        parts.append(stored(map_batches(texts, scan, _KEYED_SPANS)))
        shared.destroy()
    hits = reduce(DataFrame.unionByName, parts)
    return stored(hits.groupBy("key").agg(F.flatten(F.collect_set("spans")).alias("spans")))


def _cut_by_blocks(
    docs: DataFrame, count: int, block: Callable[[int], list], window: int, max_coverage: float
) -> DataFrame:
    """What `cleaned` does with one automaton, where the items fill several.

    The hits of all blocks are united before a text is judged or cut, and every
    cut text goes through all blocks again until none hits it. Texts are worked
    on once each, by their digest; a round looks only at those the last one cut.
    """
    texts = docs.where("text is not null").select(F.sha2("text", 256).alias("key"), "text")
    done: list[DataFrame] = []
    most: float | None = max_coverage
    while True:
        spans = _united_spans(texts, count, block, window)
        if most is None:
            done.append(texts.join(spans, "key", "left_anti"))
        if spans.isEmpty():
            break

        def cutter(batches, most=most):
            for batch in batches:
                found = [merged([(s["start"], s["end"]) for s in x]) for x in batch.column("spans").to_pylist()]
                new = [cut(t, s, most) for t, s in zip(texts_of(batch), found)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").cast(pa.string()), pa.array(new, pa.string())], ["key", "text"]
                )

        hit = texts.join(spans, "key").dropDuplicates(["key"]).select("key", "text", "spans")
        left = stored(map_batches(hit, cutter, "key string, text string"))
        done.append(left.where("text is null"))
        texts, most = left.where("text is not null"), None
    if not done:
        return docs
    new = reduce(DataFrame.unionByName, done).select("key", F.struct("text").alias("new"))
    joined = docs.select(F.struct(*docs.columns).alias("doc"), F.sha2("text", 256).alias("key")).join(new, "key", "left")
    text = F.col("new")["text"]
    fresh = {"text": text, "n_chars": F.length(text)}
    return joined.where(F.col("new").isNull() | text.isNotNull()).select(
        *[
            F.when(F.col("new").isNotNull(), fresh[f.name].cast(f.dataType)).otherwise(F.col("doc")[f.name]).alias(f.name)
            if f.name in fresh else F.col("doc")[f.name].alias(f.name)
            for f in docs.schema
        ]
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_coverage: float = 0.5,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Documents without benchmark passages, all columns kept.

    Every run of hit words is cut out of the text. A document more than
    `max_coverage` of whose words are hit is dropped, as is one of which no word
    would be left. Documents without hits, also null and empty ones, pass as
    they are. If there is a column n_chars, it is brought up to date where the
    text changed. With more than `block_words` words of items the texts are read
    once per block and round of cuts; the result is the same.
    """
    names = docs.columns
    count, block = _dealt(benchmark, block_words)
    if count > 1:
        return _cut_by_blocks(docs, count, block, window, max_coverage)
    shared, key = docs.sparkSession.sparkContext.broadcast(block(0)), ("automaton", uuid.uuid4().hex)

    def clean(batches):
        automaton = _automaton(shared, window, key)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            new = [t and cleaned(t, automaton, max_coverage) for t in texts]
            keep = [t is None or n is not None for t, n in zip(texts, new)]
            changed = [t != n for t, n in zip(texts, new)]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(new, pa.string())
            if "n_chars" in names:
                at, old = names.index("n_chars"), batch.column("n_chars")
                counts = [len(n or "") if c else o for n, c, o in zip(new, changed, old.to_pylist())]
                columns[at] = pa.array(counts, old.type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, clean, docs.schema)
