"""Document fingerprints: Merkle trees over words, paragraphs and sections.

Words are the leaves. A hash of a word and the one before it says how many levels
of the tree end behind it; the end of a paragraph ends at least PARAGRAPH levels,
and some paragraph ends, by the same hash, end a section and more. So where nodes
begin and end depends on the text around that place only, and an edit changes the
nodes on its path to the root and no others. Equal roots mean equal texts, and
where two trees differ, the differing branches show where the texts do.

A fingerprint is the root and one level of the tree, the finest with at most
NODES nodes; from its nodes all coarser levels follow, so any two fingerprints
can be compared.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import WordHashes, kept, map_batches, mixed, texts_of

PARAGRAPH = 4
NODES = 64
TOP = 40

_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"
_DIGIT_BYTES = np.frombuffer(_DIGITS.encode(), np.uint8)
_WIDTH = 11  # ten digits of a node's hash, one for how many levels end behind it


def _leaves(text: str, words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the number of levels that end behind it.

    Words are parted by single blanks and behind line breaks, so that the words
    determine the text.
    """
    parts = text.encode("utf-8", "surrogatepass").replace(b"\n", b"\n ").split(b" ") if text else []
    h = words.of(parts)
    before = np.concatenate([np.zeros(1, np.uint64), h[:-1]]) if len(h) else h
    b = mixed(h + np.uint64(3) * before)
    zeros = np.bitwise_count((b & (~b + np.uint64(1))) - np.uint64(1)).astype(np.int64)
    ends = np.array([p.endswith(b"\n") for p in parts], bool) if "\n" in text else np.zeros(len(h), bool)
    return mixed(h) >> np.uint64(4), np.minimum(np.where(ends, PARAGRAPH + zeros, zeros), TOP)


def _parents(nodes: np.ndarray, levels: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes one level up: those of the given level, from their children."""
    last = levels >= level
    last[-1] = True
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(nodes)) - np.repeat(starts, ends - starts + 1)
    each = mixed(nodes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mixed(np.add.reduceat(each, starts) + np.uint64(level)) >> np.uint64(4), levels[ends]


def tree_levels(text: str, words: WordHashes | None = None) -> list[np.ndarray]:
    """All levels of a text's tree, from its words to the root; empty for no text."""
    nodes, levels = _leaves(text, words if words is not None else WordHashes())
    out = [nodes] if len(nodes) else []
    while out and len(out[-1]) > 1:
        nodes, levels = _parents(nodes, levels.copy(), len(out))
        out.append(nodes)
    return out


def fingerprint(text: str, words: WordHashes) -> str:
    """`ROOT:LEVEL:NODES` of a text; `0:0:` of the empty one."""
    nodes, levels = _leaves(text, words)
    if not len(nodes):
        return "0:0:"
    level = 0
    while len(nodes) > NODES:
        level += 1
        nodes, levels = _parents(nodes, levels.copy(), level)
    digits = np.empty((len(nodes), _WIDTH), np.uint8)
    for k in range(10):
        digits[:, k] = (nodes >> np.uint64(6 * k)).astype(np.int64) & 63
    digits[:, 10] = levels
    root = xxhash.xxh3_128_hexdigest(nodes.tobytes() + bytes([level]))
    return f"{root}:{level}:{_DIGIT_BYTES[digits].tobytes().decode()}"


def parsed(print_: str) -> tuple[str, int, np.ndarray, np.ndarray]:
    root, level, body = print_.split(":")
    value = kept(("digits",), lambda: np.array([max(0, _DIGITS.find(chr(c))) for c in range(128)], np.uint64))
    rows = value[np.frombuffer(body.encode(), np.uint8)].reshape(-1, _WIDTH)
    nodes = np.zeros(len(rows), np.uint64)
    for k in range(10):
        nodes |= rows[:, k] << np.uint64(6 * k)
    return root, int(level), nodes, rows[:, 10].astype(np.int64)


def _aligned(one: str, other: str) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of two fingerprints at the finest level that both have."""
    sides = [parsed(one), parsed(other)]
    top = max(s[1] for s in sides)
    out = []
    for _, level, nodes, levels in sides:
        while level < top and len(nodes):
            level += 1
            nodes, levels = _parents(nodes, levels.copy(), level)
        out.append(nodes)
    return out[0], out[1]


def likeness(one: str, other: str) -> float:
    """Share of nodes that two fingerprints have in common, from 0 to 1."""
    if one == other:
        return 1.0
    a, b = _aligned(one, other)
    both = sum((Counter(a.tolist()) & Counter(b.tolist())).values())
    return 2 * both / (len(a) + len(b)) if len(a) + len(b) else 1.0


def differing(one: str, other: str) -> list[int]:
    """Numbers of the nodes of `one`, at the common level, that `other` lacks."""
    a, b = _aligned(one, other)
    return np.flatnonzero(~np.isin(a, b)).tolist()


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of each (doc_id, text) row; null text is empty."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(("words",), WordHashes)
        for batch in batches:
            texts = texts_of(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([fingerprint(t, words) for t in texts], pa.string()),
                ],
                ["doc_id", "n_chars", "fingerprint"],
            )

    return map_batches(docs.select("doc_id", "text"), compute, "doc_id long, n_chars long, fingerprint string")


RESULT = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]
_TYPES = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(doc, text: str, own: str, following: str, its: str, words: WordHashes) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    print_ = fingerprint(edited, words)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc, len(text), digest, own, print_, likeness(own, print_), likeness(own, its)


def neighbour_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each (doc_id, text) row, of the text edited from the next one, and their likeness.

    The edited text has the last floor(n / 2) code points replaced by the first as
    many (or all) of the next row's; rows follow one another by doc_id, nulls
    first, ties by a hash of the text, and the last is followed by the first. A
    null text is empty, two empty texts are alike (1), an empty table gives an
    empty one, other columns are not looked at.

    One range partitioning brings the texts in order, and a task works through its
    stretch row by row. The first and last row of every stretch, two per
    partition, are joined up by themselves; both read the same shuffle.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("at"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"),
    )
    ordered = rows.repartitionByRange(parts, "at", "tie").sortWithinPartitions("at", "tie", "text")
    names, types = zip(*RESULT)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(("words",), WordHashes)
        last = None
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = fingerprint(text, words)
                if last is not None:
                    out.append(_edited(*last, text, own, words))
                last = (doc, text, own)
            yield _batch(out, names, types)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is None:
                yield batch.slice(0, 1).append_column("place", pa.array([0], pa.int32()))
            last = batch.slice(batch.num_rows - 1)
        if last is not None:
            yield last.append_column("place", pa.array([1], pa.int32()))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(("words",), WordHashes)
        for batch in batches:
            out = [
                _edited(doc, text, fingerprint(text, words), after, fingerprint(after, words), words)
                for doc, text, after in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")))
            ]
            yield _batch(out, names, types)

    done = map_batches(ordered, walk, _TYPES)
    seams = map_batches(ordered, ends, "doc_id long, text string, at long, tie long, place int")
    # Two rows per partition: behind the last row of one stands the first of the next.
    order = Window.orderBy("at", "tie", "place")
    very_first = F.first("text").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = F.coalesce(F.lead("text").over(order), very_first)
    joined = seams.withColumn("following", following).where("place = 1").select("doc_id", "text", "following")
    return done.unionByName(map_batches(joined, close, _TYPES))


def _batch(rows: list[tuple], names: tuple, types: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], list(names))
