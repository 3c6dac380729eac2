"""Packing token sequences by best-fit decreasing.

Documents become token ids with a closing id; what is longer than a window is
first cut into full windows, and only the rest of each document, always shorter
than a window, is packed: longest first, each into the open window that it fills
best, found in a segment tree indexed by remaining capacity.

The rests are dealt into shards of bounded size by a hash, and each shard is
packed by itself, so a task holds `SHARD_PIECES` small rows whatever the corpus
holds. A shard leaves at most a few windows part-filled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import map_batches, stored, texts_of
from granary.llm.tokenizing import Encoder

WINDOW = 1024
SHARD_PIECES = 20_000
END_ID = 0

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Segment tree over remaining capacities 0..size; finds the least that is enough.

    A leaf counts the open windows with that capacity, an inner node the sum of
    its children.
    """

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, change: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += change
            at >>= 1

    def least_from(self, capacity: int) -> int:
        """The least capacity, `capacity` or more, of an open window; -1 if none."""
        at = capacity + self.leaves
        if self.count[at]:
            return capacity
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each length; lengths are between 1 and window."""
    tree, open_at = CapacityTree(window), [[] for _ in range(window + 1)]
    number, offset, used = [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        capacity = tree.least_from(lengths[i])
        if capacity < 0:
            at, capacity, used = used, window, used + 1
        else:
            at = open_at[capacity].pop()
            tree.add(capacity, -1)
        number[i], offset[i] = at, window - capacity
        if capacity > lengths[i]:
            open_at[capacity - lengths[i]].append(at)
            tree.add(capacity - lengths[i], 1)
    return number, offset


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Each document's ids, cut into full windows and a rest: one row per piece.

    Columns doc_id, start, length, ids_crc32 and doc_tokens, and `whole` (the
    piece fills a window). `tokenizer` is the path of a vocabulary file.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                ids = encoder.packed_ids(text) + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), n))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return map_batches(docs.select("doc_id", "text"), cut, PIECES)


def pack(pieces: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add sequence_id and offset to rows with a `length` between 1 and window.

    Pieces of `window` fill a sequence of their own. The others are packed in
    shards of about `shard_pieces` rows, dealt by a hash of their place in the table. Sequences are numbered
    from 0 without gaps within each shard and are unique over all. The input is
    written once to the shared folder, since its size fixes the shards, and read
    back in the same order however often a task is repeated.

    Repeated rows are packed each. An empty table gives an empty one.
    """
    kept = pieces.columns
    pieces = stored(pieces)
    spark = pieces.sparkSession
    rests = pieces.where(F.col("length") < window).count()
    shards = max(1, -(-rests // shard_pieces))
    full = pieces.where(F.col("length") >= window).withColumns(
        # Odd numbers are full windows, even ones come from the shards.
        {"sequence_id": 2 * F.monotonically_increasing_id() + 1, "offset": F.lit(0).cast("long")}
    )
    fields = [f for f in pieces.schema.fields]
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def place(key, table):
        order = np.lexsort([table.column(c).to_numpy(zero_copy_only=False) for c in ("ids_crc32", "start", "doc_id")]) if (
            {"ids_crc32", "start", "doc_id"} <= set(kept)
        ) else np.arange(table.num_rows)
        table = table.take(pa.array(order)).drop_columns(["shard"])
        number, offset = best_fit_decreasing(table.column("length").to_pylist(), window)
        number = 2 * (np.array(number, np.int64) * shards + key[0].as_py())
        table = table.append_column("sequence_id", pa.array(number, pa.int64()))
        return table.append_column("offset", pa.array(offset, pa.int64()))

    # By place in the written table, not by content: copies of one row part like any rows.
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))
    packed = (
        pieces.where(F.col("length") < window)
        .withColumn("shard", shard)
        .groupBy("shard")
        .applyInArrow(place, f"{names}, sequence_id long, offset long")
    )
    return packed.unionByName(full.select(*packed.columns))


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Tokenize and pack (doc_id, text) rows; one row per piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A
    null or empty text has the closing id only. A null doc_id stays null.
    Repeated rows and equal texts are packed each. Other columns are not looked
    at.
    """
    return pack(token_pieces(docs, tokenizer, window), window, shard_pieces)
