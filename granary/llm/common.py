"""Helpers the operators share: tables in the shared folder, Arrow batches, word hashes."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import granary
from granary.session import materialize

#: What one Arrow batch may hold; very long texts make it fewer rows.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20

#: Objects that a worker process keeps between tasks.
KEPT = 12

#: ASCII upper case to lower case, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Write a table once to the shared folder and go on from there: it cuts the
#: lineage with files that every executor sees, and what is read several times is
#: worked out once.
stored = materialize


def prepared(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches in bytes and let this package travel inside the tasks."""
    cloudpickle.register_pickle_by_value(granary)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def map_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema
) -> DataFrame:
    prepared(df.sparkSession)
    return df.mapInArrow(function, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as Python strings, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


class WordHashes(dict):
    """64-bit hashes of byte strings; remembers the words met first, up to a bound."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (a fixed bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def kept(key: tuple, make: Callable[[], object]):
    """One object per worker process and key, made when first asked for; the oldest of more than KEPT go.

    Functions travel to the tasks by value, so a module's own variables are new
    in every task; what is slow to load is held by the interpreter instead.
    """
    store = sys.__dict__.setdefault("_granary_kept", {})
    if key not in store:
        if len(store) >= KEPT:
            del store[next(iter(store))]
        store[key] = make()
    return store[key]


def map_groups(df: DataFrame, key: str, function: Callable[[pa.Table], pa.RecordBatch], schema) -> DataFrame:
    """Apply a function to all rows of each key, for very many small groups.

    Rows are dealt by the key and sorted, and a task goes through its groups one
    after another, holding one at a time.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            keys = batch.column(key).to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts = np.concatenate([[0], cuts]) if len(keys) else []
            for start, end in zip(starts, np.append(cuts, len(keys))):
                if held and keys[start] != current:
                    yield function(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(start, end - start))
                current = keys[start]
        if held:
            yield function(pa.Table.from_batches(held))

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(df.repartition(parts, key).sortWithinPartitions(key), scan, schema)
