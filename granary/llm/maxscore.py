"""Exact top-k search by MaxScore over quantised vectors.

A dimension with a sign is a term: its postings are the vectors whose component
has that sign, its bound for a query the product of the query's component and the
largest such component. A query has one term per component, that of the same sign;
components of the other sign only lower a score.

Rows lie in shards of bounded bytes. In its own shard a query starts without a
threshold; with the k-th best score found there it goes to every other shard. Terms
are ordered by bound. The last ones whose bounds together stay below the threshold
are non-essential: no vector can compete by these alone, so only the postings of
the others are traversed. Vectors whose sum so far plus the bounds left still
reaches the threshold are probed, term by term, in the non-essential ones, and
what remains is scored in full. The shards' best are merged at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import map_batches, stored

#: What the vectors of one shard may take, and how many there may be.
SHARD_BYTES, SHARD_ROWS = 16 << 20, 65_536
#: A shard of fewer rows than this is not worth a task of its own.
LEAST_ROWS = 1_024
#: Quantised components lie within this bound, so that sums of products fit 64 bits.
LARGEST = 1 << 24


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as a double; null where one is null or not finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clipped = F.transform(
        vector, lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), scale * x.cast("double")))).cast("int")
    )
    return F.when(vector.isNotNull() & sound, clipped)


class Shard:
    """The vectors of a shard, and their postings by dimension and sign."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix.astype(np.int64)
        #: A posting list kept as a column: the impact of every vector, 0 where it is not in the list.
        self.lists = [np.ascontiguousarray(np.maximum(sign * self.matrix, 0).T) for sign in (1, -1)]
        self.bounds = [x.max(axis=1) if x.size else np.zeros(len(x), np.int64) for x in self.lists]

    def postings(self, query: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """The query's terms that occur: bound, weight, impacts; the largest bounds first."""
        terms = []
        for d in np.flatnonzero(query).tolist():
            side = int(query[d] < 0)
            weight = abs(int(query[d]))
            if bound := weight * int(self.bounds[side][d]):
                terms.append((bound, weight, self.lists[side][d]))
        return sorted(terms, key=lambda t: -t[0])

    def search(self, query: np.ndarray, threshold: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all vectors whose score reaches the threshold."""
        everything = np.arange(len(self.matrix))
        if threshold is None or threshold <= 0:
            # Vectors without a posting of the query compete as well.
            scores = self.matrix @ query
            reached = everything if threshold is None else np.flatnonzero(scores >= threshold)
            return reached, scores[reached]
        terms = self.postings(query)
        rest = np.cumsum([0, *[t[0] for t in reversed(terms)]])[::-1]  # of the terms from each on
        if rest[0] < threshold:
            return everything[:0], everything[:0]
        essential = int(np.flatnonzero(rest < threshold)[0])
        sums = np.zeros(len(self.matrix), np.int64)
        for _, weight, impacts in terms[:essential]:
            sums += weight * impacts
        alive = np.flatnonzero(sums >= max(1, threshold - int(rest[essential])))
        sums = sums[alive]
        for j in range(essential, len(terms)):
            if len(alive) == 0:
                break
            _, weight, impacts = terms[j]
            sums += weight * impacts[alive]
            competes = sums >= threshold - int(rest[j + 1])
            alive, sums = alive[competes], sums[competes]
        scores = self.matrix[alive] @ query
        reached = scores >= threshold
        return alive[reached], scores[reached]


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """The k best other rows for each query: query_id, rank (from 1), vec_id, score.

    `vectors` has vec_id and embedding; queries are the rows whose vec_id is
    divisible by `every`. The score is the inner product of floor(scale * x), ties
    go to the smaller vec_id (a null vec_id last; such a row is found, but asks
    nothing). Fewer than k other rows give all. Rows whose vector is null or holds a
    null or non-finite component take no part. Vectors of different lengths are
    compared as if the shorter went on with zeros, an empty one scores 0 with all.
    Quantised components are held within +-2^24. Of repeated rows each is a row:
    it asks for itself and is found by the others. An empty table gives no rows;
    other columns are not looked at.

    Vectors and queries are written once, by shard. Each pair of a query block and a
    shard is worked on by itself, so memory is bounded by SHARD_BYTES at any size.
    """
    spark = vectors.sparkSession
    key = vectors.schema["vec_id"].dataType.simpleString()
    sound = vectors.select("vec_id", quantised(F.col("embedding"), scale).alias("v")).where("v is not null")
    rows, dims = sound.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dims = max(dims, 1)
    held = max(1, min(shard_rows, SHARD_BYTES // (4 * dims)))
    least = min(spark.sparkContext.defaultParallelism, -(-rows // min(held, LEAST_ROWS)))
    n_shards = max(1, -(-rows // held), least)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each task's vectors: shard, ids, values row by row."""
        ids, parts = [], []
        for batch in batches:
            lists = batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            block = np.zeros((len(sizes), dims), np.int32)
            block[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy()
            ids.append(batch.column("vec_id"))
            parts.append(block)
        if parts:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([TaskContext.get().partitionId()], pa.int64()), _listed(pa.concat_arrays(ids)),
                    pa.array([np.concatenate(parts).tobytes()], pa.binary()),
                ],
                ["shard", "ids", "matrix"],
            )

    shards = stored(map_batches(sound.repartition(n_shards), build, f"shard long, ids array<{key}>, matrix binary"))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shard's queries, with what their own shard has for them."""
        for batch in batches:
            for i in range(batch.num_rows):
                names = batch.column("ids")[i].values
                shard = Shard(_matrix(batch.column("matrix"), i, dims))
                asking = np.flatnonzero(names.is_valid().to_numpy(False) & (_filled(names) % every == 0))
                found = _Found(names, k)
                limits = []
                for j, place in enumerate(asking.tolist()):
                    places, scores = shard.search(shard.matrix[place], None)
                    least = found.add(j, np.delete(places, place), np.delete(scores, place))
                    limits.append(least)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("shard").slice(i, 1), _listed(names.take(pa.array(asking))),
                        pa.array([shard.matrix[asking].astype(np.int32).tobytes()], pa.binary()),
                        _listed(pa.array(limits, pa.int64())), _listed(found.rows(names.take(pa.array(asking)))),
                    ],
                    ["home", "asking", "queries", "limits", "found"],
                )

    row = f"struct<place: long, query_id: {key}, vec_id: {key}, score: long>"
    blocks = stored(
        map_batches(shards, start, f"home long, asking array<{key}>, queries binary, limits array<long>, found array<{row}>")
    )

    # Blocks of queries are small and go to every shard; the shards are moved once.
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long")), lambda s: s != F.col("home"))
    cells = blocks.where(F.size("asking") > 0).select("home", "asking", "queries", "limits", F.explode(others).alias("shard"))

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block of queries against another shard; blocks of one shard follow each other."""
        at, shard = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if (here := batch.column("shard")[i].as_py()) != at:
                    at, shard = here, Shard(_matrix(batch.column("matrix"), i, dims))
                found = _Found(batch.column("ids")[i].values, k)
                queries = _matrix(batch.column("queries"), i, dims).astype(np.int64)
                for j, limit in enumerate(batch.column("limits")[i].as_py()):
                    found.add(j, *shard.search(queries[j], limit))
                rows = found.rows(batch.column("asking")[i].values)
                yield pa.RecordBatch.from_arrays([batch.column("home").slice(i, 1), _listed(rows)], ["home", "found"])

    elsewhere = map_batches(cells.join(shards.hint("merge"), "shard"), go_on, f"home long, found array<{row}>")
    each = blocks.select("home", "found").unionByName(elsewhere).select("home", F.inline("found"))
    best = Window.partitionBy("home", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


class _Found:
    """The k best of one shard for each query of a block."""

    def __init__(self, names: pa.Array, k: int):
        self.names, self.order, self.k = names, _filled(names), k
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, query: int, places: np.ndarray, scores: np.ndarray) -> int | None:
        """Keep the best, ties to the smaller id (null last); the k-th score, if there are k."""
        k = self.k
        if len(scores) > k:
            chosen = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
            places, scores = places[chosen], scores[chosen]
        best = np.lexsort((self.order[places], -scores))[:k]
        self.parts.append((np.full(len(best), query), places[best], scores[best]))
        return int(scores[best[-1]]) if len(best) == k else None

    def rows(self, asking: pa.Array) -> pa.Array:
        query, places, scores = (np.concatenate(x).astype(np.int64) for x in zip(*self.parts, ([], [], [])))
        fields = [pa.array(query), asking.take(pa.array(query)), self.names.take(pa.array(places)), pa.array(scores)]
        return pa.StructArray.from_arrays(fields, ["place", "query_id", "vec_id", "score"])


def _filled(names: pa.Array) -> np.ndarray:
    """Ids for comparison; a null one is the largest."""
    return names.fill_null(np.iinfo(names.type.to_pandas_dtype()).max).to_numpy(zero_copy_only=False)


def _listed(values: pa.Array) -> pa.Array:
    """A column of one row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _matrix(column: pa.Array, row: int, dims: int) -> np.ndarray:
    return np.frombuffer(column[row].as_buffer(), np.int32).reshape(-1, dims)
