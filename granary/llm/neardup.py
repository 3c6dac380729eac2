"""Near-duplicates by an LSH forest over MinHash signatures.

Every set of five-word shingles gets `HASHES` minimum hashes. A tree of the
forest is the order of all signatures that begins at its own place in the
signature; documents that stand near one another in a tree and share at least
`DEPTH` leading hashes are candidates. A tree is a range-partitioned, sorted
table: in sparse regions a document meets all that share `DEPTH` hashes, in dense
ones its nearest `REACH` neighbours on either side, whose common prefixes are
longer, so the depth adapts to the region while memory and work per document stay
bounded. Ranges cut dense regions anywhere, so none lands in one task.

Candidates that their signatures put near enough join documents into clusters.
Inside clusters, links are confirmed on the full shingle sets, and only those
make the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import LOWER, WordHashes, kept, map_batches, map_groups, mixed, stored, texts_of
from granary.llm.components import connected_components

SHINGLE = 5
#: A link needs 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
#: 32 trees that share 4 hashes: two sets at 0.75 miss each other once in 190,000 times.
TREES, DEPTH, DEEPER = 32, 4, 4
HASHES = TREES * DEPTH
#: Neighbours on either side that a document meets in a dense region.
REACH = 1_024
#: Estimate from two bits of each hash, 4.5 standard errors below the threshold.
BITS = 2
LEAST_ESTIMATE = 0.54
#: Documents of a cluster that one task compares with others at a time.
BLOCK = 128
#: Documents of many links that all blocks of a large cluster meet first.
HUBS = 8

#: Up to so many cluster members (16 bytes each) are sent to every task.
BROADCAST_MEMBERS = 1_000_000

_rng = np.random.default_rng(20)
_FLIP = _rng.integers(0, 1 << 32, HASHES, np.uint32)
_ODD = _rng.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, words: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles of a whole text.

    Words are runs of anything but ASCII white space, A-Z lower-cased. With fewer
    than five words the whole sequence is the one shingle; without words, none.
    """
    parts = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    return np.empty(0, np.uint64) if not parts else _shingles(words.of(parts))


def _shingles(h: np.ndarray) -> np.ndarray:
    size = min(SHINGLE, len(h))
    value = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        value = (value + h[i : len(h) - size + 1 + i]) * _STEP
        value ^= value >> np.uint64(31)
    return np.unique(mixed(value))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum hashes of non-empty sets, one row each."""
    ends = np.cumsum([len(s) for s in sets])
    starts = np.concatenate([[0], ends[:-1]])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((x ^ _FLIP[k]) * _ODD[k], starts)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash (of the whole set; null if empty) and signature."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(("words",), WordHashes)
        for batch in batches:
            sets = [shingle_set(t, words) for t in texts_of(batch)]
            full = [s for s in sets if len(s)]
            rows = iter(_in_chunks(full))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_hash", "signature"],
            )

    schema = "doc_id long, n_shingles long, set_hash binary, signature binary"
    return map_batches(docs.select("doc_id", "text"), sketch, schema)


def _in_chunks(sets: list[np.ndarray], most: int = 1 << 17) -> Iterator[np.ndarray]:
    """Signature rows, worked out for about `most` shingles at a time."""
    group, size = [], 0
    for s in sets:
        group.append(s)
        size += len(s)
        if size >= most:
            yield from signatures(group)
            group, size = [], 0
    if group:
        yield from signatures(group)


def tree_rows(found: DataFrame) -> DataFrame:
    """One row per document and tree: tree, head, deeper, sketch, doc_id.

    head is a hash of the DEPTH leading values of the tree's order, deeper the
    leading bytes of the next ones, sketch BITS bits of every value.
    """

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(n, HASHES)
            low = (mixed(sig.astype(np.uint64)) & np.uint64(3)).astype(np.uint8)
            packed = low[:, 0::4] | low[:, 1::4] << 2 | low[:, 2::4] << 4 | low[:, 3::4] << 6
            sketch = [r.tobytes() for r in np.ascontiguousarray(packed)]
            # Low bits of a minimum are even, its high bits are nearly all zero.
            turned = (sig.astype(np.uint64) * _STEP >> np.uint64(32)).astype(np.uint32)
            for tree in range(TREES):
                lead = sig[:, tree * DEPTH : (tree + 1) * DEPTH].astype(np.uint64)
                head = np.full(n, tree + 1, np.uint64)
                for j in range(DEPTH):
                    head = mixed((head ^ lead[:, j]) * _STEP)
                at = [(tree * DEPTH + DEPTH + j) % HASHES for j in range(DEEPER)]
                deep = (turned[:, at] >> np.uint32(17)).astype(np.uint64)
                deeper = deep[:, 0] << 45 | deep[:, 1] << 30 | deep[:, 2] << 15 | deep[:, 3]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(head.view(np.int64)), pa.array(deeper.astype(np.int64)),
                        pa.array(sketch, pa.binary()), batch.column("doc_id"),
                    ],
                    ["head", "deeper", "sketch", "doc_id"],
                )

    schema = "head long, deeper long, sketch binary, doc_id long"
    return map_batches(found.select("doc_id", "signature"), grow, schema)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal hashes that the two-bit values of rows a and b suggest."""
    x = a ^ b
    differ = np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.int64)
    equal = 1 - differ / HASHES
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def forest_edges(trees: DataFrame) -> DataFrame:
    """Candidate edges (a, b) that join what stands near in some tree's order.

    Of the near pairs that a stretch of an order shows, only a forest that joins
    the same documents is passed on, so the edges grow with the rows, not with
    the squares of groups.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def edges(heads, ids, bits, fresh: int) -> pa.RecordBatch:
            """Compare sorted rows; those before `fresh` were compared with one another."""
            out: list[tuple[int, int]] = []
            cuts = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1], [True]]))
            sizes = np.diff(cuts)
            for start, size in zip(cuts[:-1][sizes > 1], sizes[sizes > 1]):
                out += _joined(ids[start : start + size], bits[start : start + size], max(0, fresh - start))
            a, b = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            heads = batch.column("head").to_numpy()
            ids = batch.column("doc_id").to_numpy()
            bits = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(len(ids), -1)
            before = 0
            if held:
                tail = held.pop()
                before = len(tail[0])
                heads, ids, bits = (np.concatenate(p) for p in zip(tail, (heads, ids, bits)))
            yield edges(heads, ids, bits, before)
            # The rows that the next batch may still go on from.
            keep = min(len(heads) - int(np.searchsorted(heads, heads[-1])), REACH)
            held.append((heads[-keep:], ids[-keep:], bits[-keep:]))

    parts = max(int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = trees.repartitionByRange(parts, "head", "deeper").sortWithinPartitions("head", "deeper", "doc_id")
    return map_batches(ordered, scan, "a long, b long").distinct()


def _joined(ids: np.ndarray, bits: np.ndarray, fresh: int) -> list[tuple[int, int]]:
    """Star edges over the parts that near pairs within REACH of one another make."""
    n = len(ids)
    root = np.arange(n)
    for i in range(max(fresh, 1), n):
        start = max(0, i - REACH)
        near = start + np.flatnonzero(_agreement(bits[start:i], bits[i]) >= LEAST_ESTIMATE)
        for r in np.unique(root[near]):
            if r != root[i]:
                low, high = min(r, root[i]), max(r, root[i])
                root[root == high] = low
    out = []
    for r in np.unique(root[np.flatnonzero(root != np.arange(n))]):
        part = ids[root == r]
        least = int(part.min())
        out += [(least, int(x)) for x in part if x != least]
    return out


def _intersections(sets: list[np.ndarray], columns: int = 1 << 14) -> np.ndarray:
    """Sizes of all pairwise intersections, some columns of shingles at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place, copies = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = copies > 1
    column = np.cumsum(shared) - 1
    keep = shared[place]
    owner, place = owner[keep], column[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    for start in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(place, [start, start + columns])
        block = np.zeros((len(sets), columns), np.float32)
        block[owner[a:b], place[a:b] - start] = 1
        total += block @ block.T
    return total.astype(np.int64)


def _links(ids: np.ndarray, texts: list[str], probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of confirmed links, of probes with others where there are probes."""
    words = kept(("words",), WordHashes)
    sets = [shingle_set(t, words) for t in texts]
    sizes = np.array([len(s) for s in sets])
    both = _intersections(sets)
    linked = 100 * both >= SIMILARITY * (sizes[:, None] + sizes[None, :] - both)
    if probe.any():
        linked &= probe[:, None] | probe[None, :]
    i, j = np.nonzero(np.triu(linked, 1))
    return i, j


def _confirmed(rows: DataFrame) -> DataFrame:
    """Edges a, b and the degree of a in its group, for (key, doc_id, text, probe) rows.

    One edge per document that has any link in its group: to the least id of its
    connected part there.
    """

    def compare(table: pa.Table) -> pa.RecordBatch:
        ids = table.column("doc_id").to_numpy()
        probe = table.column("probe").to_numpy(zero_copy_only=False)
        i, j = _links(ids, table.column("text").to_pylist(), probe)
        degree = np.bincount(np.concatenate([i, j]), minlength=len(ids))
        root = np.arange(len(ids))
        for a, b in zip(i, j):
            if root[a] != root[b]:
                root[root == root[b]] = root[a]
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, root, ids)
        on = degree > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[on]), pa.array(least[root][on]), pa.array(degree[on].astype(np.int64))], ["a", "b", "degree"]
        )

    return map_groups(rows, "key", compare, "a long, b long, degree long")


def confirmed_links(docs: DataFrame, clusters: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect, within each cluster, what confirmed links connect.

    `clusters` has node and label. A cluster is cut into blocks of about `block`
    documents. First all pairs within a block are compared, in one task and
    without being written; then a few documents of many links are compared with
    all blocks, which joins the bulk of a large cluster; then every document
    still outside its cluster's largest part is compared with all blocks. So no
    pair that could join two parts is left out, and a large, well-linked cluster
    costs in proportion to its size.
    """
    sizes = clusters.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    members = clusters.join(sizes, "label").select(
        F.col("node").alias("doc_id"), "label", F.ceil(F.col("size") / block).alias("blocks")
    )
    # Few members go to the texts, so that only theirs are moved; many meet by a shuffle.
    members = F.broadcast(members) if clusters.count() <= BROADCAST_MEMBERS else members
    rows = stored(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(members, "doc_id")
    ).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    first = stored(
        _confirmed(rows.select(F.xxhash64("label", "block").alias("key"), "doc_id", "text", F.lit(False).alias("probe")))
    )
    large = rows.where("blocks > 1")
    edges = first.select("a", "b")
    if large.isEmpty():
        return edges
    # The documents with most links, HUBS per large cluster.
    best = first.groupBy("a").agg(F.max("degree").alias("degree"))
    hubs = best.join(large.select(F.col("doc_id").alias("a"), "label", "block").distinct(), "a")
    for part in (["label", "block"], ["label"]):  # the best of each block, then of those
        order = Window.partitionBy(*part).orderBy(F.desc("degree"), "a")
        hubs = hubs.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= HUBS)
    hubs = hubs.select("label", F.col("a").alias("doc_id"))
    second = stored(_confirmed(_probed(large, hubs, block))).select("a", "b")
    edges = edges.unionByName(second)
    # What is not in the largest part of its cluster yet.
    parts = connected_components(edges)
    placed = large.select("label", "doc_id").distinct().join(
        parts.withColumnRenamed("label", "part"), F.col("doc_id") == F.col("node"), "left"
    ).select("label", "doc_id", F.coalesce("part", "doc_id").alias("part"))
    counts = placed.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("label").agg(F.max(F.struct("n", F.col("part").alias("main")))["main"].alias("main"))
    rest = placed.join(main, "label").where("part <> main").select("label", "doc_id")
    third = stored(_confirmed(_probed(large, stored(rest), block))).select("a", "b")
    return edges.unionByName(third)


def _probed(rows: DataFrame, probes: DataFrame, block: int) -> DataFrame:
    """Each block of a cluster with each chunk of the cluster's probes."""
    counts = probes.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / (2 * block)).alias("chunks"))
    members = rows.join(counts, "label").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    ).withColumn("probe", F.lit(False))
    chosen = rows.join(probes.join(counts, "label"), ["label", "doc_id"]).withColumns(
        {"chunk": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("chunks")), "probe": F.lit(True)}
    ).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keyed = [
        d.select(F.xxhash64("label", "block", "chunk").alias("key"), "doc_id", "text", "probe") for d in (members, chosen)
    ]
    return keyed[0].unionByName(keyed[1])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Group (doc_id, text) rows by links of shingle sets with a Jaccard likeness of 0.75 or more.

    Returns one row per input row: doc_id, n_shingles, component_id (the smallest
    doc_id that links reach, its own included) and kept (it is that document).

    Documents without words (null or empty texts too) have no shingles and no
    links. Equal sets are one node of the search. Rows that share a doc_id are
    one document with several texts. A null doc_id cannot name a component: such
    a row keeps a null component_id, is not linked and is kept. An empty table
    gives an empty one. Other columns are not looked at.
    """
    found = stored(sketches(docs))
    named = found.where("set_hash is not null and doc_id is not null")
    sets = stored(
        named.groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"))
    )
    clusters = stored(connected_components(forest_edges(tree_rows(sets))))
    # Rows that share a doc_id are one document, whatever their sets.
    least = sets.select("set_hash", F.col("doc_id").alias("least"))
    several = named.groupBy("doc_id").agg(F.min("set_hash").alias("lo"), F.max("set_hash").alias("hi")).where("lo <> hi")
    tied = named.join(several.select("doc_id"), "doc_id").join(least, "set_hash").select(
        F.col("doc_id").alias("a"), F.col("least").alias("b")
    )
    links = confirmed_links(docs.where("text is not null and doc_id is not null"), clusters)
    labels = connected_components(links.unionByName(tied))
    reached = named.select("doc_id", "n_shingles", "set_hash").join(least, "set_hash").join(
        labels, F.col("least") == F.col("node"), "left"
    )
    linked = reached.select("doc_id", "n_shingles", F.coalesce("label", "least").alias("component_id"))
    alone = found.where("set_hash is null or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
