"""Fill-in-the-middle examples: texts cut at line ends into prefix, middle and suffix.

The pieces are made by columns, batch by batch, in pyarrow: units as list arrays,
flattened with the row each belongs to, numbered within their row, filtered by the
part they fall to, put back into lists and joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import map_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 from the hash of `seed:doc_id`; a null id reads as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _modulo(a: pa.Array, n) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, n), n))


def parts_of(text: pa.Array, first: pa.Array, second: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
    """The number of lines of each text and its three parts.

    A line ends behind a line feed or at the end of the text. The prefix ends after
    the smaller of first % (n + 1) and second % (n + 1) lines, the middle after the
    larger.
    """
    lists = pc.split_pattern(text, "\n")
    units, parents = lists.flatten(), pc.list_parent_indices(lists)
    offsets = lists.offsets
    ordinal = pc.subtract(pa.array(range(len(units)), pa.int64()), offsets.take(parents).cast(pa.int64()))
    size = pc.list_value_length(lists).cast(pa.int64())
    # What stands behind the last line feed is a line only if it is not empty.
    closed = pc.or_(pc.equal(text, ""), pc.ends_with(text, "\n"))
    n = pc.subtract(size, closed.cast(pa.int64()))
    last = pc.equal(ordinal, pc.subtract(size, 1).take(parents))
    units = pc.if_else(last, units, pc.binary_join_element_wise(units, "\n", ""))
    a, b = _modulo(first, pc.add(n, 1)), _modulo(second, pc.add(n, 1))
    low, high = pc.min_element_wise(a, b), pc.max_element_wise(a, b)
    parts, zero = [], pc.multiply(n, 0)
    for begin, end in ((zero, low), (low, high), (high, n)):
        chosen = pc.and_(pc.greater_equal(ordinal, begin.take(parents)), pc.less(ordinal, end.take(parents)))
        sums = pc.cumulative_sum(pc.subtract(end, begin))
        bounds = pa.concat_arrays([pa.array([0], pa.int64()), sums]).cast(pa.int32())
        parts.append(pc.binary_join(pa.ListArray.from_arrays(bounds, units.filter(chosen)), ""))
    return n, parts


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = 100, suffix_first: int = 50) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n, form, prefix_chars, middle_chars, output.

    Of 100 documents about `rate` are rearranged, of these `suffix_first` in 100 with
    the suffix in front (`spm`), the others as prefix, suffix, middle (`psm`); the
    choice is a hash of the seed and doc_id. A text that is empty or null or holds a
    mark itself stays as it is (`plain`, its lengths null), so `restored` is exact.
    n counts the lines of every text, plain or not. Repeated rows each give a row;
    a null doc_id draws as an empty one; other columns are not looked at.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            text = pc.fill_null(batch.column("text"), "")
            h = [batch.column(f"h{i}") for i in range(1, 5)]
            n, (prefix, middle, suffix) = parts_of(text, h[0], h[1])
            plain = pc.equal(text, "")
            for mark in (PREFIX, SUFFIX, MIDDLE):
                plain = pc.or_(plain, pc.match_substring(text, mark))
            plain = pc.or_(plain, pc.greater_equal(_modulo(h[2], 100), rate))
            front = pc.less(_modulo(h[3], 100), suffix_first)
            form = pc.if_else(plain, "plain", pc.if_else(front, "spm", "psm"))
            psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
            spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
            output = pc.if_else(plain, text, pc.if_else(front, spm, psm))
            none = pa.scalar(None, pa.int64())
            chars = [pc.if_else(plain, none, pc.utf8_length(p).cast(pa.int64())) for p in (prefix, middle)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), n, form, *chars, output],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    drawn = [h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed), 1)]
    return map_batches(
        docs.select("doc_id", "text", *drawn), scan,
        f"doc_id {key}, n long, form string, prefix_chars long, middle_chars long, output string",
    )


def restored(form: Column, output: Column) -> Column:
    """The text again: both forms have its parts behind their marks, the middle last."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    ends = {"psm": (1, 2), "spm": (2, 1)}
    whole = {k: F.concat(parts[p], parts[3], parts[s]) for k, (p, s) in ends.items()}
    return F.when(form == "psm", whole["psm"]).when(form == "spm", whole["spm"]).otherwise(output)
