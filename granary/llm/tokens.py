"""Token counts that follow edits.

A document is kept as a segment tree: its leaves are stretches of whole
pre-tokens with their characters and token counts, inner nodes hold the sums. An
edit finds the leaves it touches by going down the character sums, encodes these
again together with one leaf of context on either side, and brings the sums on
the way to the root up to date; other leaves are neither encoded nor moved. Trees
are kept as a table of their leaves' sums, so later edits start from these.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import map_batches, texts_of
from granary.llm.tokenizing import Encoder

#: Least characters of a leaf, where the text has a place to cut.
LEAF = 512


#: Leaves grow by edits up to this many times the least; then the tree is laid out anew.
GROWTH = 4

# No pre-token has white space behind another character, so one ends before it. Runs of
# letters or digits end before punctuation. Only characters whose class is beyond doubt
# are named; the apostrophe is not, since endings such as 's hold it.
_BOUND = re.compile(
    r"(?<=\S)(?=[ \t\n\r])"
    "|(?<=[0-9A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])"
    "(?=[!\"#(),./:;?\\[\\]{}\u3001\u3002\u300c\u300d\uff01\uff0c\uff0e\uff1a\uff1b\uff1f])"
).search


def leaves_of(text: str, least: int = LEAF) -> list[str]:
    """Stretches of at least `least` characters, cut where no pre-token can cross.

    What stands on one side of such a place does not change the pre-tokens on the
    other. A text without any, one single pre-token, is one leaf.
    """
    out, start = [], 0
    while found := _BOUND(text, start + max(least, 1)):
        out.append(text[start : found.start()])
        start = found.start()
    if start < len(text):
        out.append(text[start:])
    return out


class TokenTree:
    """Segment tree over the leaves of one text, with sums of characters and tokens."""

    def __init__(self, text: str, encoder: Encoder, least: int = LEAF, kept: Sequence[tuple[int, int]] | None = None):
        """From the text, or, without encoding it, from the `kept` (chars, tokens) of its leaves."""
        self.encoder, self.least = encoder, least
        self.encoded = 0  # characters encoded so far
        if kept is None:
            self._plant([(t, self._count(t)) for t in leaves_of(text, least)])
        else:
            ends = np.cumsum([c for c, _ in kept], dtype=np.int64).tolist()
            self._plant([(text[e - c : e], n) for e, (c, n) in zip(ends, kept)])

    def kept(self) -> list[tuple[int, int]]:
        """Characters and tokens of every leaf that holds any."""
        return [s for s in self.sums[self.size : self.size + len(self.leaves)] if s[0]]

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return len(self.encoder.packed_ids(text)) // 4

    def _plant(self, leaves: Sequence[tuple[str, int]]) -> None:
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.leaves = [t for t, _ in leaves]
        self.sums = [(0, 0)] * (2 * self.size)
        for i, (t, n) in enumerate(leaves):
            self.sums[self.size + i] = (len(t), n)
        for i in range(self.size - 1, 0, -1):
            self._add_up(i)

    def _add_up(self, i: int) -> None:
        (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = (a + c, b + d)

    @property
    def chars(self) -> int:
        return self.sums[1][0]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def text(self) -> str:
        return "".join(self.leaves)

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character position, and where that leaf starts."""
        i, start = 1, 0
        while i < self.size:
            left = self.sums[2 * i][0]
            i *= 2
            if position >= start + left and self.sums[i + 1][0]:
                start += left
                i += 1
        return i - self.size, start

    def edit(self, at: int, delete: int, insert: str) -> None:
        """Replace `delete` characters from `at` by `insert`; both are clipped to the text."""
        at = min(max(at, 0), self.chars)
        delete = min(max(delete, 0), self.chars - at)
        if not self.chars:
            self._plant([(t, self._count(t)) for t in leaves_of(insert, self.least)])
            return
        first, start = self.leaf_at(at)
        last, _ = self.leaf_at(at + max(delete - 1, 0))
        before, after = self._beside(first, -1), self._beside(last, 1)
        if before is not None:
            first, start = before, start - len(self.leaves[before])
        last = last if after is None else after
        old = "".join(self.leaves[first : last + 1])
        fresh = leaves_of(old[: at - start] + insert + old[at - start + delete :], self.least)
        slots = last + 1 - first
        # As many leaves as before, in order; what is left over stays empty.
        share = max(1, -(-len(fresh) // slots))
        fresh = ["".join(fresh[i : i + share]) for i in range(0, len(fresh), share)]
        if share > GROWTH:
            known = [(t, self.sums[self.size + i][1]) for i, t in enumerate(self.leaves) if t and not first <= i <= last]
            at = sum(1 for t in self.leaves[:first] if t)
            pieces = [p for t in fresh for p in leaves_of(t, self.least)]
            self._plant(known[:at] + [(t, self._count(t)) for t in pieces] + known[at:])
            return
        changed = set()
        for i, t in enumerate(fresh + [""] * (slots - len(fresh)), first):
            self.leaves[i] = t
            self.sums[self.size + i] = (len(t), self._count(t))
            changed.add((self.size + i) // 2)
        while changed and 0 not in changed:
            for k in changed:
                self._add_up(k)
            changed = {k // 2 for k in changed}

    def _beside(self, i: int, step: int) -> int | None:
        """The nearest leaf on one side that holds any text, found along the sums."""
        k = self.size + i
        while k > 1:
            sibling = k ^ 1
            if (sibling - k) == step and self.sums[sibling][0]:
                while sibling < self.size:
                    near, far = (2 * sibling + 1, 2 * sibling) if step < 0 else (2 * sibling, 2 * sibling + 1)
                    sibling = near if self.sums[near][0] else far
                return sibling - self.size
            k //= 2
        return None


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, text, leaves where there are any, and edits, from an edit table (doc_id, seq, at, n_delete, inserted).

    Edits of one document are applied in the order of seq, then of the other
    columns; those of unknown documents are dropped. Documents keep their rows.
    """
    row = F.struct("seq", "at", "n_delete", "inserted")
    gathered = edits.where("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    each = F.transform("_rows", lambda r: F.struct(r["at"], r["n_delete"], r["inserted"]))
    names = ["doc_id", "text", *_tree_columns(docs)]
    return docs.select(*names).join(gathered, "doc_id", "left").select(*names, each.alias("edits"))


#: Leaves of a kept tree.
LEAVES = "array<struct<chars:int,tokens:int>>"
_LEAVES = pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())]))


def _tree_columns(docs: DataFrame) -> list[str]:
    """`leaves`, where it is a column of kept trees and no other one of that name."""
    return [name for name, kind in docs.dtypes if name == "leaves" and kind == LEAVES]


def planted(docs: DataFrame, tokenizer: str, least: int = LEAF) -> DataFrame:
    """doc_id, text and the tree's `leaves`, structs (chars, tokens), to be stored and edited later.

    A null text is empty and has no leaves; repeated rows each get their row.
    """

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(tokenizer)
        for batch in batches:
            texts = texts_of(batch)
            leaves = [[{"chars": c, "tokens": n} for c, n in TokenTree(t, encoder, least).kept()] for t in texts]
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string()), pa.array(leaves, _LEAVES)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "leaves"])

    return map_batches(docs.select("doc_id", "text"), plant, f"doc_id long, text string, leaves {LEAVES}")


def edited_counts(docs: DataFrame, tokenizer: str, least: int = LEAF) -> DataFrame:
    """Token counts of (doc_id, text, edits) rows before and after their edits.

    `edits` is an array of structs (at, n_delete, inserted), code points, applied
    one after the other; positions beyond the text are clipped to it, nulls read
    as 0 and empty. Columns: doc_id, n_tokens, n_leaves, edited_chars,
    edited_tokens, and reencoded_chars, what the edits had encoded again.

    Where the rows have `leaves` from `planted`, trees start from these and only the
    edits are encoded; a null there is a tree not kept yet.

    A null text is empty, a null array has no edits, repeated rows each get their
    row, other columns are not looked at. Whole texts are counted.
    """
    names = ["doc_id", "text", "edits", *_tree_columns(docs)]

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(tokenizer)
        for batch in batches:
            rows = []
            stored = batch.column("leaves").to_pylist() if "leaves" in names else [None] * batch.num_rows
            for doc, text, edits, leaves in zip(
                batch.column("doc_id").to_pylist(), texts_of(batch), batch.column("edits").to_pylist(), stored
            ):
                tree = TokenTree(text, encoder, least, leaves and [(x["chars"], x["tokens"]) for x in leaves])
                before, count, encoded = tree.tokens, len(tree.leaves), tree.encoded
                for e in edits or ():
                    at, delete, insert = (e or {}).values() if e else (0, 0, "")
                    tree.edit(at or 0, delete or 0, insert or "")
                rows.append((doc, before, count, tree.chars, tree.tokens, tree.encoded - encoded))
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                ["doc_id", "n_tokens", "n_leaves", "edited_chars", "edited_tokens", "reencoded_chars"],
            )

    schema = "doc_id long, n_tokens long, n_leaves long, edited_chars long, edited_tokens long, reencoded_chars long"
    return map_batches(docs.select(*names), recount, schema)
