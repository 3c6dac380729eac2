"""Token ids by a public byte-level vocabulary, fast for text of repeating words."""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from granary.llm.common import kept

#: Texts of these characters only split the same way at every space (see below).
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*").fullmatch
#: Where a space is followed by white space or the end, pre-tokens cross it.
_LOOSE = re.compile(" (?=[ \t\n\r]|$)").search
CACHED = 300_000


def _bytes_of_symbols() -> dict[str, int]:
    """The byte each symbol of a byte-level vocabulary stands for.

    Printable Latin-1 bytes stand for themselves, the others take the code
    points from 256 on, in order.
    """
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder(dict):
    """Ids as packed little-endian unsigned 32-bit numbers.

    Byte-level pre-tokens take at most one space in front. In plain texts, where
    no space meets other white space, no pre-token crosses the place before a
    space, so such texts are encoded by chunks between spaces; the chunks met
    first are remembered, up to a bound. Their pre-tokens are merged by the
    vocabulary's ranks. Other texts go whole through the tokenizer. The ids are
    the tokenizer's own in either case; a test compares them.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {x["content"] for x in model.get("added_tokens", [])}
        symbols = _bytes_of_symbols()
        ranks = {
            bytes(symbols[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special
        }
        # Of plain characters, letters and digits are what these classes hold.
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        core = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.chunk, self.word = core.encode_ordinary, core.encode_single_piece

    @staticmethod
    def load(path: str) -> Encoder:
        return kept(("encoder", path), lambda: Encoder(path))

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.word((" " + chunk).encode()) if chunk.isalpha() else self.chunk(" " + chunk)
        value = array("I", ids).tobytes()
        if len(self) < CACHED:
            self[chunk] = value
        return value

    def packed_ids(self, text: str) -> bytes:
        if not text:
            return b""
        if not _PLAIN(text) or _LOOSE(text):
            return self.whole(text)
        head, *rest = text.split(" ")
        first = array("I", self.chunk(head)).tobytes() if head else b""
        return first + b"".join(map(self.__getitem__, rest))
