"""Byte-level BPE over a whole corpus (problem 6).

Texts are cut into words by the vocabulary's own pattern. The distinct words of
a task are put into a trie, which is walked depth first. Every node holds one
state: the last token of the BPE encoding of the bytes that lead to it. That
state follows from the states of the node's ancestors, since the encoding of a
prefix ends in the only vocabulary suffix that may stand after the encoding of
what comes before it. A prefix shared by many words is thus encoded once, and a
word's ids are read by going back from its node, token by token.

The work is one narrow stage without a shuffle: a task sees its own documents
only, and keeps the words that it has met in a table of bounded size.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that cuts a text into words is a fixed value of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words (and bytes of long words) that a task remembers before it starts anew.
MEMORY_BYTES = 24_000_000
#: Bytes of text that are handled at once.
SLICE_BYTES = 4_000_000


class TrieEncoder:
    """Encodes distinct words by walking a trie of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        # A trie of the vocabulary read from the end: all tokens that end at a byte are found in one walk back.
        self.ends: dict = {}
        for b, i in ranks.items():
            node = self.ends
            for c in reversed(b):
                node = node.setdefault(c, {})
            node[-1] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.size = 0

    def merge(self, b: bytes) -> list[int]:
        """Plain BPE of a few bytes: the lowest rank is merged first, the leftmost of equals."""
        parts, ranks = [b[i : i + 1] for i in range(len(b))], self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens side by side as they are."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def add(self, new: list[str]) -> None:
        """Encodes words that are not known yet, all in one walk over their trie."""
        if len(self.fits) > 2_000_000:
            self.fits = {}
        root: dict = {}
        for w in new:
            node = root
            for c in w.encode("utf-8", "surrogatepass"):
                nxt = node.get(c)
                if nxt is None:
                    nxt = node[c] = {}
                node = nxt
            node[-1] = w
        path = bytearray()
        last: list[int] = []  # last[d - 1]: the state of the node at depth d of the path
        stack = [(0, c, child) for c, child in root.items()]
        tokens, ends, may_follow = self.tokens, self.ends, self.may_follow
        while stack:
            depth, c, node = stack.pop()
            del path[depth:], last[depth:]
            path.append(c)
            at, here, found = depth, ends, []
            while at >= 0:
                here = here.get(path[at])
                if here is None:
                    break
                if -1 in here:
                    found.append((at, here[-1]))
                at -= 1
            for start, token in reversed(found):
                if start == 0 or may_follow(last[start - 1], token):
                    last.append(token)
                    break
            for k, child in node.items():
                if k != -1:
                    stack.append((depth + 1, k, child))
            if -1 in node:
                ids, end = [], depth + 1
                while end:
                    t = last[end - 1]
                    ids.append(t)
                    end -= len(tokens[t])
                ids.reverse()
                self.words[node[-1]] = tuple(ids)
                self.size += 120 + 9 * len(node[-1])

    def encode(self, texts: list[str | None], words: regex.Pattern) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids end."""
        cut = [words.findall(t) if t else [] for t in texts]
        needed = {w for ws in cut for w in ws}
        if self.size > MEMORY_BYTES:
            self.words, self.size = {}, 0
        if fresh := needed.difference(self.words):
            self.add(list(fresh))
        known, flat, ends = self.words, [], np.zeros(len(texts) + 1, np.int32)
        for i, ws in enumerate(cut):
            for w in ws:
                flat.extend(known[w])
            ends[i + 1] = len(flat)
        return np.array(flat, np.int32), ends


@lru_cache(2)
def load(path: str) -> tuple[TrieEncoder, regex.Pattern]:
    lines = Path(path).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    return TrieEncoder(ranks), regex.compile(PATTERN)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = TOKENIZER) -> DataFrame:
    """(``key``, ids ARRAY<INT>): the token ids of each row's text, without special tokens.

    One row comes out for each row that goes in, repeated rows included. A null
    and an empty text give an empty list; strings that spell a special token are
    ordinary text; a null key stays null. Other columns are left out, whatever
    their names. An empty table gives an empty table.
    """
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, words = load(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            start = size = 0
            for i, t in enumerate(texts):
                size += len(t) if t else 0
                if size >= SLICE_BYTES or i == len(texts) - 1:
                    flat, ends = encoder.encode(texts[start : i + 1], words)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i + 1 - start), ids], ["key", "ids"])
                    start, size = i + 1, 0

    out = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    out = out.mapInArrow(run, f"key {kind.simpleString()}, ids array<int>")
    return out.withColumnRenamed("key", key)
