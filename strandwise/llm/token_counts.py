"""Edit-aware token counts: a segment tree of pre-tokens per document, re-encoded only where edits touch it."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens in a leaf when it is made; leaves of over ``CROWDED`` times as many make the tree anew.
LEAF, CROWDED = 32, 4
#: A match of the split pattern looks at most so many characters behind its end.
AHEAD = 3
CACHE = 300_000
EDIT = "array<struct<at:bigint,cut:bigint,put:string>>"


class Counter(dict):
    """Tokens of a pre-token, by byte pairs of a public vocabulary."""

    def __init__(self, name: str):
        super().__init__()
        with open(public_tokenizers.path(name)) as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, lines)}
        self.encoding = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(public_tokenizers.PATTERN)

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = n = len(self.encoding.encode_ordinary(word))
        return n


@cache
def counter(name: str) -> Counter:
    """One for each worker process."""
    return Counter(name)


class Tree:
    """Sums of characters (row 0) and tokens (row 1) over leaves of neighbouring pre-tokens; node i has the children 2i and 2i + 1."""

    def __init__(self, leaves: np.ndarray):
        self.width = 1 << max(0, leaves.shape[1] - 1).bit_length()
        self.sums = np.zeros((2, 2 * self.width), np.int64)
        self.leaves = leaves.shape[1]
        self.sums[:, self.width : self.width + self.leaves] = leaves
        level = self.width
        while level > 1:
            below = self.sums[:, level : 2 * level]
            level //= 2
            self.sums[:, level : 2 * level] = below[:, ::2] + below[:, 1::2]

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one, if none does), and where it starts."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at - start >= self.sums[0, node] and self.sums[0, node + 1]:
                start += int(self.sums[0, node])
                node += 1
        return node - self.width, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        """Set a leaf, and update the sums on its path to the root."""
        node = self.width + leaf
        change = np.array([chars, tokens]) - self.sums[:, node]
        while node:
            self.sums[:, node] += change
            node //= 2

    def to_bytes(self) -> bytes:
        return self.leaves.to_bytes(8, "little") + self.sums.astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Tree:
        out = cls.__new__(cls)
        out.leaves = int.from_bytes(raw[:8], "little")
        out.sums = np.frombuffer(raw[8:], dtype="<i8").reshape(2, -1).copy()
        out.width = out.sums.shape[1] // 2
        return out


def grouped(chars: list[int], tokens: list[int], leaves: int) -> np.ndarray:
    """Characters and tokens of pre-tokens, summed in ``leaves`` groups of about the same number; an empty group holds none."""
    edges = np.arange(leaves + 1) * len(chars) // leaves
    sums = np.zeros((2, len(chars) + 1), np.int64)
    np.cumsum(np.array([chars, tokens], np.int64).reshape(2, -1), axis=1, out=sums[:, 1:])
    return np.diff(sums[:, edges], axis=1)


def build(text: str, known: Counter) -> Tree:
    """The tree of a whole text."""
    words = known.split.findall(text)
    return Tree(grouped(list(map(len, words)), list(map(known.__getitem__, words)), max(1, -(-len(words) // LEAF))))


def edit(text: str, tree: Tree, at: int, cut: int, put: str, known: Counter) -> tuple[str, Tree, int]:
    """Replace ``cut`` characters from ``at`` by ``put``: the new text and tree, and how many characters were encoded.

    A pre-token depends on the text from its start to ``AHEAD`` characters behind its end. So those that end
    ``AHEAD`` before the edit stay, and splitting starts at the leaf there. Behind the edit it goes on until it
    comes to the start of an old leaf: from there on all pre-tokens are the old ones.
    """
    at = max(0, min(at, len(text)))
    cut = max(0, min(cut, len(text) - at))
    new = text[:at] + put + text[at + cut :]
    moved = len(put) - cut
    first, start = tree.find(max(0, at - AHEAD))
    last, end = first, start
    while last < tree.leaves and end < at + cut:
        end += int(tree.sums[0, tree.width + last])
        last += 1
    chars, tokens = [], []
    place = start
    for m in known.split.finditer(new, start):
        while last < tree.leaves and end + moved < m.start():
            end += int(tree.sums[0, tree.width + last])
            last += 1
        if last < tree.leaves and end + moved == m.start() and end >= at + cut:
            break
        chars.append(m.end() - m.start())
        tokens.append(known[m[0]])
        place = m.end()
    else:
        last = tree.leaves
    span = last - first
    if not span or len(chars) > CROWDED * LEAF * span or (span == tree.leaves and len(chars) < span):
        left, right = tree.sums[:, tree.width : tree.width + first], tree.sums[:, tree.width + last : tree.width + tree.leaves]
        return new, Tree(np.hstack([left, grouped(chars, tokens, max(1, -(-len(chars) // LEAF))), right])), place - start
    for k, (c, t) in enumerate(grouped(chars, tokens, span).T):
        tree.put(first + k, int(c), int(t))
    return new, tree, place - start


def count(docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``docs`` with ``tokens`` and ``tree``, the segment tree of ``text`` as bytes. Columns of these names are replaced."""
    docs = docs.drop("tokens", "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(tokenizer)
        for batch in batches:
            trees = [build(t or "", known) for t in batch.column("text").to_pylist()]
            batch = batch.append_column("tokens", pa.array([t.tokens for t in trees], pa.int64()))
            yield batch.append_column("tree", pa.array([t.to_bytes() for t in trees], pa.binary()))

    return docs.mapInArrow(run, docs.select("*", F.lit(0).cast("long").alias("tokens"), F.lit(b"").alias("tree")).schema)


def recount(counted: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Counted documents with their ``edits`` applied: ``text``, ``tree`` and ``tokens`` after them, and ``encoded``, the characters encoded anew.

    ``edits`` is an array of (at, cut, put): from character ``at`` of the text as the edits before left it,
    ``cut`` characters go and ``put`` comes. Positions beyond the text mean its end.

    Edge cases: null text is empty; null edits, or nulls in an edit, change nothing (a null ``put`` is empty);
    very long words and texts are one leaf or many; an empty table gives no rows; all other columns stay.
    """
    counted = counted.drop("encoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(tokenizer)
        for batch in batches:
            texts, trees, totals, encoded = [], [], [], []
            for text, raw, edits in zip(batch.column("text").to_pylist(), batch.column("tree").to_pylist(), batch.column("edits").to_pylist(), strict=True):
                tree, work = Tree.from_bytes(raw), 0
                for e in edits or []:
                    if e and e["at"] is not None and e["cut"] is not None:
                        text, tree, n = edit(text or "", tree, e["at"], e["cut"], e["put"] or "", known)
                        work += n
                texts.append(text)
                trees.append(tree.to_bytes())
                totals.append(tree.tokens)
                encoded.append(work)
            made = {"text": pa.array(texts, pa.string()), "tree": pa.array(trees, pa.binary()), "tokens": pa.array(totals, pa.int64())}
            columns = {f: made.get(f, batch.column(f)) for f in batch.schema.names}
            yield pa.RecordBatch.from_pydict(columns | {"encoded": pa.array(encoded, pa.int64())})

    return counted.mapInArrow(run, counted.select("*", F.lit(0).cast("long").alias("encoded")).schema)


def sample_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with ``edits`` that follow from their own ids and texts: a deletion, an insertion of own words, a replacement."""
    n = F.length(F.coalesce("text", F.lit(""))) + 1
    spot = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), n.cast("long"))
    own = F.substring(F.coalesce("text", F.lit("")), (spot(3) + 1).cast("int"), F.lit(24))
    edits = [(spot(1), F.lit(12), F.lit("")), (spot(2), F.lit(0), own), (spot(4), F.lit(5), F.lit("'re 2024"))]
    return docs.withColumn("edits", F.array(*[F.struct(a.alias("at"), b.cast("long").alias("cut"), c.alias("put")) for a, b, c in edits]))
