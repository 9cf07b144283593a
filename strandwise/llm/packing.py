"""Packing token sequences into bins by exact-complement hashing, then best fit."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import hash_bits, leading, running_total
from strandwise.session import durable

#: Fixed value: the id that ends a document.
END = 1
#: Pre-tokens kept with their ids in a task; beyond it the cache starts anew.
CACHE = 300_000
#: Texts of these characters are split here; all others go through the tokenizer whole.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: The tokenizer's own split of lower-cased text, for those characters.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder(dict):
    """Token ids of texts, as little-endian 32-bit words. A text's pre-tokens are looked up, so each is encoded once."""

    def __init__(self, name: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(name))
        letters = _byte_letters()
        self.letters = str.maketrans({c: "".join(letters[b] for b in chr(c).encode()) for c in range(128, 256)})

    def __missing__(self, word: str) -> bytes:
        ids = [t.id for t in self.whole.model.tokenize(word if word.isascii() else word.translate(self.letters))]
        self[word] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def encode(self, text: str) -> bytes:
        if "<|" in text or not PLAIN.fullmatch(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if len(self) > CACHE:
            self.clear()
        return b"".join(map(self.__getitem__, SPLIT.findall(text.lower())))


def _pieces(name: str, size: int, keep_ids: bool):
    """Arrow batches of (doc_id, text) to the pieces of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(name), struct.pack("<I", END)
        for batch in batches:
            places, pieces, starts, lengths, sums, kept = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                raw = encoder.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    places.append(row)
                    pieces.append(k)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(part)
            columns = {"doc_id": batch.column(0).take(pa.array(places, pa.int64())), "piece": pa.array(pieces, pa.int32()), "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(kept, pa.binary())} if keep_ids else {}))

    return run


def plan_bins(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, how many bins) that use up ``counts[length]``; bins hold ``len(counts) - 1``.

    From the longest length down, a bin's gap is filled exactly by a length, a pair or a triple that is
    still available: single sums are the counts themselves, pair sums and triple sums are looked up by the
    complement. If none fits exactly, the longest length that fits goes in (best fit) and the new gap is
    looked up again. A pattern is used as often as its lengths allow, so each use exhausts a length: the
    plan's size depends on the number of lengths, not on the number of pieces.
    """
    size = len(counts) - 1
    left = counts.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    for top in range(size, 0, -1):
        while left[top]:
            left[top] -= 1
            used = [top]
            gap = size - top
            while gap:
                fill = _exact(left, gap)
                if not fill:
                    fits = np.flatnonzero(left[1 : gap + 1])
                    if not len(fits):
                        break
                    fill = (int(fits[-1]) + 1,)
                for n in fill:
                    left[n] -= 1
                    gap -= n
                used.extend(fill)
            lengths, times = np.unique(used, return_counts=True)
            more = int((left[lengths] // times).min())
            left[lengths] -= more * times
            plan.append((tuple(used), 1 + more))
    return plan


def _exact(left: np.ndarray, gap: int) -> tuple[int, ...]:
    """One, two or three available lengths that sum to ``gap``, the longest first; empty if there are none."""
    if left[gap]:
        return (gap,)
    first = np.arange(gap - 1, (gap - 1) // 2, -1)
    second = gap - first
    good = (left[first] > 0) & (left[second] > 0) & ((first != second) | (left[first] > 1))
    if good.any():
        k = int(good.argmax())
        return int(first[k]), int(second[k])
    for a in np.flatnonzero(left[1:gap])[::-1] + 1:
        rest = gap - int(a)
        if rest > 2 * a:
            break
        b = np.arange(min(int(a), rest - 1), (rest - 1) // 2, -1)
        c = rest - b
        good = (left[b] > (b == a)) & (left[c] > (c == a) * 1 + (c == b) * 1)
        if good.any():
            k = int(good.argmax())
            return int(a), int(b[k]), int(c[k])
    return ()


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, rank, how many in a bin, first bin, place) by length and first rank."""
    rows, taken, bins = [], {}, 0
    for used, times in plan:
        place = 0
        for n in dict.fromkeys(used):
            m = used.count(n)
            rows.append((n, taken.get(n, 0), m, bins, place))
            taken[n] = taken.get(n, 0) + m * times
            place += m * n
        bins += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _placed(slots: np.ndarray):
    """Arrow batches of ranked pieces to their bin and place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (slots[:, 0] << 45) + slots[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = slots[np.searchsorted(keys, (length << 45) + rank, "right") - 1]
            nth = rank - row[:, 1]
            columns = {f: batch.column(f) for f in batch.schema.names if f != "rank"}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(row[:, 3] + nth // row[:, 2]), "offset": pa.array(row[:, 4] + nth % row[:, 2] * length)})

    return run


def pack(docs: DataFrame, size: int = 4096, tokenizer: str = "word_bpe_49k.json", keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence of at most ``size`` tokens.

    (doc_id, piece, start, length, ids_crc32, sequence_id, offset), and with ``keep_ids`` the ids themselves
    as little-endian 32-bit words. A document is its token ids, then id 1; only documents longer than a
    sequence are cut. The plan is made from the counts by length (``size`` rows at most, whatever the
    input); pieces are numbered within their length by bucketed running totals and look up their bin there.

    Edge cases: null and empty texts are the end id alone; repeated rows and null doc_ids are pieces like any
    other; a very long text gives many full pieces; an empty table gives no rows; other columns are not read.
    """
    shape = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    pieces = durable(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(tokenizer, size, keep_ids), shape), "pieces")
    counts = np.zeros(size + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # ``size`` rows at most
        counts[row["length"]] = row["n"]
    slots = _slots(plan_bins(counts))
    hashed = pieces.withColumn("_h", F.xxhash64("doc_id", "piece", "ids_crc32")).withColumn("_bucket", leading(F.col("_h"), hash_bits(int(counts.sum()))))
    ranked = running_total(hashed, ["length"], "_bucket", ["_h", "doc_id", "piece"], F.lit(1), "rank").drop("_h", "_bucket")
    ranked = ranked.withColumn("rank", F.col("rank").cast("long"))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank") + ", sequence_id long, offset long"
    return ranked.mapInArrow(_placed(slots), shape).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)
