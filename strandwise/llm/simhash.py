"""SimHash fingerprints and the groups they form, by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.llm.common import components, octets, packed, unpacked
from strandwise.session import durable


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, as an unsigned number; 0 if it has no word."""
    own = (text or b"").lower().split()
    if not own:
        return 0
    joined = b" ".join(own)
    hashed = xxhash.xxh64_intdigest
    if len(own) <= words:
        return hashed(joined, seed)
    ends = list(accumulate(map(len, own), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    total = len(own) - words + 1
    bits = np.zeros(64, np.int64)
    for lo in range(0, total, 65536):
        hi = min(total, lo + 65536)
        h = np.array([hashed(joined[a:b], seed) for a, b in zip(starts[lo:hi], ends[lo + words - 1 : hi + words - 1], strict=True)], dtype="<u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > total, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint of ``text`` as a signed number; a column of that name is replaced."""
    docs = docs.drop("fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t, words, seed) for t in octets(batch.column("text"))], dtype=np.uint64).view(np.int64)
            yield batch.append_column("fp", pa.array(made, type=pa.int64()))

    return docs.mapInArrow(run, docs.select("*", F.lit(0).cast("long").alias("fp")).schema)


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks: two words that differ in ``radius`` bits at most agree on some mask.

    Bit i has the nonzero vector m(i) over GF(2) of radius + 1 entries, and mask v holds the bits with
    <m(i), v> = 1. The vectors of ``radius`` bits span less than the whole space, so a nonzero v is
    orthogonal to all of them, and that mask holds none of the bits that differ.
    """
    size = 2 ** (radius + 1) - 1
    signed = []
    for v in range(1, size + 1):
        mask = sum(1 << i for i in range(bits) if ((1 + i % size) & v).bit_count() % 2)
        signed.append(mask - 2**64 if mask >= 2**63 else mask)
    return signed


def links(prints: DataFrame, radius: int = 2, crowd: int = 32) -> DataFrame:
    """(a, b): enough links between the distinct fingerprints ``fp`` to connect all within ``radius`` bits.

    Cells of up to ``crowd`` fingerprints are joined with themselves and checked. In larger cells every
    fingerprint gives its neighbours in which up to radius/2 bits outside the mask are flipped; two within
    the radius share one of them, and those that share one are within it, so each points to the smallest.
    That holds for an even radius; the work is in proportion to the cell, and no link is lost.
    """
    if radius != 2:
        raise ValueError("neighbour stars are written for a radius of 2")
    masks = covering_masks(radius)
    cells = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("c")).select("fp", "c.t", "c.key")
    sizes = cells.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = durable(cells.join(sizes, ["t", "key"]), "cells")
    small = members.where(F.col("n") <= crowd).select("t", "key", "fp")
    pairs = small.alias("x").join(small.alias("y"), ["t", "key"]).where("x.fp < y.fp").where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius)
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    flips = F.lit(None)
    for i, m in enumerate(masks):
        free = [0, *(1 << k if k < 63 else -(2**63) for k in range(64) if not (m >> k) & 1)]
        flips = F.when(F.col("t") == i, F.array(*[F.lit(x).cast("long") for x in free])).otherwise(flips)
    near = members.where(F.col("n") > crowd).select("t", "fp", F.explode(flips).alias("flip")).select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    hubs = near.groupBy("t", "point").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = near.join(hubs, ["t", "point"]).where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def classes(made: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, root, component_id, keeper) of each distinct ``fp`` of rows (doc_id, fp).

    component_id is the smallest doc_id of the component, and ``keeper`` the fingerprint that holds it. Copies
    meet in one distinct fingerprint before any join.
    """
    prints = durable(made.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = components(links(prints.select("fp"), radius))
    joined = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"), F.min(F.struct(F.col("first").isNull(), "first", "fp"))["fp"].alias("keeper"))
    return joined.join(least, "root").select("fp", "root", "component_id", "keeper")


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    A bit is set if it is in over half of the XXH64 hashes of the word shingles, repeats included. Documents
    whose fingerprints differ in ``radius`` bits or fewer are linked; component_id is the smallest doc_id
    that can be reached.

    Edge cases: a text of fewer words is one shingle; null, empty or blank text has fingerprint zero, linked
    like any other; a null doc_id is never a component_id, which is null only if its component has no other;
    repeated rows each give a row; an empty table gives none; other columns are not read.
    """
    made = durable(with_fingerprints(docs.select("doc_id", "text"), words, seed).drop("text"), "fingerprints")
    out = made.join(classes(made, radius).select("fp", "component_id"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest doc_id, among its repeats the one with the least text hash."""
    made = durable(with_fingerprints(packed(docs, "doc_id", "text"), words, seed), "fingerprints")
    kept = classes(made.select("doc_id", "fp"), radius).where("fp = keeper").select(F.col("fp").alias("_fp"), "component_id")
    rows = made.join(kept.withColumnRenamed("component_id", "_least"), F.col("fp") == F.col("_fp")).where(F.col("doc_id").eqNullSafe(F.col("_least")))
    first = Window.partitionBy("_fp").orderBy(F.xxhash64("text"))
    return rows.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").select(*unpacked(docs.columns, "doc_id", "text"))
