"""Repeated passages: paragraph MinHash banding, exact Jaccard, and clusters by components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.llm.common import components, octets, packed, runs_of, unpacked
from strandwise.session import forget, settled

#: Odd multipliers of the hashes; their arithmetic is modulo 2^64.
STEP, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
BACK = pow(STEP, -1, 2**64)
CACHE = 400_000
#: Words handled at once in a task.
WORK = 400_000


def tune_bands(threshold: float, rows: int, recall: float) -> int:
    """The fewest bands of ``rows`` MinHashes with which a pair at the threshold collides with probability ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


def shingles(h: np.ndarray, words: int) -> np.ndarray:
    """Hash of the ``words`` word hashes from each place on (zeros stand behind the end)."""
    out = np.zeros_like(h)
    for j in range(words):
        out = out * np.uint64(STEP)
        out[: max(0, len(h) - j)] += h[j:]
    return scrambled(out)


def banded(marks: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit value for each band of ``rows`` MinHashes (columns of ``marks``)."""
    out = np.zeros((len(marks), marks.shape[1] // rows), np.uint64)
    for k in range(rows):
        out = scrambled(out * np.uint64(STEP) + marks[:, k::rows])
    return out


def minhash(s: np.ndarray, begin: np.ndarray, end: np.ndarray, seeds: range) -> np.ndarray:
    """Least value of s[begin:end] times the seed's factor, of each range; ``s`` is scrambled, so its products with odd factors are in random order."""
    out = np.empty((len(begin), len(seeds)), np.uint64)
    edges = np.stack([begin, end], axis=1).ravel()
    padded = np.append(s, np.uint64(2**64 - 1))
    for k, seed in enumerate(seeds):
        salt = scrambled(np.array([(2 * seed + 1) * STEP % 2**64], np.uint64)) | np.uint64(1)
        out[:, k] = np.minimum.reduceat(padded * salt, edges)[::2] if len(begin) else 0
    return out


class Units:
    """Lines (paragraphs) of some texts, and their whole streams of words, as ranges of the words' hashes."""

    def __init__(self, known: Hashes, texts: list[bytes]):
        words: list[bytes] = []
        sizes: list[int] = []
        docs: list[int] = []
        for d, text in enumerate(texts):
            for line in text.lower().split(b"\n"):
                own = line.split()
                if own:
                    words.extend(own)
                    sizes.append(len(own))
                    docs.append(d)
        self.h = h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size, self.line_doc = np.array(sizes, np.int64), np.array(docs, np.int64)
        self.line_end = np.cumsum(size)
        self.line_begin = self.line_end - size
        first = np.searchsorted(self.line_doc, np.arange(len(texts) + 1))
        self.doc_begin = np.append(self.line_begin, len(words))[first[:-1]]
        self.doc_end = np.append(self.doc_begin[1:], len(words))
        power = np.cumprod(np.append(np.uint64(1), np.full(len(h), STEP, np.uint64)))
        self.back = np.cumprod(np.append(np.uint64(1), np.full(len(h), BACK, np.uint64)))
        self.sums = np.append(np.uint64(0), np.cumsum(scrambled(h) * power[:-1]))

    def keys(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of the words of each range, the same wherever they stand."""
        return scrambled((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64)).view(np.int64)

    def seeds(self, size: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, place) of the ``size``-word shingles with the least hash of some ``wide`` neighbouring ones.

        Lines do not matter. A run of size + wide - 1 words holds all of some ``wide`` shingles and so at least one
        seed, which depends on the run alone: texts that share the run share the seed.
        """
        s = shingles(self.h, size)
        n = max(len(s) - wide + 1, 0)
        place = np.arange(n)
        low, at, reach = s, np.arange(len(s)), 1
        while reach < wide:  # the least of ``reach`` and of as many further on, at most twice as many together
            step = min(reach, wide - reach)
            less = low[step:] < low[:-step]
            low, at, reach = np.where(less, low[step:], low[:-step]), np.where(less, at[step:], at[:-step]), reach + step
        sizes = self.doc_end - self.doc_begin
        doc = np.repeat(np.arange(len(sizes)), sizes)
        at = np.unique(at[place + wide + size - 1 <= self.doc_end[doc[:n]]])
        return doc[at], at

    def around(self, doc: np.ndarray, at: np.ndarray, size: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Seeds with up to ``reach`` words of their text on both sides: begin, end, and a hash of the words and of the seed's place among them."""
        begin, end = np.maximum(at - reach, self.doc_begin[doc]), np.minimum(at + size + reach, self.doc_end[doc])
        return begin, end, self.keys(begin, end) + (at - begin)


def _units(words: int, least: int, rows_a_band: int, bands: int, size: int, wide: int):
    """Arrow batches of (doc_id, text) to units: key, doc_id, start and number of words, and a further key and number of words.

    Of paragraphs also the bands of MinHashes; their further words are those in short lines up to the document's next
    paragraph. Of seeds the key is that of the ``size`` words, and all else is of the words around them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), octets(batch.column(1)), strict=True))
            for part in runs_of(rows, (len(t) // 6 + 1 for _, t in rows), WORK):
                ids = np.array([d for d, _ in part], np.int64)
                u = Units(known, [t for _, t in part])
                good = u.line_end - u.line_begin >= least
                begin, end, doc = u.line_begin[good], u.line_end[good], u.line_doc[good]
                marks = banded(minhash(shingles(u.h, words), begin, end - words + 1, range(rows_a_band * bands)), rows_a_band).view(np.int64)
                upto = end.copy()
                upto[:-1] = np.where(doc[1:] == doc[:-1], begin[1:], end[:-1])
                held, seed = u.seeds(size, wide)
                low, high, around = u.around(held, seed, size, wide - 1)
                keys, more = np.append(u.keys(begin, end), u.keys(seed, seed + size)), np.append(u.keys(end, upto), around)
                at, to, own = (np.concatenate(x) for x in ((begin, low), (end, high), (doc, held)))
                lists = pa.ListArray.from_arrays(pa.array(np.append(np.arange(len(begin) + 1) * bands, np.full(len(seed), len(begin) * bands)), pa.int32()), pa.array(marks.ravel()))
                columns = [pa.array(keys), pa.array(ids[own]), pa.array(at - u.doc_begin[own], pa.int32()), pa.array(to - at, pa.int32()), lists, pa.array(more), pa.array(np.append(upto - end, np.zeros(len(seed), np.int64)), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "start", "words", "marks", "gap_key", "gap"])

    return run


def _beside(size: int, reach: int):
    """(doc_id, text, classes of seeds) to the hashes of up to ``reach`` words on either side of each such seed, outwards."""

    def mixed(kind: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return scrambled(kind.view(np.uint64) + doc.astype(np.uint64) * np.uint64(STEP))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        out = np.arange(reach)
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), octets(batch.column(1)), batch.column(2).to_pylist(), strict=True))
            for part in runs_of(rows, (len(t) // 6 + 1 for _, t, _ in rows), WORK):
                u = Units(known, [t for _, t, _ in part])
                doc, at = u.seeds(size, reach + 1)
                asked = np.array([c for _, _, own in part for c in own], np.int64)
                by = np.repeat(np.arange(len(part)), [len(own) for _, _, own in part])
                hit = np.isin(mixed(u.around(doc, at, size, reach)[2], doc), mixed(asked, by))
                doc, at = doc[hit], at[hit]
                keys, ids, start = u.keys(at, at + size), np.array([d for d, _, _ in part], np.int64)[doc], at - u.doc_begin[doc]
                short = (u.h >> np.uint64(32)).astype(np.uint32).view(np.int32)
                for side in (False, True):
                    place = at[:, None] + size + out if side else at[:, None] - 1 - out
                    whole = place < u.doc_end[doc][:, None] if side else place >= u.doc_begin[doc][:, None]
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(whole.sum(axis=1))), pa.int32()), pa.array(short[place[whole]], pa.int32()))
                    columns = [pa.array(keys), pa.array(ids), pa.array(start, pa.int32()), pa.array(np.full(len(at), side)), lists]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "start", "side", "near"])

    return run


def _grow(key: np.ndarray, side: np.ndarray, near: np.ndarray, size: np.ndarray, doc: np.ndarray, start: np.ndarray, low: tuple, high: tuple) -> Iterator[tuple]:
    """Of each place, the longest beginning of the words beside its seed that a smaller document holds, and the longest that it is the first to hold.

    Yields (rows, number of words, first document of any beginning, document and start of the other place). ``near`` has
    a row a place; ``low`` and ``high`` are the first and last (document, start) of the seed, which is the beginning of no words.
    """
    order = np.lexsort([*near.T[::-1], side, key])
    key, side, near, size, doc, start = (x[order] for x in (key, side, near, size, doc, start))
    low, high = (tuple(x[order] for x in place) for place in (low, high))
    by = np.lexsort([start, doc])
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    fresh = np.append(True, (key[1:] != key[:-1]) | (side[1:] != side[:-1]))
    keeper = np.where(low[0] < high[0], low[0], np.iinfo(np.int64).max)
    later, own = ((low[0] < high[0]) & mine for mine in (low[0] < doc, low[0] == doc))
    best = [(later, np.zeros(len(doc), np.int64), low[0].copy(), low[1].copy()), (own, np.zeros(len(doc), np.int64), high[0].copy(), high[1].copy())]
    for j in range(1, near.shape[1] + 1):
        fresh = fresh | np.append(True, near[1:, j - 1] != near[:-1, j - 1])
        begin = np.flatnonzero(fresh)
        many = np.diff(np.append(begin, len(doc)))
        first, last = (by[np.repeat(least.reduceat(rank, begin), many)] for least in (np.minimum, np.maximum))
        shared = (size >= j) & (doc[first] < doc[last])
        keeper = np.where(shared, np.minimum(keeper, doc[first]), keeper)
        for (has, words, there, at), mine, other in zip(best, (doc[first] < doc, doc[first] == doc), (first, last), strict=True):
            hit = shared & mine
            has[hit], words[hit], there[hit], at[hit] = True, j, doc[other][hit], start[other][hit]
    for (has, words, there, at), kept in zip(best, (keeper, doc), strict=True):
        yield order[has], words[has], kept[has], there[has], at[has]


def _growing(size: int, reach: int):
    """Places of seeds with the words beside them, sorted by ``key``, ``side`` and first word, to runs of words (doc_id, start, words, keeper, there, shift)."""

    def grown(rows: pa.Table) -> pa.RecordBatch:
        c = {n: rows.column(n).to_numpy() for n in rows.column_names if n != "near"}
        lists = rows.column("near").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        many = pc.list_value_length(lists).to_numpy()
        near = np.full((len(many), reach), 2**40)  # no word's hash of 32 bits
        near[np.arange(reach) < many[:, None]] = lists.flatten().to_numpy()
        side, doc, start = c["side"].astype(bool), c["doc_id"], c["start"].astype(np.int64)
        found = _grow(c["key"], side, near, many, doc, start, (c["low_doc"], c["low_start"]), (c["high_doc"], c["high_start"]))
        at, words, keeper, there, other = (np.concatenate(x) for x in zip(*found, strict=True))
        columns = [doc[at], np.where(side[at], start[at], start[at] - words), words + size, keeper, there, other - start[at]]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "start", "words", "keeper", "there", "shift"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if n >= WORK // 4 and len(batch):  # up to where the next group begins
                last, own = held[-1].slice(len(held[-1]) - 1), pa.Table.from_batches([batch])
                same = np.ones(len(batch), bool)
                for name in ("key", "side", "word"):
                    same &= own.column(name).to_numpy() == last.column(name)[0].as_py()
                if not same.all():
                    cut = int(same.argmin())
                    yield grown(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held, n, batch = [], 0, batch.slice(cut)
            if len(batch):
                held.append(batch)
                n += len(batch)
        if held:
            yield grown(pa.Table.from_batches(held))

    return run


def _shingled(words: int):
    """(text, places of paragraphs) to (key, set of shingle hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            rows = list(zip(octets(batch.column(0)), batch.column(1).to_pylist(), strict=True))
            for part in runs_of(rows, (len(t) // 6 + 1 for t, _ in rows), WORK):
                u = Units(known, [t for t, _ in part])
                s = shingles(u.h, words).view(np.int64)
                asked = np.array([(d, p["key"], p["start"], p["words"]) for d, (_, own) in enumerate(part) for p in own], np.int64).reshape(-1, 4)
                begin = u.doc_begin[asked[:, 0]] + asked[:, 2]
                asked, begin = (x[begin + asked[:, 3] <= u.doc_end[asked[:, 0]]] for x in (asked, begin))
                end = begin + asked[:, 3]
                same = np.flatnonzero(u.keys(begin, end) == asked[:, 1])
                sets = [np.unique(s[begin[i] : end[i] - words + 1]) for i in same]
                yield pa.RecordBatch.from_arrays([pa.array(asked[same, 1]), pa.array(sets, pa.list_(pa.int64()))], ["key", "s"])

    return run


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of ``threshold`` or more, exactly."""
    sets = sets.hint("merge")
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("s").alias("y")), "b")
    both = both.where(F.least(F.size("x"), F.size("y")) >= threshold * F.greatest(F.size("x"), F.size("y")))
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= threshold * (F.size("x") + F.size("y") - common)).drop("x", "y")


def shared_cells(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs, from cells of two paragraphs, and the (cell, key) of larger ones; cells with the same members count once."""
    held = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b"), F.bit_xor(F.xxhash64("key")).alias("all")).where("n > 1")
    held = settled(held, "cells")
    larger = settled(held.where("n > 2").groupBy("n", "a", "b", "all").agg(F.min("cell").alias("cell")).select("cell"), "larger")
    return held.where("n = 2").select("a", "b").distinct(), cells.join(larger, "cell")


def _connect(keys: np.ndarray, sizes: np.ndarray, flat: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links between similar sets, enough to connect all that is connected: a forest, not all pairs.

    The set whose elements the most others hold meets all; whatever is not in the largest component then meets all as
    well. Of two similar sets one is always outside it, so no link between components is missed.
    """
    _, ids = np.unique(flat, return_inverse=True)
    begin = np.append(0, np.cumsum(sizes))
    central = np.add.reduceat(np.bincount(ids)[ids], begin[:-1]) / sizes
    label, met, held = np.arange(len(keys)), np.zeros(len(keys), bool), np.zeros(len(flat), bool)
    out: list[tuple[int, int]] = []
    while True:
        open_ = ~met & (label != np.bincount(label).argmax()) if met.any() else ~met
        if not open_.any():
            return out
        u = int(np.where(open_, central, -1).argmax())
        met[u] = True
        own = ids[begin[u] : begin[u + 1]]
        held[own] = True
        both = np.add.reduceat(held[ids], begin[:-1], dtype=np.int64)
        held[own] = False
        near = np.flatnonzero((both >= threshold * (sizes + sizes[u] - both)) & (label != label[u]))
        names, first = np.unique(label[near], return_index=True)
        out += [(int(keys[u]), int(keys[i])) for i in near[first]]
        label[np.isin(label, names)] = label[u]


def _linked(threshold: float):
    """(cell, key, set), sorted by cell, to links (a, b); a cell may pass over the ends of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices() -> Iterator[tuple[int, pa.RecordBatch]]:
            for batch in batches:
                cell = batch.column("cell").to_numpy()
                for lo, hi in pairwise([0, *(np.flatnonzero(np.diff(cell)) + 1), len(cell)] if len(cell) else []):
                    yield int(cell[lo]), batch.slice(lo, hi - lo)

        for _, parts in groupby(slices(), lambda x: x[0]):
            own = [part for _, part in parts]
            sets = pa.concat_arrays([part.column("s") for part in own])
            keys = np.concatenate([part.column("key").to_numpy() for part in own])
            links = _connect(keys, pc.list_value_length(sets).to_numpy(), sets.flatten().to_numpy(), threshold)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def hub_links(crowds: DataFrame, sets: DataFrame, threshold: float, crowd: int) -> DataFrame:
    """Links (a, b) in cells of any size, so that all that is connected inside a cell stays connected.

    A cell's members meet in one task (``_connect``). A cell with more than ``crowd`` of them, a long one counting
    as several, is cut into blocks of that size by hash, and each two of its blocks meet, so no task holds more than two.
    """
    sets = sets.where(F.size("s") > 0).hint("merge")
    weight = sets.select("key", F.ceil(F.size("s") / F.lit(100.0)).alias("weight"))
    blocks = crowds.join(weight, "key").groupBy("cell").agg(F.ceil(F.sum("weight") / F.lit(float(crowd))).cast("int").alias("blocks"))
    placed = crowds.join(settled(blocks.where("blocks > 1"), "blocks"), "cell", "left").withColumn("own", F.pmod(F.xxhash64("key"), F.coalesce("blocks", F.lit(1))))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")))
    met = placed.withColumn("other", F.explode(others))
    both = F.when(F.col("blocks").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")))
    dealt = met.select(both.alias("cell"), "key").join(sets, "key").select("cell", "key", "s")
    return settled(dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_linked(threshold), "a long, b long"), "links")


def _shared(seeds: DataFrame) -> DataFrame:
    """The seeds that other documents hold, with the smallest of these: whether several do is told from two numbers a key, so most rows move once and are gone."""
    held = seeds.groupBy("key").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper < last").drop("last")
    held = settled(held, "keys")
    shared = settled(seeds.join(held.hint("shuffle_hash"), "key"), "seeds")
    forget(held)
    return shared


def exact_runs(rows: DataFrame, shared: DataFrame, size: int, wide: int) -> DataFrame:
    """Runs of the words that shared seeds and the words beside them share with other documents (see ``_islands``).

    A run goes on for less than ``wide`` words behind its last seed, since the next ``wide`` shingles would hold
    another. Seeds with the same ``wide`` - 1 words on both sides are one class. Where several documents hold a
    class, all these words are shared, and there is no more to find for any but its smallest document. What classes
    share with each other is found from one document of each, where a seed has several (``_grown``).
    """
    place = F.struct("doc_id", "start")
    classes = settled(shared.groupBy("key", "class").agg(F.min(place).alias("low"), F.max(place).alias("high")), "classes")
    several = classes.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b").select("key")
    places = classes.join(several.hint("merge"), "key", "left_semi").groupBy(F.col("low.doc_id").alias("_doc")).agg(F.collect_list("class").alias("places"))
    whole = shared.join(classes.where("low.doc_id < high.doc_id").hint("shuffle_hash"), ["key", "class"])
    later = F.col("doc_id") > F.col("low.doc_id")
    other = F.when(later, F.col("low")).otherwise(F.col("high"))
    keeper = F.when(later, F.col("keeper")).otherwise(F.col("doc_id"))
    spans = settled(whole.select("doc_id", "start", "words", keeper.alias("keeper"), other["doc_id"].alias("there"), (other["start"] - F.col("start")).alias("shift")), "spans")
    forget(shared)
    beside = rows.join(places.hint("merge"), F.col("doc_id") == F.col("_doc")).select("doc_id", "text", "places").mapInArrow(_beside(size, wide - 1), "key long, doc_id long, start int, side boolean, near array<int>")
    beside = settled(beside, "beside")
    forget(classes)
    begun = settled(_grown(beside, size, wide - 1), "begun")
    forget(beside)
    way = F.struct("there", "shift")
    ends = F.col("start") + F.col("words")
    found = spans.unionByName(begun).withColumn("removed", F.col("doc_id") > F.col("keeper"))
    runs = _islands(found, F.min_by(way, F.struct("start", -ends, way)).alias("head"), F.max_by(way, F.struct(ends, -F.col("start"), way)).alias("tail"))
    out = settled(runs, "exact")
    forget(spans, begun)
    return out


def _grown(beside: DataFrame, size: int, reach: int) -> DataFrame:
    """Seeds with as many words beside them as another document shares: a place takes the longest beginning that a smaller
    doc_id holds, and the longest that it is the smallest to hold.

    Places whose seed has the same first word beside it meet in one task, where their beginnings of 1, 2, ... words are
    groups of sorted rows; the seed itself, which all its places share, is summed up before.
    """
    place = F.struct("doc_id", "start")
    seeds = beside.groupBy("key").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    seeds = seeds.select("key", *[F.col(f"{x}.{of}").cast("long").alias(f"{x}_{name}") for x in ("low", "high") for of, name in (("doc_id", "doc"), ("start", "start"))])
    met = beside.join(seeds.hint("merge"), "key").withColumn("word", F.coalesce(F.get("near", F.lit(0)), F.lit(0)))
    met = met.repartition("key", "side", "word").sortWithinPartitions("key", "side", "word")
    return met.mapInArrow(_growing(size, reach), "doc_id long, start int, words int, keeper long, there long, shift int")


def bridges(runs: DataFrame, words: int, threshold: float) -> DataFrame:
    """Neighbouring exact runs as one, where they and what lies between them are similar in both documents.

    The shingles of the two runs are common; those over the words between them, here and there, are not. Their
    Jaccard similarity must be ``threshold`` or more.
    """
    by = Window.partitionBy("doc_id", "removed").orderBy("start")
    runs = runs.withColumn("next", F.lead(F.struct("start", "end", "keeper", "head")).over(by))
    here = F.col("next.start") - F.col("end")
    runs = runs.withColumn("here", here).withColumn("over", here + F.col("next.head.shift") - F.col("tail.shift"))
    common = F.col("end") - F.col("start") + F.col("next.end") - F.col("next.start") - 2 * (words - 1)
    alike = (F.col("next.head.there") == F.col("tail.there")) & (F.col("over") >= 0) & (common >= threshold * (common + F.col("here") + F.col("over") + 2 * (words - 1)))
    return runs.where(alike).select("doc_id", "start", (F.col("next.end") - F.col("start")).alias("words"), F.least("keeper", "next.keeper").alias("keeper"), "removed")


def _over_short_lines(found: DataFrame) -> DataFrame:
    """Linked paragraphs with the short lines behind them, where the next paragraph is linked too and another of the cluster has the same short lines."""
    by = Window.partitionBy("doc_id", "removed").orderBy("start")
    gaps = found.withColumn("next", F.lead("start").over(by)).where((F.col("gap") > 0) & (F.col("next") == F.col("start") + F.col("words") + F.col("gap")))
    same = found.where("gap > 0").groupBy("cluster", "gap_key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    return gaps.join(same.hint("merge"), ["cluster", "gap_key"], "left_semi").select("doc_id", "start", (F.col("words") + F.col("gap")).alias("words"), "keeper", "removed")


def repeated_passages(docs: DataFrame, words: int = 5, threshold: float = 0.8, least: int = 8, run: int = 20, recall: float = 0.99, crowd: int = 4096, band: int = 4) -> DataFrame:
    """(doc_id, start, words, keeper, removed): the runs of words that other documents hold as well.

    Paragraphs of ``least`` words or more are linked if the Jaccard similarity of their sets of ``words``-word
    shingles is ``threshold`` or more. Candidates share one of the MinHash bands tuned to ``recall``; they
    are checked exactly, and clusters are components. Bands have ``band`` MinHashes. In a cluster over several documents the smallest doc_id
    keeps its text. Short lines between linked paragraphs count where the cluster shares them.

    Beside paragraphs, every run of ``run`` equal words is found, whatever the lines are: seeds are chosen in the
    whole stream of words so that each such run holds one, and shared seeds are widened to the run's ends. Two
    passages of the wanted similarity whose words stand in the same order share a run of 20 words, as each edit
    costs them eight shingles or more; runs beside an edit are joined over it if they are similar together
    (``bridges``). Of such a passage only a part of under ``run`` words between an edit and its edge can be missed.
    Neighbouring units of the same fate join, and runs of ``run`` words or more are returned, by word numbers.
    What lies inside a removed run is not returned as kept too. A kept run may lack words that smaller documents hold
    in part on either side of a seed; removed runs lack none.

    Words are ASCII-lower-cased runs without ASCII white space. Equal paragraphs meet once. A cell's
    paragraphs are linked by those that the most others resemble, which loses no connection inside the cell; cells of
    more than ``crowd`` are cut into blocks that meet two at a time.

    Joins with what grows with the texts are hinted as merges: Spark sizes tables after an explode or a list too low,
    and would send them through the driver.

    Edge cases: null or empty texts, and rows without doc_id, take no part; rows that repeat a doc_id are one
    document; very long texts and lines are read whole; an empty table gives no rows; other columns are not read.
    """
    bands = tune_bands(threshold, band, recall)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    size = min(8, run)
    wide = run - size + 1
    shape = "key long, doc_id long, start int, words int, marks array<long>, gap_key long, gap int"
    units = settled(rows.mapInArrow(_units(words, least, band, bands, size, wide), shape), "units")
    # most units are seeds that nobody shares: they go before anything else is written
    shared = _shared(units.where(F.size("marks") == 0).select("key", F.col("gap_key").alias("class"), "doc_id", "start", "words"))
    whole = settled(units.where(F.size("marks") > 0), "lines")
    forget(units)
    exact = exact_runs(rows, shared, size, wide)
    # equal paragraphs once, with one place where the words stand
    place = F.struct("doc_id", "start", "words")
    paragraphs = settled(whole.groupBy("key").agg(F.min(place).alias("at"), F.first("marks").alias("marks")), "paragraphs")
    cells = paragraphs.select("key", F.posexplode("marks").alias("band", "mark")).select(F.xxhash64("band", "mark").alias("cell"), "key")
    pairs, crowds = shared_cells(cells)
    pairs, crowds = settled(pairs, "pairs"), settled(crowds, "crowds")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(crowds.select("key")).distinct()
    places = paragraphs.join(wanted.hint("merge"), "key", "left_semi").select(F.col("at.doc_id").alias("_doc"), F.struct("key", "at.start", "at.words").alias("p"))
    places = places.groupBy("_doc").agg(F.collect_list("p").alias("places"))
    sets = rows.join(places.hint("merge"), F.col("doc_id") == F.col("_doc")).select("text", "places").mapInArrow(_shingled(words), "key long, s array<long>")
    sets = settled(sets.dropDuplicates(["key"]), "shingles")
    links = settled(similar(pairs, sets, threshold), "links").unionByName(hub_links(crowds, sets, threshold, crowd))
    roots = components(links.distinct()).withColumnRenamed("node", "key")
    # paragraphs by cluster; first and last document tell whether there are several
    kept = settled(whole.drop("marks").join(roots, "key", "left").withColumn("cluster", F.coalesce("root", "key")).drop("root", "key"), "members")
    forget(whole, paragraphs, pairs, crowds, sets)
    held = kept.groupBy("cluster").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper < last").drop("last")
    lines = kept.join(held.hint("merge"), "cluster").withColumn("removed", F.col("doc_id") > F.col("keeper"))
    unit = ["doc_id", "start", "words", "keeper", "removed"]
    runs = exact.withColumn("words", F.col("end") - F.col("start")).select(unit)
    found = lines.select(unit).unionByName(_over_short_lines(lines)).unionByName(runs).unionByName(bridges(exact, words, threshold))
    joined = _islands(found)
    # what lies inside a run that is removed is not kept for others as well
    gone = F.last(F.when(F.col("removed"), F.col("end")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("start", F.desc("removed")))
    joined = joined.withColumn("gone", gone).where(F.col("removed") | F.col("gone").isNull() | (F.col("gone") < F.col("end")))
    return joined.select("doc_id", "start", (F.col("end") - F.col("start")).alias("words"), "keeper", "removed").where(F.col("words") >= run)


def _islands(found: DataFrame, *more: Column) -> DataFrame:
    """Units that touch or overlap, of the same document and fate, as runs (doc_id, removed, start, end, keeper), with ``more`` aggregates."""
    ends = F.col("start") + F.col("words")
    by = Window.partitionBy("doc_id", "removed").orderBy("start", "words")
    reach = F.max(ends).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("fresh", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    marked = marked.withColumn("island", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy("doc_id", "removed", "island").agg(F.min("start").alias("start"), F.max(ends).alias("end"), F.min("keeper").alias("keeper"), *more)


def without_passages(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the removed runs of words taken from ``text``; the words that stay keep their white space before them."""
    gone = repeated_passages(docs, **options).where("removed").groupBy("doc_id").agg(F.collect_list(F.struct("start", "words")).alias("_gone")).withColumnRenamed("doc_id", "_id")
    joined = packed(docs, "doc_id", "text").join(gone, F.col("doc_id") == F.col("_id"), "left")
    tokens = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    inside = lambda i: F.exists("_gone", lambda g: (i >= g["start"]) & (i < g["start"] + g["words"]))
    cut = F.array_join(F.filter(tokens, lambda _, i: ~inside(i)), "")
    return joined.withColumn("text", F.when(F.col("_gone").isNotNull(), cut).otherwise(F.col("text"))).select(*unpacked(docs.columns, "doc_id", "text"))
