"""How far sources of a language differ in their words: stripes of counts by source, folded in the mappers, merged by term."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.llm.common import octets
from strandwise.session import durable

#: Bytes that belong to terms: letters, A-Z as lower case, and every byte of a character beyond ASCII.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Counts are raised by this much, and shares are counted in parts of UNIT.
PRIOR, UNIT = 5, 1_000_000_000
#: A stripe: what one term of one language has in some documents. The row with a null term counts the documents.
STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"
#: Cells (term and source) that a mapper holds before it spills.
HELD = 400_000
#: Bytes of a text from which its terms are read one by one instead of listed.
LONG_TEXT = 4 << 20
#: Sources compared at once, and terms in a block.
TILE, TERMS = 256, 2_000


def terms(text: bytes) -> Iterable[bytes]:
    """The terms of a UTF-8 text: runs of letters and of characters beyond ASCII, A-Z lower-cased."""
    plain = text.translate(LETTERS)
    return plain.split() if len(plain) < LONG_TEXT else (m[0] for m in re.finditer(rb"\S+", plain))


class Stripes:
    """The in-mapper table: language and term to document frequency and counts by source."""

    def __init__(self) -> None:
        self.held: dict[bytes, dict[bytes | None, list]] = {}
        self.cells = 0

    def add(self, lang: bytes, source: bytes, text: bytes) -> None:
        """Folds one whole document in."""
        counts: dict[bytes | None, int] = Counter(terms(text))
        counts[None] = 1
        held = self.held.setdefault(lang, {})
        for term, n in counts.items():
            stripe = held.get(term)
            if stripe is None:
                held[term] = [1, {source: n}]
                self.cells += 1
            else:
                stripe[0] += 1
                by = stripe[1]
                if source in by:
                    by[source] += n
                else:
                    by[source] = n
                    self.cells += 1

    def spill(self) -> pa.RecordBatch:
        """All stripes as rows; the table is empty then."""
        batch = stripe_rows((lang, term, df, by) for lang, held in self.held.items() for term, (df, by) in held.items())
        self.held, self.cells = {}, 0
        return batch


def stripe_rows(stripes: Iterable[tuple[bytes, bytes | None, int, dict[bytes, int]]]) -> pa.RecordBatch:
    langs, names, dfs, sources, counts, ends = [], [], [], [], [], [0]
    for lang, term, df, by in stripes:
        langs.append(lang)
        names.append(term)
        dfs.append(df)
        sources.extend(by)
        counts.extend(by.values())
        ends.append(len(sources))
    text = lambda values: pa.array(values, pa.binary()).cast(pa.string())
    offsets = pa.array(ends, pa.int32())
    columns = [text(langs), text(names), pa.array(dfs, pa.int64()), pa.ListArray.from_arrays(offsets, text(sources)), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "term", "df", "sources", "counts"])


def stripes_of(docs: DataFrame, held: int = HELD) -> DataFrame:
    """Stripes of whole documents, folded in each task and written out whenever ``held`` cells are reached."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Stripes()
        for batch in batches:
            for lang, source, text in zip(*(octets(batch.column(i)) for i in range(3)), strict=True):
                table.add(lang, source, text)
                if table.cells >= held:
                    yield table.spill()
        if table.cells:
            yield table.spill()

    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    return docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(fold, STRIPE)


def _open(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    """The rows of a sorted batch without the keys that begin and end inside it and are too rare to keep."""
    if batch.num_rows < 3:
        return batch
    keys = [batch.column(0), pc.fill_null(batch.column(1), "")]
    turns = [pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False) for k in keys]
    starts = np.flatnonzero(np.concatenate([[True], turns[0] | turns[1]]))
    stay = np.add.reduceat(batch.column(2).to_numpy(), starts) >= least
    stay |= batch.column(1).is_null().to_numpy(zero_copy_only=False)[starts]
    stay[[0, -1]] = True
    return batch.filter(pa.array(np.repeat(stay, np.diff(starts, append=batch.num_rows))))


def merged(stripes: DataFrame, least: int) -> DataFrame:
    """One stripe for each language and term with a document frequency of ``least``, and those that count documents.

    Stripes are dealt and sorted by key, so a task holds one key's sources at a time; each mapper sends a key once
    for every time it spills, however often the term occurs.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, df, by, out = None, 0, {}, []
        cells = 0
        for batch in map(partial(_open, least=least), batches):
            langs, names, dfs = octets(batch.column(0)), octets(batch.column(1)), batch.column(2).to_pylist()
            ends = batch.column(3).offsets.to_pylist()
            first = ends[0]
            sources, counts = octets(batch.column(3).flatten()), batch.column(4).flatten().to_pylist()
            for i, now in enumerate(zip(langs, names, strict=True)):
                if now != key:
                    if key and (df >= least or key[1] is None):
                        out.append((*key, df, by))
                        cells += len(by)
                    key, df, by = now, 0, {}
                df += dfs[i]
                for j in range(ends[i] - first, ends[i + 1] - first):
                    by[sources[j]] = by.get(sources[j], 0) + counts[j]
            if cells > 100_000:
                yield stripe_rows(out)
                out, cells = [], 0
        if key and (df >= least or key[1] is None):
            out.append((*key, df, by))
        if out:
            yield stripe_rows(out)

    return stripes.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(merge, STRIPE)


def share(count, total, kept):
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * kept)), in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.expr("1L") + F.call_function("div", (wide(count) + F.lit(PRIOR)) * F.lit(UNIT), wide(total) + wide(kept) * F.lit(PRIOR))


def divergences(docs: DataFrame, least: int = 30, top: int = 50, held: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank): where the sources of each language part in their use of words.

    A language keeps the terms of at least ``least`` of its documents. A group (language, source), and the language as
    a whole, gives a kept term the share p = 1 + floor(1e9 * (count + 5) / (N + 5 * V)): N is the group's count
    of kept terms, V their number. Part ``pair`` sums the distances of shares over all kept terms for each two sources
    of a language; part ``term`` lists the ``top`` terms that a source uses more than its language.

    Partitions fold whole documents into stripes and spill them at ``held`` cells; stripes are merged by key, and both
    parts come from the merged stripes, which are written once. Pairs are compared in tiles of 256 sources and blocks
    of about 2,000 terms, so neither a common term nor a language with a large share lands in one task.

    Edge cases: null text, language and source are read as empty, and an empty language or source is a group like any
    other; groups without terms have pairs (value 0 where the language keeps no term) and no terms; a repeated row
    counts again; texts of any length are folded whole; ties rank by item in UTF-8 order; an empty table gives no rows;
    other columns are not read.
    """
    # stripes are short rows: many go to Python at once, as many bytes as ever
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    stripes = durable(merged(stripes_of(docs, held), least), "stripes")
    kept = stripes.where(F.col("term").isNotNull())
    cells = kept.select("lang", F.explode(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("count"))).alias("cell")).select("lang", "cell.*")
    sums = cells.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    every = stripes.where(F.col("term").isNull()).select("lang", F.explode("sources").alias("source"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("lang_total"))
    none = lambda name: F.coalesce(F.col(name), F.lit(0).cast("long")).alias(name)
    groups = every.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", none("total"), none("kept"), none("lang_total"))
    groups = durable(groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "groups")
    return _pairs(kept, groups).unionByName(_terms(kept, groups, top))


def _terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The terms that a source uses more than its language, by distance of shares."""
    used = kept.select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("all"), F.explode(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("count"))).alias("cell"))
    used = used.select("lang", "term", "all", "cell.*").join(groups, ["lang", "source"])
    value = share(F.col("count"), F.col("total"), F.col("kept")) - share(F.col("all"), F.col("lang_total"), F.col("kept"))
    far = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """The summed distances of each two sources of a language.

    Each language's sources are cut into tiles, and each pair of tiles meets its terms in blocks: the tiles' totals
    and the block's counts are brought together by key, as a matrix of shares each.
    """
    tile = lambda c: F.floor(c / TILE).cast("int")
    langs = groups.groupBy("lang").agg(F.max(tile(F.col("no"))).alias("last"), F.max("kept").alias("kept"))
    langs = langs.select("lang", "last", (F.floor(F.col("kept") / TERMS) + 1).alias("blocks"))
    both = lambda df: df.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumn("b", F.explode(F.sequence(F.col("a"), F.col("last"))))
    heads = both(langs).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    members = groups.select(F.col("lang"), tile(F.col("no")).alias("tile"), "source", "total", "kept").groupBy("lang", "tile").agg(F.sort_array(F.collect_list(F.struct("source", "total", "kept"))).alias("members"))
    named = lambda side: members.select("lang", F.col("tile").alias(side), F.col("members").alias(f"members_{side}"))
    heads = heads.join(named("a"), ["lang", "a"]).join(named("b"), ["lang", "b"]).select("lang", "a", "b", "block", "members_a", "members_b")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    rows = both(kept.join(langs, "lang")).select("lang", "a", "b", block, "sources", "counts")

    def compare(head: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(head):
            return pd.DataFrame({"lang": [], "source": [], "item": [], "value": []})
        first = head.iloc[0]
        sides = [{m["source"]: i for i, m in enumerate(first[f"members_{s}"])} for s in "ab"]
        shares = []
        for side, at in zip("ab", sides, strict=True):
            counts = np.zeros((len(at), len(rows)), np.int64)
            for j, (sources, found) in enumerate(zip(rows["sources"], rows["counts"], strict=True)):
                for source, n in zip(sources, found, strict=True):
                    if (i := at.get(source)) is not None:
                        counts[i, j] = n
            shares.append(np.stack([exact_shares(counts[i], int(m["total"]), int(m["kept"])) for i, m in enumerate(first[f"members_{side}"])]) if len(rows) else counts)
        x, y = shares
        names = [list(at) for at in sides]
        out = []
        for i, name in enumerate(names[0]):
            far = np.abs(y - x[i]).sum(axis=1).tolist()
            out += [(first["lang"], s, t, v) for item, v in zip(names[1], far, strict=True) if item != name for s, t in ((name, item), (item, name))[: 1 + (first["a"] != first["b"])]]
        return pd.DataFrame(out, columns=["lang", "source", "item", "value"])

    keys = ["lang", "a", "b", "block"]
    parts = heads.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(compare, "lang string, source string, item string, value long")
    far = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return far.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def exact_shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """``share`` of the counts of one group: long division in parts where the product would leave 64 bits."""
    if (int(counts.max(initial=0)) + PRIOR) * UNIT < 1 << 63:
        return 1 + (counts + PRIOR) * UNIT // (total + PRIOR * kept)
    return np.array([1 + (int(c) + PRIOR) * UNIT // (total + PRIOR * kept) for c in counts], np.int64)
