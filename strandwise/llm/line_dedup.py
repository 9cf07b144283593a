"""Lines that many documents share, dropped by levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType

from strandwise.llm.common import WHITE, octets, packed, unpacked
from strandwise.session import durable, shared_folder

#: A null doc_id counts as one document with an id below all others.
NO_ID = -(2**63)


def _key(line: bytes, min_chars: int) -> bytes | None:
    """The line without white space at its ends, A-Z in lower case; None if it has too few code points."""
    key = line.strip(WHITE).lower()
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and not key.isascii() and len(key.decode(errors="replace")) < min_chars:
        return None
    return key


def _hashes(min_chars: int):
    """Arrow batches of (doc, text) to (doc, hi, lo): the 128-bit hash of each distinct key of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            docs, texts = batch.column(0).to_numpy(zero_copy_only=False), octets(batch.column(1))
            counts, found = [], []
            for text in texts:
                own = {_key(line, min_chars) for line in (text or b"").split(b"\n")}
                own.discard(None)
                found.extend(map(digest, own))
                counts.append(len(own))
            halves = np.frombuffer(b"".join(found), dtype=">i8").astype(np.int64).reshape(-1, 2)
            columns = [np.repeat(docs, counts), halves[:, 0].copy(), halves[:, 1].copy()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], ["doc", "hi", "lo"])

    return run


class SortedRuns:
    """Line states (hi, lo, n documents, keeper) in runs that are bucketed and sorted by hash, by level.

    A new batch is merge-anti-joined with the settled lines of each run, and what is left becomes a run of
    level 0. When a level has ``fanout`` runs they are merged into one of the next level. Runs have as many
    buckets as a shuffle has partitions, so the anti-joins read them without another exchange.
    """

    def __init__(self, spark, min_docs: int, fanout: int):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[str]] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, df: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark)}/{name}"
        df.write.format("parquet").bucketBy(self.buckets, "hi", "lo").sortBy("hi", "lo").option("path", path).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _merged(self, names: list[str]) -> DataFrame:
        # by path, not as a union of bucketed tables: Spark 4.1 takes such a union for one that is already dealt by key
        whole = self.spark.read.schema("hi long, lo long, n long, keeper long").parquet(*[f"{shared_folder(self.spark)}/{name}" for name in names])
        return whole.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (hi, lo, doc). Batches come with falling ids and share no document."""
        fresh = batch.groupBy("hi", "lo").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper"))
        for name in (n for level in self.levels for n in level):
            settled = self.spark.table(name).where(F.col("n") >= self.min_docs).select("hi", "lo")
            fresh = fresh.join(settled, ["hi", "lo"], "left_anti")
        self._write(fresh, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(self._merged(old), level + 1)
            self._drop(old)
            level += 1

    def settled(self) -> DataFrame:
        """(hi, lo, keeper) of the lines of at least ``min_docs`` documents, over all runs; the runs are dropped."""
        names = [n for level in self.levels for n in level]
        out = durable(self._merged(names).where(F.col("n") >= self.min_docs).select("hi", "lo", "keeper"), "common_lines")
        self._drop(names)
        return out

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _rebuild(min_chars: int, schema: pa.Schema):
    """Drop the lines whose hash is in the document's list; the rest stay as they are, joined by newlines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            texts, listed = octets(batch.column("_text")), batch.column("_gone")
            values = listed.flatten()
            halves = np.empty((len(values), 2), dtype=">i8")
            halves[:, 0], halves[:, 1] = values.field(0).to_numpy(zero_copy_only=False), values.field(1).to_numpy(zero_copy_only=False)
            raw, ends = halves.tobytes(), np.cumsum(listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            kept, lines, dropped, start = [], [], [], 0
            for text, end in zip(texts, ends, strict=True):
                own = (text or b"").split(b"\n")
                if end > start:
                    gone = {raw[16 * i : 16 * i + 16] for i in range(start, end)}
                    stay = [x for x in own if (k := _key(x, min_chars)) is None or digest(k) not in gone]
                    kept.append(b"\n".join(stay))
                else:
                    stay = own
                    kept.append(text)
                lines.append(len(own))
                dropped.append(len(own) - len(stay))
                start = end
            made = {"_text": pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(f.name) for f in schema], schema=schema)

    return run


def drop_common_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3) -> DataFrame:
    """``docs`` with shared lines taken from ``text``, plus ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of ``min_chars``
    code points or more that ``min_docs`` documents hold keep their lines only in the largest doc_id that
    holds them. Batches are ranges of doc_id, largest first, so the first batch that brings a line knows its
    keeper, and once a line has enough documents the anti-join keeps it out of later batches.

    Edge cases: null or empty text is one empty line, and null text stays null; a null doc_id is one document below all
    others; rows that repeat a doc_id are one document; an empty table gives no rows; other columns pass
    through, but a column named n_lines or n_dropped is replaced.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = packed(docs.select(*[F.col(f"`{c}`") for c in columns]), "doc_id", "text")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    edges = sorted(set(docs.stat.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.02))) if batches > 1 else []
    part = F.lit(len(edges))
    for edge in edges:
        part = part - F.when(F.col("doc") >= int(edge), 1).otherwise(0)
    path = f"{shared_folder(spark)}/line_hashes-{uuid.uuid4().hex}"
    hashed = keyed.mapInArrow(_hashes(min_chars), "doc long, hi long, lo long")
    hashed.withColumn("part", part).write.partitionBy("part").parquet(path)
    hashed = spark.read.schema("doc long, hi long, lo long, part int").parquet(path)
    runs = SortedRuns(spark, min_docs, fanout)
    for i in range(len(edges) + 1):
        runs.add(hashed.where(F.col("part") == i))
    gone = hashed.join(runs.settled(), ["hi", "lo"]).where(F.col("doc") < F.col("keeper"))
    gone = gone.groupBy("doc").agg(F.collect_set(F.struct("hi", "lo")).alias("_gone"))
    rows = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumnRenamed("text", "_text")
    rows = rows.join(gone, F.col("_id") == F.col("doc"), "left").drop("_id", "doc")
    rows = rows.withColumn("_gone", F.coalesce("_gone", F.array().cast("array<struct<hi:bigint,lo:bigint>>")))
    out = rows.drop("_gone").schema.add("n_lines", LongType()).add("n_dropped", LongType())
    made = rows.mapInArrow(_rebuild(min_chars, to_arrow_schema(out)), out)
    return made.withColumnRenamed("_text", "text").select(*unpacked(columns, "doc_id", "text"), "n_lines", "n_dropped")
