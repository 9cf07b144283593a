"""Feature tables: one parquet table per key, joined by row id instead of by position.

A key's rows are range-partitioned and sorted by ``row_idx``, in folders of blocks of ids. A manifest names each
block's rows, bounds and width, so that a selective read opens the files of the wanted blocks alone.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.operators.quality import QualityError
from strandwise.operators.scoring import key_coverage
from strandwise.sources.tables import append_evolving

#: Row ids in a block of a store.
BLOCK_ROWS = 1 << 18


def read_shards(spark: SparkSession, pattern: str, columns: Sequence[str] = ()) -> DataFrame:
    """Rows of all shard files; only the wanted columns are read."""
    df = spark.read.parquet(pattern)
    return df.select("row_idx", *columns) if columns else df


def _block(rows: int | Column) -> Column:
    return F.floor(F.col("row_idx") / rows).cast("long")


def write_store(
    shards: DataFrame, keys: Sequence[str], wanted: DataFrame, path: str, *, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Write each key's column as its own table and append one provenance row per key.

    Rows whose value is null are not of the key. Returns the provenance of this and earlier runs (``provenance``).
    A row id that stands twice, or arrays of different widths, raise before the manifest names the key.
    """
    spark = shards.sparkSession
    parts, widths = {}, {}
    for k in keys:
        folder = os.path.join(path, "features", k)
        rows = shards.where(F.col(k).isNotNull()).select("row_idx", F.col(k).alias("features"), _block(block_rows).alias("block"))
        rows.repartitionByRange("row_idx").sortWithinPartitions("block", "row_idx").write.mode("overwrite").partitionBy("block").parquet(folder)
        parts[k] = spark.read.schema("row_idx long, features " + dict(rows.dtypes)["features"] + ", block long").parquet(folder)
        facts = parts[k].groupBy("block").agg(
            F.count(F.lit(1)).alias("rows"), F.min("row_idx").alias("first"), F.max("row_idx").alias("last"),
            F.min(F.size("features")).alias("dim"), F.max(F.size("features")).alias("most"),
        )
        held = parts[k].select("row_idx").distinct().agg(F.count(F.lit(1)).alias("n")).first()["n"]
        seen = facts.agg(F.sum("rows").alias("n"), F.min("dim").alias("dim"), F.max("most").alias("most")).first()
        if (seen["n"] or 0) != held:
            raise QualityError(f"row ids of {k} repeat")
        if seen["dim"] != seen["most"]:
            raise QualityError(f"arrays of {k} have {seen['dim']} to {seen['most']} values")
        widths[k] = seen["dim"]
        rest = facts.select(F.lit(k).alias("key"), F.lit(block_rows).cast("long").alias("block_rows"), "block", "rows", "first", "last", "dim")
        append_evolving(spark, os.path.join(path, "manifest"), rest.coalesce(1))
    dim = F.create_map(*[v for k, w in widths.items() for v in (F.lit(k), F.lit(w).cast("int"))])
    facts = key_coverage(parts, wanted, "row_idx").withColumn("dim", dim[F.col("key")])
    append_evolving(spark, os.path.join(path, "provenance"), facts)
    return provenance(spark, path)


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    """Appended rows of each key's last run."""
    rows = spark.read.option("mergeSchema", "true").parquet(folder)
    last = rows.groupBy("key").agg(F.max("part").alias("part"))
    return rows.join(last, ["key", "part"], "left_semi").drop("part")


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """``key, covered, expected, complete, dim``: the last run of every key of a store."""
    return _latest(spark, os.path.join(path, "provenance"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``key, block_rows, block, rows, first, last, dim``: the blocks of every key of a store."""
    return _latest(spark, os.path.join(path, "manifest"))


def load_rows(spark: SparkSession, path: str, keys: Sequence[str], rows: DataFrame) -> DataFrame:
    """Features of the selected rows, one column per key.

    Only the blocks that hold selected ids are opened. An unknown key, and a key that misses a selected row, raise at
    once (by row ids alone); an array that is shorter than the manifest says raises where it is read.
    """
    known = manifest(spark, path).where(F.col("key").isin(*keys))
    widths = {r["key"]: r for r in known.groupBy("key").agg(F.max("dim").alias("dim"), F.max("block_rows").alias("size")).collect()}
    unknown = sorted(set(keys) - set(widths))
    if unknown:
        raise QualityError(f"the store has no features {unknown}")
    chosen = rows.select("row_idx").distinct()
    parts, short = {}, []
    for k in keys:
        wanted = chosen.select(_block(widths[k]["size"]).alias("block")).distinct()
        blocks = known.where(F.col("key") == k).join(wanted, "block", "left_semi").select("block").collect()  # names of folders
        part = spark.read.parquet(os.path.join(path, "features", k)).where(F.col("block").isin([r["block"] for r in blocks])).drop("block")
        if not chosen.join(part.select("row_idx"), "row_idx", "left_anti").isEmpty():
            short.append(k)
        size = widths[k]["dim"]
        odd = F.raise_error(F.concat(F.lit(f"{k} has not {size} values in row "), F.col("row_idx").cast("string")))
        parts[k] = part.select("row_idx", F.when(F.size("features") == size, F.col("features")).otherwise(odd).alias(k))
    if short:
        raise QualityError(f"features do not cover the selected rows: {short}")
    out = chosen
    for part in parts.values():
        out = out.join(part, "row_idx")
    return out
