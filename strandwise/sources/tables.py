"""Tables in and out: column maps, count files, sample sheets, appends and track files."""

from __future__ import annotations

import os
import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.functions.coords import condition_name
from strandwise.operators.quality import QualityError, require_columns

# Sample-sheet (treatment, type) -> library, and the size of a full sheet.
LIBRARY_OF = {("TIS", "RPF"): "tis", ("CHX", "RPF"): "chx", ("TIS", "Input"): "rna"}
FULL_SHEET = 6 * 3 * 2


def read_table(
    spark: SparkSession, source: str | DataFrame, schema: T.StructType | str | None = None
) -> DataFrame:
    """Parquet by suffix, otherwise tab-separated text with a header."""
    if isinstance(source, DataFrame):
        return source
    if not isinstance(source, str):
        raise TypeError(f"cannot read a table from {type(source).__name__}")
    if source.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(source)
    reader = spark.read.option("sep", "\t").option("header", True)
    return (reader.schema(schema) if schema else reader).csv(source)


def rename_project(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Keep and rename the mapped columns that exist, in map order."""
    return df.select(
        [F.col(f"`{s}`").alias(t) for s, t in columns.items() if s in df.columns]
    )


def load_annotation(df: DataFrame, columns: Mapping[str, str], required: Sequence[str]) -> DataFrame:
    """Mapped columns with required ones checked and ids as text; comma lists become arrays."""
    out = rename_project(df, columns)
    require_columns(out, required, "annotation")
    out = out.withColumn("transcript_id", F.col("transcript_id").cast("string"))
    types = dict(out.dtypes)
    for c in ("exon_starts", "exon_ends"):
        if types.get(c) == "string":
            parts = F.filter(F.split(c, ","), lambda x: F.trim(x) != "")
            out = out.withColumn(c, F.transform(parts, lambda x: F.trim(x).cast("long")))
    if "exon_starts" in out.columns and "exon_ends" in out.columns:
        zipped = F.arrays_zip(F.col("exon_starts").alias("start"), F.col("exon_ends").alias("end"))
        out = out.withColumn("exons", F.array_sort(zipped)).drop("exon_starts", "exon_ends")
    return out


def gene_counts(lines: DataFrame) -> DataFrame:
    """Two-column count text without its ``__`` summary rows."""
    fields = F.split("text", "\t")
    return lines.where(~F.col("text").startswith("__")).withColumns(
        {"gene_id": F.element_at(fields, 1), "count": F.element_at(fields, 2).cast("long")}
    ).drop("text")


def resolve_count_files(samples: DataFrame, files: DataFrame) -> DataFrame:
    """The count file of each sample: its own name, else the only lane variant of its library.

    Adds ``file`` (NULL unless resolved) and ``status``: exact, lane, missing or ambiguous.
    """
    stem = F.regexp_replace("file", "_htseqcount\\.txt$", "")
    names = files.select("file", stem.alias("_stem")).distinct()
    exact = names.select(F.col("_stem").alias("sample_id"), F.col("file").alias("_exact"))
    lanes = names.where(F.col("_stem").rlike("_L[^_]*$")).groupBy(
        F.regexp_replace("_stem", "_L[^_]*$", "").alias("_library")
    ).agg(F.count(F.lit(1)).alias("_n"), F.min("file").alias("_lane"))
    joined = (
        samples.withColumn("_library", F.regexp_replace("sample_id", "_L\\d+$", ""))
        .join(exact, "sample_id", "left")
        .join(lanes, "_library", "left")
    )
    status = (
        F.when(F.col("_exact").isNotNull(), "exact")
        .when(F.col("_n") == 1, "lane")
        .when(F.col("_n") > 1, "ambiguous")
        .otherwise("missing")
    )
    return joined.withColumn("status", status).withColumn(
        "file",
        F.when(status == "exact", F.col("_exact")).when(status == "lane", F.col("_lane")),
    ).drop("_library", "_exact", "_n", "_lane")


def load_samples(sheet: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Sample rows of the known libraries with a path; ``overrides`` replaces paths by id."""
    library = None
    for (treatment, kind), name in LIBRARY_OF.items():
        hit = (F.col("treatment") == treatment) & (F.col("type") == kind)
        library = F.when(hit, name) if library is None else library.when(hit, name)
    rows = sheet.where(F.coalesce(F.trim("bam_path"), F.lit("")) != "").select(
        condition_name(F.col("cell_line"), F.col("condition")).alias("condition"),
        library.alias("library"),
        F.col("rep").cast("double").cast("int").alias("rep"),
        "sample_id",
        F.col("bam_path").alias("bam"),
    )
    rows = rows.where("library IS NOT NULL")
    if overrides is None:
        return rows
    new = overrides.select("sample_id", F.col("bam").alias("_new"))
    return rows.join(new, "sample_id", "left").withColumn("bam", F.coalesce("_new", "bam")).drop("_new")


def require_full_sheet(samples: DataFrame, overrides: DataFrame | None = None) -> None:
    """Raise unless every (condition, library, replicate) occurs once and overrides are known."""
    keys = samples.groupBy("condition", "library", "rep").count()
    found = keys.agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most")).first()
    if found["n"] != FULL_SHEET or found["most"] != 1:
        raise QualityError(f"expected {FULL_SHEET} unique condition/library/rep samples")
    if overrides is not None:
        unknown = overrides.join(samples, "sample_id", "left_anti").select("sample_id").limit(5)
        names = [r["sample_id"] for r in unknown.collect()]
        if names:
            raise QualityError(f"unknown sample_id in overrides: {names}")


def write_track(track: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Track rows as parquet, partitioned and sorted by position inside each file.

    A hot chromosome is spread over files by blocks of positions, not gathered in one task.
    """
    block = F.floor(F.col("pos") / F.lit(1 << 22))
    spread = track.repartition(*partitions, block)
    spread.sortWithinPartitions(*partitions, "pos").write.mode("overwrite").partitionBy(
        *partitions
    ).parquet(path)


def append_evolving(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Append rows as a new file; new columns go last and are NULL in older rows."""
    known = os.path.join(path, f"part={time.time_ns():020d}")
    rows.write.parquet(known)
    return spark.read.option("mergeSchema", "true").parquet(path).drop("part")


def write_calls(calls: DataFrame, summary: DataFrame, path: str) -> None:
    """Calls as parquet and their summary as JSON, next to each other."""
    calls.write.mode("overwrite").parquet(os.path.join(path, "calls.parquet"))
    summary.write.mode("overwrite").json(os.path.join(path, "summary"))


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header; missing values are ``nan``."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option(
        "nullValue", "nan"
    ).csv(path)
