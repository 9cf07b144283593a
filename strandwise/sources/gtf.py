"""Annotation text (tab-separated, 1-based inclusive) read with the text source.

Convert once to parquet: a text scan cannot prune columns or rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = 'tag "MANE_Select"'


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, text)``: an explicit line order, needed where the first row wins.

    The order is that of files by name, of the blocks read from a file, and of the rows in a block: a
    struct that compares by file, block start and row.
    """
    at = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return spark.read.text(path).select(at.alias("line_no"), F.col("value").alias("text"))


def attribute(text: Column, name: str) -> Column:
    """Quoted attribute value, NULL when absent."""
    found = F.regexp_extract(text, name + ' "([^"]+)"', 1)
    return F.when(found != "", found)


def parse(lines: DataFrame) -> DataFrame:
    """Feature rows in 0-based half-open coordinates; comments and short lines are skipped."""
    fields = F.split("text", "\t")
    rows = lines.where(~F.col("text").startswith("#")).withColumn("_f", fields)
    rows = rows.where(F.size("_f") >= 9)
    f = lambda i: F.element_at("_f", i)
    return rows.select(
        "line_no",
        f(1).alias("chrom"),
        f(3).alias("feature"),
        (f(4).cast("long") - 1).alias("start"),
        f(5).cast("long").alias("end"),
        f(7).alias("strand"),
        attribute(f(9), "gene_id").alias("gene_id"),
        attribute(f(9), "transcript_id").alias("transcript_id"),
        attribute(f(9), "gene_name").alias("gene_name"),
        F.contains(F.col("text"), F.lit(TAG)).alias("tagged"),
    )


def exon_models(rows: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """One row per transcript with its sorted exons; ``keep`` limits the transcripts."""
    exons = rows.where("feature = 'exon' AND transcript_id IS NOT NULL")
    if keep is not None:
        exons = exons.join(keep.select("transcript_id").distinct(), "transcript_id", "left_semi")
    return exons.groupBy("transcript_id", "chrom", "strand").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons")
    )


def gene_spans(rows: DataFrame) -> DataFrame:
    """Gene rows as spans."""
    return rows.where("feature = 'gene'").select("gene_id", "chrom", "strand", "start", "end")


def tagged_models(rows: DataFrame) -> DataFrame:
    """Tagged transcripts: exon hull, exons, CDS intervals, ids and first line."""
    own = rows.where("tagged AND feature IN ('exon', 'CDS') AND transcript_id IS NOT NULL")
    span = F.struct("start", "end")
    pick = lambda feature, value: F.when(F.col("feature") == feature, value)
    return own.groupBy("transcript_id").agg(
        F.min_by("chrom", "line_no").alias("chrom"),
        F.min_by("strand", "line_no").alias("strand"),
        F.min_by("gene_id", "line_no").alias("gene_id"),
        F.min_by("gene_name", "line_no").alias("gene_name"),
        F.min(pick("exon", F.col("start"))).alias("start"),
        F.max(pick("exon", F.col("end"))).alias("end"),
        F.array_sort(F.collect_list(pick("exon", span))).alias("exons"),
        F.array_sort(F.collect_list(pick("CDS", span))).alias("cds"),
        F.min("line_no").alias("line_no"),
    )


def units(rows: DataFrame) -> DataFrame:
    """The first tagged transcript per gene with exons and CDS; the name falls back to the id."""
    models = tagged_models(rows).where((F.size("exons") > 0) & (F.size("cds") > 0))
    rest = [c for c in models.columns if c != "gene_id"]
    first = models.groupBy("gene_id").agg(
        F.min_by(F.struct(*rest), F.col("line_no")).alias("_u")
    )
    return first.select("gene_id", "_u.*").withColumn(
        "gene_name", F.coalesce("gene_name", "gene_id")
    )
