"""Genome-shaped views over the driver's tables, by plain projection.

The driver's tables hold no genome data. Each view here has the schema an operator needs; the
same view is written in SQL in ``sqlviews`` for the check. No view depends on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
CHROM_SIZE = 8640
LETTERS = (
    "EIOURSLDNMPBFHVWXYeioursldnmpbfhvwxyacgt",
    "ACGTACGTACGTACGTACACGTACGTACGTACGTACACGT",
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(n: Column, names: tuple[str, ...]) -> Column:
    out = F.when(n == 0, names[0])
    for i, v in enumerate(names[1:-1], 1):
        out = out.when(n == i, v)
    return out.otherwise(names[-1])


CHROMS = ("chr7", "chr8", "chr9", "chr1", "chr2")
EVENT_CHROMS = {"view": "chr7", "signup": "chr8", "error": "chr9", "purchase": "chr1"}


def reads(spark: SparkSession, sf: str) -> DataFrame:
    """One row per read placed on a track, in file coordinates (minus strand shifted)."""
    e = table(spark, sf, "events")
    chrom = F.lit("chr2")
    for event, name in EVENT_CHROMS.items():
        chrom = F.when(F.col("event_type") == event, name).otherwise(chrom)
    seconds = F.expr(f"timestampdiff(SECOND, {ORIGIN}, ts)")
    library = _pick(F.expr("(event_id div 2) % 3"), ("tis", "chx", "rna"))
    strand = F.when(F.col("event_id") % 2 == 0, "+").otherwise("-")
    return e.select(
        F.concat(F.lit("C"), (F.col("user_id") % 3).cast("string")).alias("condition"),
        library.alias("library"),
        (F.expr("(user_id div 3) % 2") + 1).cast("long").alias("rep"),
        chrom.alias("chrom"),
        strand.alias("strand"),
        (
            F.floor(seconds / 300).cast("long") % 108 * 80
            + 5
            + (F.col("user_id") % 2) * (F.col("user_id") % 7)
        ).alias("pos"),
    )


def exons(spark: SparkSession, sf: str) -> DataFrame:
    """Exons of transcripts ``tx`` (two per gene), half-open, at most seven per transcript."""
    li = table(spark, sf, "lineitem")
    rows = li.groupBy(
        F.col("l_orderkey").alias("tx"), F.col("l_linenumber").cast("long").alias("rank")
    ).agg(F.max("l_quantity").cast("long").alias("len"))
    gene = F.expr("tx div 2")
    start = (gene * 37) % 8000 + 7 * (F.col("tx") % 2) + 60 * (F.col("rank") - 1)
    return rows.select(
        "tx",
        gene.alias("gene"),
        _pick(gene % 5, CHROMS).alias("chrom"),
        F.when(F.expr("(tx div 10) % 2") == 0, "+").otherwise("-").alias("strand"),
        start.alias("start"),
        (start + F.col("len")).alias("end"),
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Scored candidates, one row per line item."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("condition"),
        F.col("l_orderkey").alias("transcript_id"),
        _pick(F.col("l_partkey") % 5, CHROMS).alias("chrom"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        F.col("l_partkey").alias("gpos"),
        _pick(
            F.col("l_partkey") % 7 % 5,
            ("AUG", "AAG", "AGG", "other_near_cognate", "non_cognate"),
        ).alias("codon_class"),
        _pick(
            F.expr("(l_partkey div 7) % 5"),
            ("utr5", "annotated", "cds_inframe", "cds_outframe", "other"),
        ).alias("region"),
        F.col("l_extendedprice").alias("score"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """Truth starts: one row per START_KEY with three-state replicate flags."""
    c = candidates(spark, sf)
    moved = F.when(F.col("gpos") % 11 == 0, F.col("gpos") + 100000).otherwise(F.col("gpos"))
    known = F.col("tax") > 0
    per = c.withColumn("gpos", moved).groupBy("condition", "chrom", "strand", "gpos").agg(
        F.max("codon_class").alias("codon_class"),
        F.max("region").alias("region"),
        F.max(F.when(known, (F.col("quantity") >= 20).cast("int"))).alias("r1"),
        F.max(F.when(known, (F.col("discount") >= 0.04).cast("int"))).alias("r2"),
    )
    return per.select(
        "condition",
        "chrom",
        "strand",
        "gpos",
        "codon_class",
        "region",
        (F.col("r1") == 1).alias("rep1"),
        (F.col("r2") == 1).alias("rep2"),
    )


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Scored labelled sites, unique by ``(transcript_id, mrna_index)``."""
    li = table(spark, sf, "lineitem")
    rows = li.select(
        F.expr("l_orderkey div 16").alias("transcript_id"),
        F.col("l_partkey").alias("mrna_index"),
        F.floor(F.col("l_extendedprice") / 100).alias("s"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") <= 3)).cast("int").alias("y"),
    )
    sites = rows.groupBy("transcript_id", "mrna_index").agg(
        F.max("s").alias("s"), F.max("y").alias("y")
    )
    t = F.col("transcript_id")
    return sites.select(
        "transcript_id",
        "mrna_index",
        (t * 1000000 + F.col("mrna_index")).alias("row_idx"),
        (F.col("s") / 1050.0).alias("score"),
        (F.pmod(F.col("s") * 7 + F.col("mrna_index"), F.lit(1000)) / 1000.0).alias("score_b"),
        F.col("y").alias("label"),
        _pick(F.col("mrna_index") % 5 % 3, ("AUG", "near_cognate", "non_cognate")).alias(
            "codon_class"
        ),
        _pick(t % 4, ("train", "train", "val", "test")).alias("split"),
    )


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Documents read as ACGT strings."""
    d = table(spark, sf, "documents").repartition("doc_id")  # rows multiply from here on
    letters = F.translate("text", *LETTERS)
    return d.select("doc_id", F.regexp_replace(letters, "[^ACGT]", "").alias("seq"))


def shares_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per condition, replicate and site, with the site's gene."""
    o = table(spark, sf, "orders")
    gpos = F.col("o_custkey")
    keyed = o.select(
        F.col("o_orderpriority").alias("condition"),
        (F.col("o_orderkey") % 2 + 1).cast("long").alias("rep"),
        F.expr("o_custkey div 10").alias("gene"),
        _pick(gpos % 5, CHROMS).alias("chrom"),
        F.when(gpos % 2 == 0, "+").otherwise("-").alias("strand"),
        gpos.alias("gpos"),
    )
    return keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("count"))


def gene_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Read counts per condition, replicate and gene; many genes are missing."""
    o = table(spark, sf, "orders")
    return o.groupBy(
        F.concat(F.lit("C"), (F.col("o_custkey") % 3).cast("string")).alias("condition"),
        (F.expr("(o_custkey div 3) % 2") + 1).cast("long").alias("rep"),
        F.expr("o_orderkey div 3").alias("gene"),
    ).agg(F.sum(F.floor(F.col("o_totalprice")).cast("long") % 3).alias("count"))


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Order spans in days, by priority."""
    o = table(spark, sf, "orders")
    day = F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long")
    return o.select(
        F.col("o_orderkey").alias("span_id"),
        F.col("o_orderpriority").alias("chrom"),
        day.alias("start"),
        (day + F.col("o_custkey") % 30 + 1).alias("end"),
    )


def windows(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping windows of 512 positions wherever the tracks have reads."""
    base = reads(spark, sf).select("chrom", (F.expr("pos div 256") * 256).alias("start"))
    return base.distinct().withColumn("end", F.col("start") + 512)


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Feature vectors with a binary label."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("row_idx"),
        F.col("embedding").alias("features"),
        (F.col("label") % 2).cast("int").alias("label"),
        F.col("label").cast("long").alias("class"),
    )
