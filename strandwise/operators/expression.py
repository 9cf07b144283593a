"""Gene spans and expression tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_COUNT = 2


def gene_spans(exons: DataFrame, gene: str = "gene") -> DataFrame:
    """Hull of each gene's exons."""
    return exons.groupBy(gene, "chrom", "strand").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    )


def expression_table(counts: DataFrame, genes: DataFrame, gene: str = "gene") -> DataFrame:
    """Replicate counts summed per gene and condition; genes without counts have 0.

    Conditions are a dimension of a handful of names, attached to each gene inside its row.
    """
    names = counts.select("condition").distinct()
    listed = names.agg(F.array_sort(F.collect_list("condition")).alias("c"))
    scaffold = genes.withColumn("condition", F.explode(listed.scalar()))
    summed = counts.groupBy("condition", gene).agg(F.sum("count").alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0).cast("long"))
    return scaffold.join(summed, ["condition", gene], "left").select(
        "condition",
        gene,
        "chrom",
        "strand",
        "start",
        "end",
        n.alias("rna_count"),
        (n >= MIN_COUNT).alias("expressed"),
    )
