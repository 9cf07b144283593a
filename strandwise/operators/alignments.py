"""Read filters and placement of reads on the genome, over an alignment table.

Columns: ``start`` and ``end`` (reference), ``cigar ARRAY<STRUCT<op INT, len BIGINT>>``, ``mapq``,
``is_reverse``, ``is_unmapped``, ``is_secondary``, ``nh`` (nullable), ``md``, ``read_length``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Filters and CIGAR operation groups.
MIN_MAPQ = 1
MAX_NH = 5
MATCH_OPS = (0, 7, 8)
INSERT_OP = 1
SKIP_OPS = (2, 3)


def passes_filters() -> Column:
    """Mapped, primary, good mapping quality, few hits (or no hit count)."""
    few = F.col("nh").isNull() | (F.col("nh") <= MAX_NH)
    return ~F.col("is_unmapped") & ~F.col("is_secondary") & (F.col("mapq") >= MIN_MAPQ) & few


def five_prime_mismatch() -> Column:
    """The first sequenced base is a mismatch."""
    forward = F.col("md").rlike("^0")
    backward = F.col("md").rlike("\\D0$")
    return F.when(F.col("is_reverse"), backward).otherwise(forward)


def place_on_genome(p: Column) -> Column:
    """Genomic position of read base ``p`` counted from the read's 5' end; NULL when outside.

    The CIGAR is folded inside the row: match runs consume read and reference, insertions the
    read, skips the reference.
    """
    start, end, length = F.col("start"), F.col("end"), F.col("read_length")
    reverse = F.col("is_reverse")
    want = F.when(reverse, length - p).otherwise(p).cast("long")
    slack = F.when(reverse, 0).otherwise(1)
    zero = F.lit(0).cast("long")

    def step(acc: Column, op: Column) -> Column:
        match = op["op"].isin(*MATCH_OPS)
        insert = op["op"] == INSERT_OP
        uses_read = match | insert
        uses_ref = match | op["op"].isin(*SKIP_OPS)
        left = acc["left"]
        ends_here = uses_read & (op["len"] - left >= slack)
        here = F.when(match, acc["pos"] + left).otherwise(acc["pos"])
        return F.struct(
            F.when(uses_ref, acc["pos"] + op["len"]).otherwise(acc["pos"]).alias("pos"),
            F.when(uses_read, left - op["len"]).otherwise(left).alias("left"),
            F.coalesce(acc["found"], F.when(ends_here, here)).alias("found"),
        )

    first = F.struct(
        start.alias("pos"), (want + zero).alias("left"), F.lit(None).cast("long").alias("found")
    )
    walked = F.aggregate("cigar", first, step, lambda a: F.coalesce(a["found"], a["pos"]))
    return (
        F.when((p < 0) | (p > length), F.lit(None).cast("long"))
        .when(p == 0, F.when(reverse, end).otherwise(start))
        .when(p == length, F.when(reverse, start).otherwise(end))
        .otherwise(walked)
    )


def p_sites(reads: DataFrame, offsets: DataFrame) -> DataFrame:
    """Reads with their P-site ``pos``; reads that fail a filter or have no offset are dropped.

    ``offsets``: ``table`` (``main`` or ``mismatch``), ``length``, ``offset``. The mismatch table is
    used for reads with a 5' mismatch if it has any row.
    """
    has_second = offsets.agg(F.max(F.col("table") == "mismatch")).scalar()
    chosen = F.when(five_prime_mismatch() & F.coalesce(has_second, F.lit(False)), "mismatch")
    kept = reads.where(passes_filters()).withColumn("table", chosen.otherwise("main"))
    joined = kept.join(
        offsets.withColumnRenamed("length", "read_length"), ["table", "read_length"]
    )
    placed = joined.withColumn("pos", place_on_genome(F.col("offset")))
    return placed.where(F.col("pos").isNotNull()).drop("table", "offset")


def five_prime_ends(reads: DataFrame) -> DataFrame:
    """5' end of reads that pass the filters; of pairs only the first read."""
    kept = reads.where(passes_filters() & (~F.col("is_paired") | F.col("is_read1")))
    at = F.when(F.col("is_reverse"), F.col("end") - 1).otherwise(F.col("start"))
    return kept.withColumn("pos", at)


def significant(tis_p: str, ribo_p: str, fisher_q: str) -> Column:
    """Inclusive significance limits of a call table."""
    # The three limits.
    return (F.col(tis_p) <= 0.01) & (F.col(ribo_p) <= 0.01) & (F.col(fisher_q) <= 0.05)


def call_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Shared and own calls of two sets and their Jaccard index (1 when both are empty)."""
    left = a.select(*keys).distinct().withColumn("_a", F.lit(1))
    right = b.select(*keys).distinct().withColumn("_b", F.lit(1))
    j = left.join(right, keys, "full_outer").agg(
        F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("shared"),
        F.count(F.when(F.col("_b").isNull(), 1)).alias("only_a"),
        F.count(F.when(F.col("_a").isNull(), 1)).alias("only_b"),
    )
    total = F.col("shared") + F.col("only_a") + F.col("only_b")
    return j.withColumn("jaccard", F.when(total == 0, 1.0).otherwise(F.col("shared") / total))
