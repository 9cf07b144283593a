"""Coordinate conventions: strands, splits, regions and loci.

Canonical positions are 0-based; intervals are half-open. Transcript positions run 5' to 3', so
they descend in the genome on the minus strand.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chromosome splits, regions, strands, keys and track conventions.
SPLITS = {"chr7": "val", "chr8": "test", "chr9": "test"}
REGIONS = ("utr5", "annotated", "cds_inframe", "cds_outframe", "other")
IN_CDS = ("cds_inframe", "cds_outframe")
STRANDS = ("+", "-")
SITE_KEY = ("chrom", "strand", "gpos")
START_KEY = ("condition", "chrom", "strand", "gpos")
MINUS_SHIFT = 1
SHIFTED_LIBRARIES = ("tis", "chx")


def split_of(chrom: Column) -> Column:
    """Data split of a chromosome."""
    return (
        F.when(chrom == "chr7", "val").when(chrom.isin("chr8", "chr9"), "test").otherwise("train")
    )


def line_of(condition: Column) -> Column:
    """Group of a condition: the states of the RPE1 line are one group, any other name is its own."""
    return F.when(F.split(condition, "_")[0] == "RPE1", "RPE1").otherwise(condition)


def condition_name(cell_line: Column, state: Column) -> Column:
    """Condition label of a sample-sheet row; the RPE1 line has one per state."""
    # Sheet state -> label suffix.
    suffix = (
        F.when(state == "Async", "Async")
        .when(state == "Quiescent", "Que")
        .when(state == "Senescent", "Sen")
    )
    return F.when(cell_line == "RPE1", F.concat(F.lit("RPE1_"), suffix)).otherwise(cell_line)


def gpos_from_locus(locus: Column, strand: Column) -> Column:
    """0-based first codon base from a standardized locus."""
    return F.when(strand == "-", locus - 1).otherwise(locus)


def locus_from_gpos(gpos: Column, strand: Column) -> Column:
    """Inverse of :func:`gpos_from_locus`."""
    return F.when(strand == "-", gpos + 1).otherwise(gpos)


def downstream(pos: Column, strand: Column, offset: Column | int) -> Column:
    """Genomic position ``offset`` bases 3' of ``pos`` in transcript direction."""
    off = F.lit(offset) if isinstance(offset, int) else offset
    return F.when(strand == "-", pos - off).otherwise(pos + off)


def strand_shift(strand: Column, library: Column) -> Column:
    """File position minus canonical position of a track."""
    shifted = (strand == "-") & library.isin(*SHIFTED_LIBRARIES)
    return F.when(shifted, F.lit(MINUS_SHIFT)).otherwise(F.lit(0)).cast("long")


def candidate_centre(gstart: Column, strand: Column, offset: int) -> Column:
    """File position ``offset`` bases 3' of a candidate's first base in a shifted track."""
    a = gpos_from_locus(gstart, strand)
    return downstream(a, strand, offset) + F.when(strand == "-", MINUS_SHIFT).otherwise(0)


def region_of(tx_pos: Column, cds_start: Column, cds_end: Column) -> Column:
    """Region of a transcript position relative to the CDS."""
    in_frame = F.pmod(tx_pos - cds_start, F.lit(3)) == 0
    return (
        F.when(cds_start.isNull() | cds_end.isNull() | tx_pos.isNull(), "other")
        .when(tx_pos < cds_start, "utr5")
        .when(tx_pos == cds_start, "annotated")
        .when(tx_pos < cds_end, F.when(in_frame, "cds_inframe").otherwise("cds_outframe"))
        .otherwise("other")
    )


def in_cds_frame(tx_pos: Column, cds_start: Column, cds_end: Column) -> Column:
    """In frame with the CDS and inside it, past its start."""
    return (
        (tx_pos > cds_start) & (tx_pos < cds_end) & (F.pmod(tx_pos - cds_start, F.lit(3)) == 0)
    )


def exon_region(tx_pos: Column, first_junction: Column) -> Column:
    """``first`` before the first junction (or without one), else ``later``."""
    return F.when(first_junction.isNull() | (tx_pos < first_junction), "first").otherwise("later")


def parse_locus(locus: Column) -> Column:
    """``chrom:lo-hi:strand`` -> struct of chrom, lo, hi, strand and anchor."""
    pattern = r"^([^:]+):(\d+)-(\d+):([+-])$"
    lo = F.regexp_extract(locus, pattern, 2).try_cast("long")
    hi = F.regexp_extract(locus, pattern, 3).try_cast("long")
    strand = F.regexp_extract(locus, pattern, 4)
    return F.struct(
        F.regexp_extract(locus, pattern, 1).alias("chrom"),
        lo.alias("lo"),
        hi.alias("hi"),
        strand.alias("strand"),
        F.when(strand == "-", hi - 1).otherwise(lo).alias("anchor"),
    )


def three_state(raw: Column) -> Column:
    """Text or 0/1 flag -> nullable boolean; anything else is NULL (see ``bad_flag``)."""
    text = F.lower(F.trim(raw.cast("string")))
    return F.when(text.isin("true", "1", "1.0"), True).when(text.isin("false", "0", "0.0"), False)


def bad_flag(raw: Column) -> Column:
    """True where a flag is neither a boolean, 0/1 nor blank."""
    text = F.lower(F.trim(raw.cast("string")))
    return F.coalesce(~text.isin("true", "1", "1.0", "false", "0", "0.0", "", "nan", "none"), F.lit(False))


def reproducible(rep1: Column, rep2: Column) -> Column:
    """Both replicates support the row; a missing flag counts as not supported."""
    return F.coalesce(rep1, F.lit(False)) & F.coalesce(rep2, F.lit(False))


def tile_start(pos: Column, window: int, step: int) -> Column:
    """Start of the centred tile of ``pos`` (half-to-even snap to ``step``)."""
    snap = F.rint(pos / F.lit(float(step))).cast("long") * step
    return snap - window // 2


def tile_offset(pos: Column, start: Column, strand: Column, window: int) -> Column:
    """Index of ``pos`` in its tile, read 5' to 3'."""
    return F.when(strand == "-", start + (window - 1) - pos).otherwise(pos - start)
