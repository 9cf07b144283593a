"""Codon classes and sequence strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codon classes and the nine codons one substitution away from ATG.
CODON_CLASSES = ("AUG", "AAG", "AGG", "other_near_cognate", "non_cognate")
NEAR_COGNATES = ("AAG", "ACG", "AGG", "ATA", "ATC", "ATT", "CTG", "GTG", "TTG")
STOP_CODONS = ("TAA", "TAG", "TGA")
START_CLASSES = ("atg", "nc")
BASES = "ACGT"
UNKNOWN_BASE = 4


def normalize_codon(codon: Column) -> Column:
    """Trimmed upper-case DNA triplet with U read as T; NULL if it is not three of ACGT."""
    c = F.translate(F.upper(F.trim(codon)), "U", "T")
    return F.when(c.rlike("^[ACGT]{3}$"), c)


def codon_class(codon: Column) -> Column:
    """Five classes of a normalised codon; AAG and AGG are classes of their own."""
    return (
        F.when(codon == "ATG", "AUG")
        .when(codon.isin("AAG", "AGG"), codon)
        .when(codon.isin(*NEAR_COGNATES), "other_near_cognate")
        .when(codon.isNotNull(), "non_cognate")
    )


def candidate_class(codon: Column) -> Column:
    """Three classes of any triplet, case-insensitive; an N makes it non-cognate."""
    c = F.upper(codon)
    return (
        F.when(c == "ATG", "AUG").when(c.isin(*NEAR_COGNATES), "near_cognate")
    ).otherwise("non_cognate")


def start_class(codon: Column) -> Column:
    """``atg`` or ``nc``."""
    return F.when(F.upper(codon) == "ATG", "atg").otherwise("nc")


def reverse_complement(seq: Column) -> Column:
    """Reverse complement; N and case are kept."""
    return F.translate(F.reverse(seq), "ACGTNacgtn", "TGCANtgcan")


def base_code(base: Column) -> Column:
    """A, C, G, T = 0..3, anything else 4."""
    at = F.instr(F.lit(BASES), F.upper(base))
    return F.when((F.length(base) == 1) & (at > 0), at - 1).otherwise(F.lit(UNKNOWN_BASE))


def complement_code(code: Column) -> Column:
    """Complement in code space; the unknown code stays."""
    return F.when(code < UNKNOWN_BASE, 3 - code).otherwise(code)


def base_codes(seq: Column) -> Column:
    """Array of base codes of a short sequence window."""
    return F.transform(F.split(seq, ""), base_code)


def one_hot(seq: Column) -> Column:
    """``4 * length`` array of 0/1; an unknown base is four zeros."""
    return F.flatten(
        F.transform(
            F.split(F.upper(seq), ""),
            lambda b: F.array(*[(b == x).cast("float") for x in BASES]),
        )
    )
