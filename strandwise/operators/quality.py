"""Assertions as tables: each check returns violation counts from one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.codons import CODON_CLASSES, codon_class, normalize_codon
from strandwise.functions.coords import REGIONS, START_KEY, STRANDS, reproducible
from strandwise.functions.numeric import count_if


class QualityError(ValueError):
    """A table broke a rule it must keep."""


def count_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``(rule, violations)``: rows that break each rule, counted in one scan."""
    counted = df.agg(*[count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    entries = [F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules]
    return counted.select(F.inline(F.array(*entries)))


def repeated_keys(df: DataFrame, keys: Sequence[str], rule: str = "repeated_key") -> DataFrame:
    """One violation row: the number of keys that occur more than once."""
    groups = df.groupBy(*keys).count().where("count > 1")
    return groups.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(rule).alias("rule"), "violations"
    )


def require_clean(violations: DataFrame, what: str) -> None:
    """Raise if any rule was broken. The table has one row per rule."""
    broken = violations.where("violations > 0").orderBy("rule").collect()
    if broken:
        detail = ", ".join(f"{r['rule']}={r['violations']}" for r in broken)
        raise QualityError(f"{what}: {detail}")


def require_columns(df: DataFrame, columns: Sequence[str], what: str) -> None:
    """Raise if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise QualityError(f"{what}: missing columns {missing}")


def truth_violations(truth: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rules of the truth table: nulls, enumerations, codon and flag consistency, unique key."""
    require_columns(truth, required, "truth")
    rules: dict[str, Column] = {}
    for c in required:
        if c not in ("rep1", "rep2", "pause"):
            rules[f"null_{c}"] = F.col(c).isNull()
    rules["unknown_strand"] = ~F.col("strand").isin(*STRANDS)
    rules["negative_gpos"] = F.col("gpos") < 0
    if "tx_pos" in truth.columns:
        rules["negative_tx_pos"] = F.col("tx_pos") < 0
    if "codon" in truth.columns:
        normal = normalize_codon(F.col("codon"))
        rules["codon_not_normalised"] = normal.isNull() | (normal != F.col("codon"))
        rules["class_differs_from_codon"] = codon_class(F.col("codon")) != F.col("codon_class")
    rules["unknown_codon_class"] = ~F.col("codon_class").isin(*CODON_CLASSES)
    rules["unknown_region"] = ~F.col("region").isin(*REGIONS)
    if "split" in truth.columns:
        rules["unknown_split"] = ~F.col("split").isin("train", "val", "test")
    if "reproducible" in truth.columns:
        both = reproducible(F.col("rep1"), F.col("rep2"))
        rules["reproducible_differs"] = F.col("reproducible") != both
    return count_violations(truth, rules).unionByName(
        repeated_keys(truth, START_KEY, "repeated_start")
    )


def candidate_violations(candidates: DataFrame) -> DataFrame:
    """Rules of scored candidates: columns, known enumerations, no missing score."""
    columns = ("condition", "chrom", "strand", "gpos", "transcript_id", "score")
    require_columns(candidates, (*columns, "codon_class", "region"), "candidates")
    return count_violations(
        candidates,
        {
            "unknown_codon_class": ~F.coalesce(F.col("codon_class").isin(*CODON_CLASSES), F.lit(False)),
            "unknown_region": ~F.coalesce(F.col("region").isin(*REGIONS), F.lit(False)),
            "missing_score": F.col("score").isNull() | F.isnan("score"),
        },
    )


def completeness(rows: DataFrame, key: str, wanted: DataFrame | None = None) -> DataFrame:
    """Row numbering facts: rows, distinct, min, max, contiguity and uncovered wanted rows."""
    facts = rows.groupBy(key).count().agg(
        F.sum("count").alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.min(key).alias("first"),
        F.max(key).alias("last"),
    )
    unique = F.col("n_rows") == F.col("n_distinct")
    dense = (F.col("first") == 0) & (F.col("last") == F.col("n_distinct") - 1)
    out = facts.withColumn("is_unique", unique).withColumn("is_contiguous", unique & dense)
    if wanted is None:
        return out
    missing = wanted.select(key).join(rows.select(key), key, "left_anti")
    return out.withColumn("n_uncovered", missing.agg(F.count(F.lit(1))).scalar())


def parity(
    a: DataFrame, b: DataFrame, key: str, column: str, *, rtol: float, atol: float
) -> DataFrame:
    """Agreement of two vector tables by key: matched, missing, width and value differences."""
    left = a.select(key, F.col(column).alias("_a"))
    right = b.select(key, F.col(column).alias("_b"))
    j = left.join(right, key, "full_outer")
    same_width = F.size("_a") == F.size("_b")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    worst = F.array_max(
        F.zip_with("_a", "_b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    )
    beyond = F.exists(
        F.zip_with(
            "_a",
            "_b",
            lambda x, y: F.abs(x.cast("double") - y.cast("double"))
            > atol + rtol * F.abs(y.cast("double")),
        ),
        lambda v: v,
    )
    return j.agg(
        count_if(both).alias("n_matched"),
        count_if(F.col("_b").isNull()).alias("only_a"),
        count_if(F.col("_a").isNull()).alias("only_b"),
        count_if(both & ~same_width).alias("n_width_differs"),
        count_if(both & same_width & beyond).alias("n_value_differs"),
        F.max(F.when(both & same_width, worst)).alias("max_abs_diff"),
    )


def shard_violations(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rules of feature rows: unique ids, one width per column, finite values, no missing key."""
    bad_number = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rules = {"null_id": F.col(key).isNull()}
    for c in columns:
        rules[f"missing_{c}"] = F.col(c).isNull()
        rules[f"not_finite_{c}"] = F.exists(c, bad_number)
    out = count_violations(rows, rules).unionByName(repeated_keys(rows, [key], "repeated_id"))
    for c in columns:
        widths = rows.where(F.col(c).isNotNull()).select(F.size(c).alias("w")).distinct()
        out = out.unionByName(
            widths.agg((F.greatest(F.count(F.lit(1)), F.lit(1)) - 1).alias("violations")).select(
                F.lit(f"width_varies_{c}").alias("rule"), "violations"
            )
        )
    return out


def leakage(
    windows: DataFrame,
    held_out_chroms: DataFrame,
    fit_conditions: DataFrame,
    held_out_conditions: DataFrame,
) -> DataFrame:
    """Counts of rows that would leak held-out data into a fit.

    Window rows on held-out chromosomes, and fit conditions that share a group with a held-out
    condition.
    """
    by_chrom = windows.join(held_out_chroms.select("chrom").distinct(), "chrom", "left_semi")
    by_group = fit_conditions.join(held_out_conditions.select("line").distinct(), "line", "left_semi")

    def one(df: DataFrame, rule: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(rule).alias("rule"), "violations"
        )

    return one(by_chrom, "window_on_held_out_chrom").unionByName(
        one(by_group, "fit_condition_in_held_out_group")
    )
