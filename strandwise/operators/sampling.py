"""Deterministic selection: caps, splits, shards, unique sites and stores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.arrays import stable_hash
from strandwise.functions.numeric import count_if
from strandwise.operators.scans import bucket_count, number_rows

SPLIT_MODULUS = 10_000


def evenly_spaced(numbered: DataFrame, k: int, ordinal: str = "ordinal") -> DataFrame:
    """Rows at ``k`` evenly spaced positions of a 0-based numbering (half-to-even rounding)."""
    n = numbered.agg(F.max(ordinal)).scalar()
    grid = numbered.sparkSession.range(k).select(
        F.rint(F.col("id") * (n / F.lit(float(max(k - 1, 1))))).cast("long").alias(ordinal)
    )
    few = numbered.join(grid.distinct(), ordinal, "left_semi")
    return few


def group_split(group: Column, fraction: float, seed: int) -> Column:
    """True for groups in the first part; a whole group falls on one side."""
    if not 0.0 < fraction < 1.0:
        raise ValueError("fraction must be strictly between zero and one")
    code = F.crc32(F.concat_ws(":", F.lit(str(seed)), group.cast("string")))
    return code % SPLIT_MODULUS < round(fraction * SPLIT_MODULUS)


def group_shard(group: Column, shards: int) -> Column:
    """Shard number of a whole group."""
    if shards <= 0:
        raise ValueError("shards must be positive")
    return F.crc32(group.cast("string")) % shards


def cap_by_hash(rows: DataFrame, row_id: str, cap: int, seed: int) -> DataFrame:
    """The ``cap`` rows with the smallest seeded hash of their id; all rows if there are fewer.

    The cut value is found from exact counts per hash prefix, so nothing is sorted as a whole and
    exactly ``cap`` rows are kept.
    """
    if cap <= 0:
        raise ValueError("cap must be positive")
    hashed = rows.withColumn("_h", stable_hash(F.lit(seed), F.col(row_id)))
    # Ties on the hash are broken by the id through the number of each row.
    buckets = bucket_count(rows)
    edges = [float((1 << 32) * i // buckets) for i in range(1, buckets)]
    numbered = number_rows(hashed, "_h", [row_id], name="_o", edges=edges)
    return numbered.where(F.col("_o") < cap).drop("_h", "_o")


def cap_negatives(rows: DataFrame, row_id: str, label: str, cap: int, seed: int) -> DataFrame:
    """Every positive and a reproducible sample of at most ``cap`` negatives."""
    y = F.col(label).cast("boolean")
    return rows.where(y).unionByName(cap_by_hash(rows.where(~y), row_id, cap, seed))


def cap_members(rows: DataFrame, row_id: str, label: str, cap: int, seeds: Sequence[int], name: str = "members") -> DataFrame:
    """Add ``name``: for each seed, whether ``cap_negatives`` with that seed keeps the row. Row ids are unique.

    Hash prefixes are counted for all seeds in one pass; only the prefix that holds a seed's last negative is sorted,
    1 row in 65,536.
    """
    if cap <= 0:
        raise ValueError("cap must be positive")
    y = F.col(label).cast("boolean")
    hashes = [stable_hash(F.lit(s), F.col(row_id)) for s in seeds]
    each = rows.where(~y).select(F.col(row_id).alias("id"), F.posexplode(F.array(*hashes)).alias("s", "h")).withColumn("prefix", F.shiftright("h", 16))
    counted = each.groupBy("s", "prefix").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("s").orderBy("prefix"))
    ends = counted.withColumn("upto", upto).where((F.col("upto") >= cap) & (F.col("upto") - F.col("n") < cap)).collect()
    cuts = {}
    if ends:
        last = F.lit(False)
        wanted = F.lit(0)
        for r in ends:  # one row per seed
            here = (F.col("s") == r["s"]) & (F.col("prefix") == r["prefix"])
            last = last | here
            wanted = F.when(here, cap - (r["upto"] - r["n"])).otherwise(wanted)
        place = F.row_number().over(Window.partitionBy("s").orderBy("h", "id"))
        cuts = {r["s"]: r for r in each.where(last).withColumn("o", place).where(F.col("o") == wanted).collect()}
    kept = []
    for i, h in enumerate(hashes):
        if i in cuts:
            cut = cuts[i]
            kept.append(y | (h < cut["h"]) | ((h == cut["h"]) & (F.col(row_id) <= F.lit(cut["id"]))))
        else:
            kept.append(y.isNotNull())
    return rows.withColumn(name, F.array(*[F.coalesce(k, F.lit(False)) for k in kept]))


def both_classes(rows: DataFrame, label: str) -> DataFrame:
    """Counts per class, with a flag that both occur."""
    y = F.col(label).cast("boolean")
    return rows.agg(count_if(y).alias("positives"), count_if(~y).alias("negatives")).withColumn(
        "has_both", (F.col("positives") > 0) & (F.col("negatives") > 0)
    )


def unique_sites(
    manifest: DataFrame, keys: Sequence[str], row_id: str, invariant: Sequence[str]
) -> DataFrame:
    """First row (by ``row_id``) per site and whether its repeats disagree on ``invariant``."""
    rest = [c for c in manifest.columns if c not in keys]
    differs = F.lit(False)
    for c in invariant:
        differs = differs | ~F.min(c).eqNullSafe(F.max(c))
    picked = manifest.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.col(row_id)).alias("_row"),
        F.count(F.lit(1)).alias("n_rows"),
        differs.alias("conflict"),
    )
    return picked.select(*keys, "_row.*", "n_rows", "conflict")


def store_selection(
    rows: DataFrame, row_id: str, label: str, negative_cap: int, other_cap: int | None = None, seed: int = 0
) -> DataFrame:
    """Rows of a feature store, renumbered 0..N-1 in the order of ``row_id``.

    Cognate rows: train positives, capped train negatives, all of val and test. Non-cognate rows:
    all of test, or a sample of ``other_cap``. ``rows`` has ``split`` and ``codon_class``.
    """
    cognate = F.col("codon_class") != "non_cognate"
    y = F.col(label).cast("boolean")
    train, test = F.col("split") == "train", F.col("split") == "test"
    parts = [
        rows.where(cognate & (~train | y)),
        cap_by_hash(rows.where(cognate & train & ~y), row_id, negative_cap, seed),
        rows.where(~cognate & test) if other_cap is None else cap_by_hash(rows.where(~cognate & test), row_id, other_cap, seed),
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return number_rows(union.withColumnRenamed(row_id, "src_row_idx"), "src_row_idx", name="row_idx")


def test_rows_of(rows: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Test rows of the requested codon classes; an unknown class is an error."""
    unknown = set(classes) - {"AUG", "near_cognate", "non_cognate"}
    if unknown:
        raise ValueError(f"unknown codon classes {sorted(unknown)}")
    return rows.where((F.col("split") == "test") & F.col("codon_class").isin(*classes))
