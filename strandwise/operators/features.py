"""Rolling and positional features along a transcript or window.

Inputs are dense vectors in long form: one row per key and position, zeros included, because the
result has one row per position. Positions begin at 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.codons import STOP_CODONS
from strandwise.operators.scans import previous_marked, rolling_sums

# Widths, thresholds and caps of the features.
BOX_WIDTHS = (9, 33, 129, 513)
ONE_SIDED_WIDTHS = (33, 129, 513)
RISE_WIDTH = 129
RISE_THRESHOLD = 1.0
DISTANCE_CAP = 10_000
HEAD = 129
ONSET_WIDTHS = (3, 9, 33)
RATIO_WIDTHS = (15, 45, 150)
RATIO_EPS = 0.01


def centred(width: int) -> tuple[int, int]:
    """Offsets of a centred window of odd width."""
    if width < 1 or width % 2 == 0:
        raise ValueError(f"box width must be odd and positive, got {width}")
    return -(width // 2), width // 2


def box_features(
    dense: DataFrame, keys: Sequence[str], pos: str, value: str, widths: Sequence[int] = BOX_WIDTHS
) -> DataFrame:
    """``log1p`` of the value and of its centred box means."""
    spec = {f"_box{w}": (value, *centred(w)) for w in widths}
    rolled = rolling_sums(dense, keys, pos, spec, first=0)
    out = {f"box{w}": F.log1p(F.col(f"_box{w}") / float(w)) for w in widths}
    return rolled.withColumns({"log1p": F.log1p(value), **out}).drop(*spec)


def onset_features(dense: DataFrame, keys: Sequence[str], pos: str, value: str) -> DataFrame:
    """``log1p(x) - log1p(box mean)`` at three widths."""
    boxed = box_features(dense, keys, pos, value, ONSET_WIDTHS)
    out = {f"onset{w}": F.col("log1p") - F.col(f"box{w}") for w in ONSET_WIDTHS}
    return boxed.withColumns(out).drop("log1p", *[f"box{w}" for w in ONSET_WIDTHS])


def relative_features(
    dense: DataFrame, keys: Sequence[str], pos: str, value: str, length: str
) -> DataFrame:
    """Box means relative to the head mean and the whole mean of the key."""
    boxed = box_features(dense, keys, pos, value, (33, 129))
    means = head_and_mean(dense, keys, pos, value, length)
    out = {}
    for ref in ("head", "mean"):
        for w in (33, 129):
            out[f"box{w}_{ref}"] = F.col(f"box{w}") - F.log1p(f"{ref}")
    return boxed.join(means, list(keys)).withColumns(out).drop(
        "log1p", "box33", "box129", "head", "mean"
    )


def head_and_mean(
    rows: DataFrame, keys: Sequence[str], pos: str, value: str, length: str
) -> DataFrame:
    """Mean of the first 129 positions and of all, per key; works on sparse rows too."""
    n = F.max(length)
    head = F.sum(F.when(F.col(pos) < HEAD, F.col(value)).otherwise(0.0))
    return rows.groupBy(*keys).agg(
        (head / F.least(n, F.lit(HEAD))).alias("head"), (F.sum(value) / n).alias("mean")
    )


def _sides(width: int, reverse: bool) -> tuple[tuple[int, int], tuple[int, int]]:
    if reverse:
        return (-(width - 1), 0), (1, width)
    return (0, width - 1), (-width, -1)


def one_sided_features(
    dense: DataFrame, keys: Sequence[str], pos: str, value: str, *, reverse: bool = False, in_place: bool = False
) -> DataFrame:
    """Downstream minus upstream contrasts and the distance since the last coverage rise.

    ``reverse`` reads the key from its high end (minus strand). ``in_place``: see ``previous_marked``.
    """
    widths = sorted({*ONE_SIDED_WIDTHS, RISE_WIDTH})
    spec = {}
    for w in widths:
        down, up = _sides(w, reverse)
        spec[f"_d{w}"] = (value, *down)
        spec[f"_u{w}"] = (value, *up)
    rolled = rolling_sums(dense, keys, pos, spec, first=0, in_place=in_place)
    contrast = {
        f"contrast{w}": F.log1p(F.col(f"_d{w}") / float(w)) - F.log1p(F.col(f"_u{w}") / float(w))
        for w in widths
    }
    rows = rolled.withColumns(contrast).drop(*spec)
    ordered = rows.withColumn("_p", -F.col(pos) if reverse else F.col(pos))
    marked = previous_marked(
        ordered, keys, "_p", F.col(f"contrast{RISE_WIDTH}") > RISE_THRESHOLD, "_last", in_place=in_place
    )
    gap = F.coalesce(F.col("_p") - F.col("_last"), F.lit(DISTANCE_CAP))
    return marked.withColumn(
        "rise_distance", F.log1p(F.least(gap, F.lit(DISTANCE_CAP)))
    ).drop("_p", "_last")


def log_ratio_features(
    dense: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    widths: Sequence[int] = RATIO_WIDTHS,
    eps: float = RATIO_EPS,
    *,
    reverse: bool = False,
) -> DataFrame:
    """``log((downstream mean + eps) / (upstream mean + eps))`` per width."""
    spec = {}
    for w in widths:
        down, up = _sides(w, reverse)
        spec[f"_d{w}"] = (value, *down)
        spec[f"_u{w}"] = (value, *up)
    rolled = rolling_sums(dense, keys, pos, spec, first=0)
    out = {
        f"ratio{w}": F.log(
            (F.col(f"_d{w}") / float(w) + eps) / (F.col(f"_u{w}") / float(w) + eps)
        )
        for w in widths
    }
    return rolled.withColumns(out).drop(*spec)


def smooth(
    dense: DataFrame, keys: Sequence[str], pos: str, value: str, width: int = 5, floor: float = 1e-3
) -> DataFrame:
    """Centred boxcar mean plus a pseudocount, as column ``smooth``."""
    rolled = rolling_sums(dense, keys, pos, {"_s": (value, *centred(width))})
    return rolled.withColumn("smooth", F.col("_s") / float(width) + floor).drop("_s")


def peak_heights(
    rows: DataFrame, keys: Sequence[str], pos: str, values: Sequence[str], flank: int = 30
) -> DataFrame:
    """Each value over the mean of its +-flank window; absent positions are zeros."""
    spec = {f"_m_{v}": (v, -flank, flank) for v in values}
    rolled = rolling_sums(rows, keys, pos, spec)
    width = float(2 * flank + 1)
    out = {
        f"height_{v}": F.when(F.col(f"_m_{v}") > 0, F.col(v) / (F.col(f"_m_{v}") / width)).otherwise(0.0)
        for v in values
    }
    return rolled.withColumns(out).drop(*spec)


def position_features(pos: Column, length: Column) -> dict[str, Column]:
    """Distance from both ends on a log scale."""
    return {
        "from_start": F.log1p(pos) / 10.0,
        "to_end": F.log1p(F.greatest(length - 1 - pos, F.lit(0))) / 10.0,
    }


def exon_features(pos: Column, junctions: Column, length: Column) -> dict[str, Column]:
    """Exon index, first-exon flag and capped distances to exon ends and junctions."""
    index = F.size(F.filter(junctions, lambda j: j <= pos))
    n = F.size(junctions)
    begin = F.when(index > 0, F.element_at(junctions, F.greatest(index, F.lit(1)))).otherwise(0)
    after = F.when(index < n, F.element_at(junctions, F.least(index + 1, n))).otherwise(length)
    up, down = pos - begin, after - pos
    near = F.least(
        F.when(index > 0, up).otherwise(DISTANCE_CAP), F.when(index < n, down).otherwise(DISTANCE_CAP)
    )
    zero = F.lit(0)
    return {
        "exon_index": F.log1p(index) / 3.0,
        "first_exon": (index == 0).cast("double"),
        "from_exon_start": F.log1p(F.greatest(up, zero)) / 10.0,
        "to_next_exon": F.log1p(F.greatest(down, zero)) / 10.0,
        "to_junction": F.log1p(F.least(near, F.lit(DISTANCE_CAP))) / 10.0,
    }


def stop_starts(codon: Column) -> Column:
    """True where a stop codon starts."""
    return codon.isin(*STOP_CODONS)


def stop_ended(codons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positions whose previous in-frame codon is a stop: stop positions moved by one codon."""
    length = F.col("length")
    return codons.where(stop_starts(F.col("codon")) & (F.col("mrna_index") + 3 < length)).select(
        *keys, (F.col("mrna_index") + 3).alias("mrna_index")
    )


def orf_stops(codons: DataFrame, keys: Sequence[str], is_start: Column) -> DataFrame:
    """Exclusive end of the frame opened at each start: its first stop, else the last codon.

    Only starts and stops are ordered. The next stop is found by blocks read from the 3' end.
    """
    marked = codons.withColumn("_start", is_start).withColumn(
        "_stop", stop_starts(F.col("codon"))
    )
    kept = marked.where(F.col("_start") | F.col("_stop")).withColumn(
        "_frame", F.col("mrna_index") % 3
    )
    kept = kept.withColumn("_p", -F.col("mrna_index"))
    found = previous_marked(kept, [*keys, "_frame"], "_p", F.col("_stop"), "_at")
    left = F.col("length") - F.col("mrna_index")
    whole = F.col("mrna_index") + left - left % 3
    return found.where("_start").select(
        *keys,
        F.col("mrna_index").alias("start"),
        F.coalesce(-F.col("_at") + 3, whole).alias("stop"),
    )
