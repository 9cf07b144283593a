"""Model windows over candidates, the positions they ask for, and a user's predictor."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.coords import gpos_from_locus, tile_offset, tile_start


def assign_tiles(candidates: DataFrame, window: int, step: int) -> DataFrame:
    """Tile start and within-tile offset of each candidate; those outside their tile are dropped."""
    a = gpos_from_locus(F.col("gstart"), F.col("strand"))
    start = candidates.withColumn("tile_start", tile_start(a, window, step))
    off = start.withColumn("offset", tile_offset(a, F.col("tile_start"), F.col("strand"), window))
    return off.where((F.col("offset") >= 0) & (F.col("offset") < window))


def position_requests(members: DataFrame, offsets: Sequence[int], window: int) -> DataFrame:
    """Requests ``(row, feature_offset, position, position_index)`` without repeated positions.

    Positions of a tile are distinct and below ``window``, so numbering them is bounded.
    """
    tile = ["chrom", "tile_start", "strand"]
    asked = members.withColumn(
        "feature_offset", F.explode(F.array(*[F.lit(int(o)) for o in offsets]))
    ).withColumn("position", F.col("offset") + F.col("feature_offset"))
    outside = (F.col("position") < 0) | (F.col("position") >= window)
    asked = asked.withColumn("outside", outside)
    w = Window.partitionBy(*tile).orderBy("position")
    numbered = (
        asked.where(~F.col("outside"))
        .select(*tile, "position")
        .distinct()
        .withColumn("position_index", F.row_number().over(w) - 1)
    )
    return asked.join(numbered, [*tile, "position"], "left")


def tile_transcripts(lengths: DataFrame, key: str, length: int, stride: int) -> DataFrame:
    """Overlapping windows of a transcript and the span each owns (nearest centre).

    ``lengths`` has ``key`` and ``length``; the last window ends at the transcript end.
    """
    n = F.col("length")
    steps = F.greatest(F.ceil((n - length) / float(stride)), F.lit(0)).cast("long")
    rows = lengths.select(key, "length", F.explode(F.sequence(F.lit(0).cast("long"), steps)).alias("i"), steps.alias("_s"))
    at = lambda i: F.greatest(F.least(i * stride, F.col("length") - length), F.lit(0).cast("long"))
    start = at(F.col("i"))
    end = F.least(start + length, F.col("length"))
    # Neighbours follow from the index, so no window over the transcript is needed.
    def boundary(i, j):
        a, b = at(i), at(j)
        ea, eb = F.least(a + length, F.col("length")), F.least(b + length, F.col("length"))
        return F.floor((a + ea + b + eb - 2) / 4.0).cast("long") + 1

    lo = F.when(F.col("i") > 0, F.greatest(start, boundary(F.col("i") - 1, F.col("i")))).otherwise(start)
    hi = F.when(F.col("i") < F.col("_s"), F.least(end, boundary(F.col("i"), F.col("i") + 1))).otherwise(end)
    return rows.select(key, start.alias("start"), end.alias("end"), lo.alias("lo"), hi.alias("hi"))


def predict_windows(
    windows: DataFrame, predict: Callable[[Iterator], Iterator], schema: str
) -> DataFrame:
    """Run a user's batch predictor over window rows; Spark decides the batches and tasks."""
    return windows.mapInPandas(predict, schema)
