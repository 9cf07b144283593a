"""Interval operators on hand-checked and random spans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.operators import intervals, tracks
from tests.conftest import rows_of

SPAN = "chrom string, start long, end long"


def spans(frame, *pairs, chrom="c"):
    return frame(SPAN, *[(chrom, a, b) for a, b in pairs])


def test_merge_touching(frame):
    got = intervals.merge_spans(spans(frame, (5, 10), (0, 3), (8, 12), (12, 13)), ["chrom"])
    assert rows_of(got, "start", "end") == [(0, 3), (5, 13)]


def test_merge_random_across_blocks(frame):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 60000, 300), rng.integers(1, 400, 300), strict=True)]
    pairs.append((100, 20000))  # reaches over several blocks of starts
    want, last = [], None
    for a, b in sorted(pairs):
        if last and a <= last[1]:
            last[1] = max(last[1], b)
        else:
            last = [a, b]
            want.append(last)
    got = intervals.merge_spans(spans(frame, *pairs), ["chrom"])
    assert rows_of(got, "start", "end") == sorted((tuple(x) for x in want), key=lambda t: tuple(map(str, t)))


@pytest.mark.parametrize(
    ("pairs", "size", "want"),
    [([(0, 10), (250, 260)], 300, [0, 200]), ([(0, 260)], 1000, [0, 50, 100, 150, 200])],
)
def test_tile(frame, pairs, size, want):
    sizes = frame("chrom string, size long", ("c", size))
    got = intervals.tile_spans(spans(frame, *pairs), sizes, 100, 50)
    assert sorted(r.start for r in got.collect()) == want


def test_assign_windows(frame):
    w = spans(frame, (0, 100), (50, 150), (100, 200))
    g = frame(
        "gene string, " + SPAN,
        ("G1", "c", 5, 30), ("G2", "c", 60, 95), ("G3", "c", 110, 140), ("G4", "c", 40, 160), ("G6", "c", 160, 190), ("G7", "c", 900, 910), ("G8", "d", 5, 30),
    )
    got = {r.gene: (r.place, r.window_start) for r in intervals.assign_windows(g, w, ["chrom"], ["gene"]).collect()}
    assert got == {
        "G1": ("inside", 0), "G2": ("inside", 50), "G3": ("inside", 50), "G4": ("excluded", None),
        "G6": ("inside", 100), "G7": ("outside", None), "G8": ("outside", None),
    }


def test_owned_spans_partition_the_windows(frame):
    w = spans(frame, (0, 100), (50, 150), (100, 200), (5000, 5100))
    got = rows_of(intervals.owned_spans(w), "start", "lo", "hi")
    owner = {}
    for start, lo, hi in got:
        for p in range(lo, hi):
            assert p not in owner
            owner[p] = start
    for p in [*range(200), *range(5000, 5100)]:
        inside = [s for s in (0, 50, 100, 5000) if s <= p < s + 100]
        best = min(inside, key=lambda s: (abs(2 * p + 1 - (2 * s + 100)), s))
        assert abs(2 * p + 1 - (2 * owner[p] + 100)) <= abs(2 * p + 1 - (2 * best + 100)) + 1


def test_points_and_span_sums_agree_with_loops(frame):
    rng = np.random.default_rng(5)
    track = {int(p): int(v) for p, v in zip(rng.integers(0, 20000, 800), rng.integers(1, 9, 800), strict=True)}
    pairs = [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 20000, 60), rng.integers(1, 9000, 60), strict=True)]
    pairs += [(3, 19999)] * 40  # many copies of one long span
    t = frame("chrom string, lib string, pos long, value double", *[("c", "x" if p % 2 else "y", p, float(v)) for p, v in track.items()])
    s = frame("i long, " + SPAN, *[(i, "c", a, b) for i, (a, b) in enumerate(pairs)])
    got = intervals.span_sums(t, s, ["chrom"], {"total": "value"}, channels=["lib"])
    found = {(r.i, r.lib): r.total for r in got.collect()}
    for i, (a, b) in enumerate(pairs):
        for lib, odd in (("x", 1), ("y", 0)):
            assert found[(i, lib)] == sum(v for p, v in track.items() if a <= p < b and p % 2 == odd)
    joined = intervals.points_in_spans(t, s, ["chrom"]).groupBy("i").agg(F.sum("value").alias("v"))
    for r in joined.collect():
        a, b = pairs[r.i]
        assert r.v == sum(v for p, v in track.items() if a <= p < b)


def test_span_sums_keep_spans_without_track(frame):
    t = frame("chrom string, pos long, value double", ("c", 5, 2.0))
    s = frame(SPAN, ("c", 0, 5), ("c", 0, 6), ("d", 0, 6))
    got = intervals.span_sums(t, s, ["chrom"], {"total": "value"})
    assert rows_of(got, "chrom", "end", "total") == [("c", 5, 0.0), ("c", 6, 2.0), ("d", 6, 0.0)]


def test_overlaps_meet_once(frame):
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 900, 50), rng.integers(1, 300, 50), strict=True)]
    s = frame("i long, " + SPAN, *[(i, "c", a, b) for i, (a, b) in enumerate(pairs)])
    got = rows_of(intervals.overlaps(s, s, ["chrom"], width=32), "i", "r_i")
    want = [(i, j) for i, (a, b) in enumerate(pairs) for j, (x, y) in enumerate(pairs) if a < y and b > x]
    assert got == sorted(want, key=lambda t: tuple(map(str, t)))


def test_contained_in_region(frame):
    region = spans(frame, (0, 10), (20, 40))
    s = spans(frame, (0, 10), (5, 21), (20, 21), (39, 41))
    assert rows_of(intervals.contained_in_region(s, region, ["chrom"]), "start", "end") == [(0, 10), (20, 21)]


def test_mask(frame):
    genes = frame(
        "condition string, " + SPAN + ", strand string, expressed boolean",
        ("K", "c", 10, 20, "+", False), ("K", "c", 15, 25, "+", True), ("K", "c", 30, 60, "-", False), ("K", "d", 0, 60, "+", False),
    )
    t = frame(
        "condition string, library string, chrom string, strand string, pos long",
        *[("K", lib, "c", s, p) for lib in ("tis", "rna") for s in "+-" for p in range(5, 40)],
    )
    got = rows_of(tracks.mask_unexpressed(t, genes).where("masked"), "library", "strand", "pos")
    want = [("tis", "+", p) for p in range(10, 15)] + [("tis", "-", p) for p in range(30, 40)]
    assert got == sorted(want, key=lambda t: tuple(map(str, t)))


def test_overlap_totals_match_pairs(frame):
    rng = np.random.default_rng(8)

    def some(n):
        at = rng.integers(-5000, 9000, n)
        return [(int(a), int(a + w)) for a, w in zip(at, rng.integers(0, 60, n), strict=True)] + [(7, 9)] * 5

    mine, theirs = some(120), some(200)
    want = []
    for a, b in mine:
        met = [min(b, d) - max(a, c) for c, d in theirs if d > c and b > a and a < d and b > c]
        want += [(a, b, len(met), sum(met))] if met else []
    got = intervals.overlap_totals(spans(frame, *mine), spans(frame, *theirs), ["chrom"])
    assert rows_of(got, "start", "end", "n", "shared") == sorted(want, key=lambda t: tuple(map(str, t)))
