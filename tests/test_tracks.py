"""Tracks, candidate scores, conventions and draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.operators import alignments, features, resample, tracks
from tests.conftest import rows_of

TRACK = "condition string, chrom string, strand string, pos long, value double"


def test_canonical_moves_only_shifted_libraries(frame):
    t = frame("library string, strand string, pos long", ("tis", "-", 5), ("tis", "+", 5), ("rna", "-", 5))
    assert rows_of(tracks.canonical(t)) == [("rna", "-", 5), ("tis", "+", 5), ("tis", "-", 4)]
    assert rows_of(tracks.file_positions(tracks.canonical(t))) == rows_of(t)


def test_candidate_scores_follow_the_dense_rule(frame):
    rng = np.random.default_rng(7)
    dense = {("+", c): rng.poisson(0.3, 400) for c in "AB"} | {("-", c): rng.poisson(0.3, 400) for c in "AB"}
    t = frame(TRACK, *[(c, "c", s, p, float(v)) for (s, c), x in dense.items() for p, v in enumerate(x) if v])
    cand = [(i, "c", "+-"[i % 2], int(g)) for i, g in enumerate(rng.integers(40, 360, 50))]
    rows = frame("row_idx long, chrom string, strand string, gstart long", *cand)
    got = {(r.row_idx, r.condition): r for r in tracks.candidate_scores(t, rows, "row_idx", 2).collect()}
    assert len(got) == 100
    for i, _, s, g in cand:
        centre = g + 2 if s == "+" else (g - 1) - 2 + 1
        for c in "AB":
            x = dense[(s, c)]
            assert got[(i, c)].peak == x[centre - 1 : centre + 2].sum()
            assert got[(i, c)].context == pytest.approx(x[centre - 30 : centre + 31].sum() / 61)


def test_score_variants(frame):
    s = frame("row_idx long, condition string, peak double, context double", (1, "A", 2.0, 1.0), (1, "B", 3.0, 9.0))
    tot = frame("condition string, total double", ("A", 10.0), ("B", 1000.0))
    r = tracks.score_variants(s, "row_idx", tot, eps_grid=(1.0,), reference="B").first()
    assert (r.peak_max, r.peak_norm_max, r.enrich_max_eps1, r.peak_B, r.enrich_B_eps1) == (3.0, 200000.0, 1.0, 3.0, 0.3)


def convention(frame, minus_shift):
    sites = [("c", s, 50 + 40 * i) for s in "+-" for i in range(25)]
    starts = frame("chrom string, strand string, gpos long", *sites)
    values = [("A", "c", s, g + (minus_shift if s == "-" else 0), 4.0) for _, s, g in sites]
    profile = tracks.offset_profile(frame(TRACK, *values), tracks.placed_sites(starts), 5)
    return tracks.psite_convention(profile, starts)


@pytest.mark.parametrize(("shift", "verdict"), [(0, "ok"), (1, "minus_strand_shift"), (-2, "strands_disagree")])
def test_convention(frame, shift, verdict):
    assert convention(frame, shift).first().verdict == verdict


def test_same_convention(frame):
    assert tracks.same_convention(convention(frame, 0), convention(frame, 0)).first().same
    assert not tracks.same_convention(convention(frame, 0), convention(frame, 1)).first().same


def test_offset_ties_go_to_five_prime(frame):
    p = frame("strand string, offset long, total double", ("+", 3, 2.0), ("+", -1, 2.0), ("+", 0, 1.0))
    assert tracks.estimate_offset(p).first()["offset"] == -1


def test_replicate_fractions(frame):
    t = frame(
        "condition string, library string, rep int, chrom string, strand string, pos long, value double",
        ("K", "tis", 1, "c", "+", 5, 3.0), ("K", "tis", 2, "c", "-", 9, 1.0), ("K", "tis", 2, "c", "+", 50, 9.0),
    )
    region = frame("chrom string, start long, end long", ("c", 0, 10))
    assert rows_of(tracks.replicate_fractions(t, region), "rep", "fraction") == [(1, 0.75), (2, 0.25)]


def test_channel_layout_refuses_repeats():
    with pytest.raises(ValueError, match="libraries"):
        tracks.channel_layout(("K",), ("tis", "tis"))


def walk(start, end, cigar, reverse, length, p):
    """Independent check by listing the read's bases."""
    if not 0 <= p <= length:
        return None
    at, ref = [], start
    for op, n in cigar:
        for _ in range(n):
            if op == 0:
                at.append(ref)
                ref += 1
            elif op == 1:
                at.append(ref)
            else:
                ref += 1
    if p == 0:
        return end if reverse else start
    if p == length:
        return start if reverse else end
    if not reverse:
        return at[p]
    # From the other end: the base after the last one consumed by the read's first p bases.
    return "reverse", length - p, at


def test_placement(frame):
    cigar = [(0, 10), (1, 2), (0, 8), (3, 100), (0, 9)]
    start, length = 1000, 29
    end = start + 10 + 8 + 100 + 9
    rows = [(p, start, end, length, rev, [{"op": o, "len": n} for o, n in cigar]) for p in range(-1, 31) for rev in (False, True)]
    df = frame("p int, start long, end long, read_length long, is_reverse boolean, cigar array<struct<op:int,len:bigint>>", *rows)
    got = {(r.p, r.is_reverse): r.pos for r in df.select("p", "is_reverse", alignments.place_on_genome(F.col("p")).alias("pos")).collect()}
    for p in range(-1, 31):
        want = walk(start, end, cigar, False, length, p)
        assert got[(p, False)] == want
    assert got[(-1, True)] is None and got[(30, True)] is None
    assert (got[(0, True)], got[(29, True)]) == (end, start)
    # 12 bases from the 3' end: 9 in the last exon, 3 before the intron -> 5 bases into the second run.
    assert got[(12, True)] == start + 10 + 5
    assert got[(9, True)] == start + 18


def test_filters_and_mismatch(frame):
    df = frame(
        "i int, mapq int, nh int, is_unmapped boolean, is_secondary boolean, md string, is_reverse boolean",
        (1, 1, None, False, False, "0A20", False), (2, 0, 1, False, False, "20", False), (3, 9, 6, False, False, "10A0", True),
        (4, 9, 5, False, False, "10", True), (5, 9, 1, True, False, "0A1", False), (6, 9, 1, False, True, "0A1", False),
    )
    got = df.select("i", alignments.passes_filters().alias("ok"), alignments.five_prime_mismatch().alias("m0"))
    assert rows_of(got) == [(1, True, True), (2, False, False), (3, False, True), (4, True, False), (5, False, True), (6, False, True)]


def test_call_overlap(frame):
    a, b = frame("k string", ("a",), ("b",)), frame("k string", ("a",), ("c",))
    r = alignments.call_overlap(a, b, ["k"]).first()
    assert (r.shared, r.only_a, r.only_b, r.jaccard) == (1, 1, 1, 1 / 3)
    empty = a.where("false")
    assert alignments.call_overlap(empty, empty, ["k"]).first().jaccard == 1.0


def test_draws_ignore_partitions(frame):
    rows = [("K", "tis", 1 + p % 2, "c", "+-"[p % 2], p, p % 5 * 0.9) for p in range(400)]
    df = frame("condition string, library string, rep int, chrom string, strand string, pos long, value double", *rows)
    a, b = resample.draw_counts(df.repartition(1), 3), resample.draw_counts(df.repartition(6), 3)
    assert rows_of(a) == rows_of(b)
    assert a.agg(F.sum("value")).first()[0] == pytest.approx(sum(r[-1] for r in rows), rel=0.15)
    twice = resample.draw_counts(df, 3, copies=2)
    assert twice.where("value % 2 <> 0").count() == 0


def test_draw_to_depth_keeps_totals_and_shape(frame):
    rows = [("K", t, p, float(1 + (p == 7) * 20)) for t in (1, 2) for p in range(0, 40)]
    df = frame("condition string, tx long, tx_pos long, value double", *rows)
    depth = frame("condition string, tx long, reads double", ("K", 1, 3000.0), ("K", 2, 10.9))
    got = resample.draw_to_depth(df, depth, 9)
    totals = {r.tx: r.t for r in got.groupBy("tx").agg(F.sum("value").alias("t")).collect()}
    assert totals == {1: 3000.0, 2: 11.0}
    assert got.where("tx = 1 AND tx_pos = 7").first().value == pytest.approx(3000 * 21 / 60, rel=0.1)


def test_expected_counts_round_half_to_even(frame):
    p = frame("condition string, library string, pos long, value double", ("K", "tis", 1, 5.0), ("K", "tis", 2, 3.0))
    f = frame("condition string, library string, rep int, fraction double", ("K", "tis", 1, 0.5))
    assert rows_of(resample.expected_counts(p, f), "pos", "expected") == [(1, 2.0), (2, 2.0)]


def dense_frame(frame, x):
    return frame("k string, pos long, v double", *[("a", i, float(v)) for i, v in enumerate(x)])


def test_one_sided_features_mirror(frame):
    rng = np.random.default_rng(8)
    x = rng.poisson(0.5, 700) + 3 * (np.arange(700) > 300)
    fwd = features.one_sided_features(dense_frame(frame, x), ["k"], "pos", "v")
    rev = features.one_sided_features(dense_frame(frame, x[::-1]), ["k"], "pos", "v", reverse=True)
    a = {r.pos: r for r in fwd.collect()}
    b = {699 - r.pos: r for r in rev.collect()}
    for i in (0, 10, 299, 301, 450, 699):
        for c in ("contrast33", "contrast129", "contrast513", "rise_distance"):
            assert a[i][c] == pytest.approx(b[i][c])
        pad = np.concatenate([np.zeros(513), x, np.zeros(513)])
        j = i + 513
        for w in (33, 129, 513):
            want = np.log1p(pad[j : j + w].mean()) - np.log1p(pad[j - w : j].mean())
            assert a[i][f"contrast{w}"] == pytest.approx(want)


def test_box_and_heights(frame):
    rng = np.random.default_rng(9)
    x = rng.poisson(1.0, 200)
    pad = np.concatenate([np.zeros(300), x, np.zeros(300)])
    box = {r.pos: r for r in features.box_features(dense_frame(frame, x), ["k"], "pos", "v").collect()}
    high = {r.pos: r for r in features.peak_heights(dense_frame(frame, x).where("v > 0"), ["k"], "pos", ["v"]).collect()}
    for i in range(0, 200, 7):
        for w in (9, 33, 129, 513):
            assert box[i][f"box{w}"] == pytest.approx(np.log1p(pad[300 + i - w // 2 : 301 + i + w // 2].mean()))
        if x[i]:
            assert high[i].height_v == pytest.approx(x[i] / (pad[270 + i : 331 + i].mean()))
    with pytest.raises(ValueError, match="odd"):
        features.centred(4)


def test_one_sided_features_in_place_move_nothing(frame):
    """Keys that are dealt already: the same features as by blocks, without a further exchange."""
    x = np.random.default_rng(4).poisson(0.4, 5000)
    held = dense_frame(frame, x).repartition(4, "k")
    by_blocks = features.one_sided_features(held, ["k"], "pos", "v")
    out = features.one_sided_features(held, ["k"], "pos", "v", in_place=True)
    assert out.columns == by_blocks.columns and out.exceptAll(by_blocks).count() == 0 == by_blocks.exceptAll(out).count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort ") == 1
