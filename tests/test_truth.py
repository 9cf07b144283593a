"""Truth tables, tagging and differential usage on hand-checked cases."""

import pytest
from pyspark.sql import functions as F

from strandwise.operators import quality, truth
from strandwise.operators.quality import QualityError
from strandwise.sources.tables import load_annotation
from tests.conftest import rows_of

RAW = (
    "condition string, transcript_id string, gene string, chrom string, strand string, locus long, "
    "codon string, rep1 string, rep2 string, imputed string"
)


@pytest.fixture
def annotation(frame):
    raw = frame(
        "Tid string, chrom string, strand string, es string, ee string, cds_start long, cds_end long",
        ("TP", "chr7", "+", "100,200,", "110,220,", 105, 215),
        ("TM", "chr1", "-", "100,200", "110,220", 105, 215),
    )
    return load_annotation(
        raw,
        {
            "Tid": "transcript_id", "chrom": "chrom", "strand": "strand", "es": "exon_starts",
            "ee": "exon_ends", "cds_start": "cds_start", "cds_end": "cds_end",
        },
        ["transcript_id", "chrom"],
    )


def raw_rows():
    return [
        ("K_1", "TP", "g", "chr7", "+", 105, "aug", "1", "true", None),
        ("K_1", "TM", "g", "chr1", "-", 215, "ATG", "true", "1", "false"),
        ("K_1", "TM", "g", "chr1", "-", 220, "CTG", None, None, ""),
        ("RPE1_Que", "TM", "g", "chr1", "-", 101 + 119, "CTG", "0", "1", "true"),
        ("RPE1_Que", "TP", "g", "chr7", "+", 101, "AGG", "1", "1", None),
        ("RPE1_Que", "TP", "g", "chr7", "+", 201, "AAG", "1", "0", None),
    ]


def test_load_truth(frame, annotation):
    t = truth.load_truth(frame(RAW, *raw_rows()), annotation)
    got = rows_of(t, "gpos", "tx_pos", "codon_class", "region", "reproducible", "split", "line")
    assert got == [
        (101, 1, "AGG", "utr5", True, "val", "RPE1"),
        (105, 5, "AUG", "annotated", True, "val", "K_1"),
        (201, 11, "AAG", "cds_inframe", False, "val", "RPE1"),
        (214, 5, "AUG", "annotated", True, "train", "K_1"),
        (219, 0, "other_near_cognate", "utr5", False, "train", "K_1"),
    ]
    quality.require_clean(
        quality.truth_violations(t, ("condition", "chrom", "gpos", "codon", "split")), "truth"
    )


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"codon": "AXG"}, "bad_codon"),
        ({"rep1": "maybe"}, "bad_rep1"),
        ({"transcript_id": "NONE"}, "unknown_transcript"),
        ({"strand": "-"}, "chrom_or_strand_differs"),
        ({"locus": 150}, "not_exonic"),
    ],
)
def test_load_truth_refuses(frame, annotation, change, message):
    row = dict(zip([c.split()[0] for c in RAW.split(", ")], raw_rows()[0], strict=True))
    row.update(change)
    with pytest.raises(QualityError, match=message):
        truth.load_truth(frame(RAW, tuple(row.values())), annotation)


def test_truth_violations_counts_repeats(frame, annotation):
    t = truth.load_truth(frame(RAW, *raw_rows()), annotation)
    v = quality.truth_violations(t.unionByName(t.limit(1)), ("condition", "gpos"))
    assert v.where("rule = 'repeated_start'").first()["violations"] == 1


@pytest.fixture
def shares(frame):
    a = [[0.6, 0.5, 0.5, 0.2, 0.3], [0.7, 0.2, 0.55, 0.3, None]]
    b = [[0.3, 0.3, 0.5, 0.5, 0.1], [0.4, 0.4, 0.5, 0.5, 0.1]]
    rows = [
        (c, rep + 1, "chr1", "+", site + 1, values[rep][site])
        for c, values in (("A", a), ("B", b))
        for rep in (0, 1)
        for site in range(5)
    ]
    return frame(
        "condition string, rep int, chrom string, strand string, gpos long, share double", *rows
    )


def test_differential(shares):
    d = truth.differential_starts(shares, ["A", "B"])
    got = rows_of(d.withColumn("delta", F.round("delta", 6)), "gpos", "delta", "direction")
    assert got == [(1, 0.3, 1), (4, -0.25, -1)]
    assert rows_of(truth.differential_starts(shares, ["A", "B"], 0.25), "gpos") == [(1,)]
    counts = truth.count_differential(shares, ["A", "B"]).first()
    assert tuple(counts)[2:] == (4, 1, 1, 2)


def test_usage_shares_of_an_empty_group_are_null(frame):
    c = frame("condition string, rep int, gene string, count long", ("A", 1, "g", 0), ("A", 1, "h", 3), ("A", 1, "h", 1))
    assert rows_of(truth.usage_shares(c), "gene", "share") == [("g", None), ("h", 0.25), ("h", 0.75)]


def test_condition_pairs(frame):
    p = truth.condition_pairs(frame("condition string", ("b",), ("a",), ("c",), ("a",)))
    assert rows_of(p) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_count_cube_has_zeros(frame):
    t = frame("condition string, codon_class string, region string, reproducible boolean", ("A", "AUG", "utr5", True))
    cube = truth.count_cube(t)
    assert cube.count() == 50
    assert cube.agg(F.sum("n")).first()[0] == 1


def test_share_violations(shares):
    assert truth.share_violations(shares).first()["violations"] == 0
    assert truth.share_violations(shares.unionByName(shares.where("gpos = 1"))).first()["violations"] == 4
