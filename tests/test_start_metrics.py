"""Top-k calls, stratified precision and recall, direction accuracy."""

import pytest

from strandwise.operators import quality, start_metrics
from tests.conftest import rows_of


@pytest.fixture
def candidates(frame):
    rows = []
    for condition, t1, t2 in (("K562", (0.9, 0.8, 0.5), (0.4, 0.7)), ("HeLa", (0.2, 0.6, 0.1), (0.3, 0.2))):
        for g, s in zip((10, 20, 30), t1, strict=True):
            rows.append((condition, "T1", "chr1", "+", g, "AUG" if g == 10 else "AAG", "utr5", s))
        for g, s in zip((100, 110), t2, strict=True):
            rows.append((condition, "T2", "chr1", "-", g, "non_cognate", "cds_inframe", s))
    return frame(
        "condition string, transcript_id string, chrom string, strand string, gpos long, "
        "codon_class string, region string, score double",
        *rows,
    )


@pytest.fixture
def known(frame):
    return frame(
        "condition string, chrom string, strand string, gpos long, codon_class string, region string, reproducible boolean",
        ("K562", "chr1", "+", 10, "AUG", "utr5", True),
        ("K562", "chr1", "+", 30, "AAG", "utr5", True),
        ("K562", "chr1", "-", 100, "non_cognate", "cds_inframe", True),
        ("K562", "chr1", "-", 110, "non_cognate", "cds_inframe", False),
        ("K562", "chr1", "+", 500, "AUG", "utr5", True),
        ("OTHER", "chr1", "+", 10, "AUG", "utr5", True),
    )


def test_top_k(candidates):
    top = start_metrics.top_k_calls(candidates.where("condition = 'K562'"), 1)
    assert rows_of(top, "gpos") == [(10,), (110,)]
    with pytest.raises(ValueError, match="k must"):
        start_metrics.top_k_calls(candidates, 0)


def test_ties_go_to_the_lower_position(frame):
    c = frame(
        "condition string, transcript_id string, chrom string, strand string, gpos long, score double",
        ("A", "T", "c", "+", 9, 0.5), ("A", "T", "c", "+", 3, 0.5), ("A", "U", "c", "+", 3, 0.7),
    )
    assert rows_of(start_metrics.top_k_calls(c, 1), "gpos", "transcript_id") == [(3, "U")]


def test_precision_and_recall(candidates, known):
    m = start_metrics.start_metrics(candidates, known, (1,))
    k = m.where("condition = 'K562' AND stratum = 'all'").first()
    assert (k.n_calls, k.n_tp, k.precision) == (2, 1, 0.5)
    assert (k.n_truth, k.n_recalled, k.n_truth_unscored) == (3, 1, 1)
    assert m.count() == 3 * len(start_metrics.STRATA)
    empty = m.where("condition = 'HeLa' AND stratum = 'all'").first()
    assert empty.recall is None
    assert empty.precision == 0.0


def test_result_does_not_depend_on_partitions(candidates, known):
    a = start_metrics.start_metrics(candidates.repartition(1), known, (1, 2))
    b = start_metrics.start_metrics(candidates.repartition(7), known.repartition(3), (1, 2))
    assert rows_of(a) == rows_of(b)


def test_direction(frame):
    d = frame(
        "condition_a string, condition_b string, chrom string, strand string, gpos long, direction int",
        ("A", "B", "c", "+", 1, 1), ("A", "B", "c", "+", 2, -1), ("A", "B", "c", "+", 3, 1), ("A", "C", "c", "+", 4, 1),
    )
    p = frame(
        "condition string, chrom string, strand string, gpos long, score double",
        ("A", "c", "+", 1, 0.9), ("B", "c", "+", 1, 0.1), ("A", "c", "+", 2, 0.5), ("B", "c", "+", 2, 0.5), ("A", "c", "+", 3, 0.5),
    )
    got = rows_of(start_metrics.direction_accuracy(d, p))
    assert got == [("A", "B", 2, 3, 1, 0.5), ("A", "C", 0, 1, 0, None), ("all", "all", 2, 4, 1, 0.5)]


def test_candidate_violations(candidates):
    assert {r["violations"] for r in quality.candidate_violations(candidates).collect()} == {0}
    odd = candidates.withColumn("region", candidates.strand)
    assert quality.candidate_violations(odd).where("rule = 'unknown_region'").first()["violations"] == 10


def test_candidates_are_ranked_once_for_all_k(spark):
    c = spark.createDataFrame(
        [("a", i // 4, "chr1", "+", i % 9, "AUG", "utr5", float(i % 7)) for i in range(40)],
        "condition string, transcript_id long, chrom string, strand string, gpos long, codon_class string, region string, score double",
    )
    t = c.select("condition", "chrom", "strand", "gpos", "codon_class", "region").distinct().selectExpr("*", "true AS reproducible")
    out = start_metrics.start_metrics(c, t, (1, 2, 3))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [row_number") == 1
    got = {r.k: (r.n_calls, r.n_tp, r.n_truth, r.n_recalled) for r in out.where("condition = 'a' AND stratum = 'all'").collect()}
    for k in (1, 2, 3):
        best = {}
        for i in range(40):
            best.setdefault(i // 4, []).append((-float(i % 7), i % 9))
        called = {p for own in best.values() for _, p in sorted(own)[:k]}
        assert got[k] == (len(called), len(called), 9, len(called))
