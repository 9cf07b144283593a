"""Ranking metrics, calibration and the bootstrap against brute force in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.operators import bootstrap, ranking
from tests.conftest import rows_of


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(3)
    n = 600
    score = np.round(rng.random(n), 2)
    label = (rng.random(n) < 0.15 + 0.3 * score).astype(int)
    return score, label, rng.integers(0, 40, n)


@pytest.fixture
def rows(frame, world):
    score, label, group = world
    data = [(float(s), int(y), int(g), i) for i, (s, y, g) in enumerate(zip(*world, strict=True))]
    return frame("score double, label int, transcript_id long, mrna_index long", *data)


def brute_budget(score, label, group, budget):
    best = (0.0, float("inf"), 0.0)
    n = len(set(group.tolist()))
    top = -1
    for t in sorted(set(score.tolist()), reverse=True):
        called = score >= t
        tp, fp = int((called & (label == 1)).sum()), int((called & (label == 0)).sum())
        if fp / n <= budget and tp > top:
            top, best = tp, (tp / label.sum(), t, fp / n)
    return best


def curve(rows, **kw):
    return ranking.rank_curve(ranking.score_counts(rows, "score", "label"), **kw)


@pytest.mark.parametrize("budget", [0.0, 0.5, 3.0, 100.0])
def test_recall_at_budget(rows, world, budget):
    got = ranking.recall_at_budget(curve(rows), ranking.group_counts(rows, "transcript_id"), budget).first()
    assert (got.recall, got.threshold, got.fp_per_group) == pytest.approx(brute_budget(*world, budget))


def test_budget_without_positives(rows):
    none = rows.withColumn("label", F.lit(0))
    got = ranking.recall_at_budget(curve(none), ranking.group_counts(none, "transcript_id"), 1.0).first()
    assert (got.recall, got.threshold) == (0.0, float("inf"))
    assert ranking.area_metrics(curve(none)).first().auroc is None


def test_areas(rows, world):
    score, label, _ = world
    pos, neg = score[label == 1], score[label == 0]
    wins = (pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()
    ap, tp_before = 0.0, 0
    for t in sorted(set(score.tolist()), reverse=True):
        tp, n = ((score >= t) & (label == 1)).sum(), (score >= t).sum()
        ap += (tp - tp_before) / label.sum() * tp / n
        tp_before = tp
    got = ranking.area_metrics(curve(rows)).first()
    assert got.auprc == pytest.approx(ap)
    assert got.auroc == pytest.approx(wins / len(pos) / len(neg))


def test_curve_does_not_depend_on_edges(rows):
    want = rows_of(curve(rows, edges=[]))
    assert rows_of(curve(rows, edges=[0.2, 0.21, 0.9])) == want
    assert rows_of(curve(rows.repartition(7))) == want


def test_reliability_edges(frame):
    p = [(0.05, 0), (0.1, 0), (0.3, 1), (0.6, 1), (0.7, 0), (1.0, 1)]
    b = ranking.reliability(frame("p double, y int", *p), "p", "y")
    edges = np.linspace(0, 1, 11)[1:-1]
    want = {}
    for v, _ in p:
        want[int(np.digitize(v, edges))] = want.get(int(np.digitize(v, edges)), 0) + 1
    assert {r["bin"]: r["n"] for r in b.collect() if r["n"]} == want
    s = ranking.calibration_summary(b).first()
    assert s.brier == pytest.approx(np.mean([(a - y) ** 2 for a, y in p]))


def test_near_pairs(frame):
    s = frame(
        "row long, transcript_id string, mrna_index long, label int, score double",
        (0, "a", 10, 1, 0.9), (1, "a", 40, 0, 0.1), (2, "a", 210, 0, 0.2), (3, "b", 100, 1, 0.3), (4, "b", 150, 0, 0.3), (5, "b", 164, 0, 0.1), (6, "b", 165, 0, 0.1),
    )
    pairs = ranking.near_pairs(s, ["row", "score"])
    assert rows_of(pairs, "pos_row", "neg_row") == [(0, 1), (3, 4), (3, 5)]
    assert ranking.win_rate(pairs).first().n_wins == 2


def test_bootstrap_against_numpy(rows, world):
    score, label, group = world
    w = bootstrap.draw_weights(rows, "transcript_id", 8, 5)
    got_w = {(r.b, r.transcript_id): r.weight for r in w.collect()}
    for b in range(8):
        assert sum(v for (bb, _), v in got_w.items() if bb == b) == len(set(group.tolist()))
    stats = bootstrap.group_counts_at(rows, "score", "label", "transcript_id", 0.7)
    reps = {r.b: r for r in bootstrap.additive_replicates(stats, w, "transcript_id").collect()}
    ranks = {r.b: r for r in bootstrap.rank_replicates(rows, "score", "label", "transcript_id", w).collect()}
    for b in range(8):
        weight = np.array([got_w.get((b, int(g)), 0) for g in group])
        s, y = np.repeat(score, weight), np.repeat(label, weight)
        assert reps[b].recall == pytest.approx(((s >= 0.7) & (y == 1)).sum() / y.sum())
        pos, neg = s[y == 1], s[y == 0]
        wins = (pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()
        assert ranks[b].auroc == pytest.approx(wins / len(pos) / len(neg))
    ci = {r.metric: r for r in bootstrap.intervals(bootstrap.additive_replicates(stats, w, "transcript_id"), ["recall"]).collect()}
    values = [reps[b].recall for b in range(8)]
    assert ci["recall"].ci_low == pytest.approx(np.quantile(values, 0.025))
    assert ci["recall"].ci_high == pytest.approx(np.quantile(values, 0.975))


def test_variant_ties_follow_the_list(frame):
    t = frame("variant string, recall double, auprc double, threshold double", ("x", 0.5, 0.3, 1.0), ("y", 0.5, 0.3, 2.0), ("z", 0.4, 0.9, 3.0))
    assert ranking.select_variant(t, ("y", "x", "z")).first().variant == "y"


def test_draws_do_not_move_with_each_row(frame, monkeypatch):
    """Rows meet their group's draws and are summed by score before they move on; both forms of draws agree."""
    rng, written = np.random.default_rng(3), []
    rows = [(arm, g, float(s) / 20, int(rng.random() < 0.4)) for arm in "xy" for g in range(30) for s in rng.integers(0, 20, 20)]
    df = frame("arm string, g long, score double, label int", *rows, ("x", 1, None, 1), ("x", None, 0.5, 1))

    def durable(table, name):
        written.append(kept := keep(table, name))
        return kept

    keep = bootstrap.durable
    monkeypatch.setattr(bootstrap, "durable", durable)
    groups = df.where("g IS NOT NULL")
    w = bootstrap.draw_weights(groups, "g", 64, 7)
    drawn = {(r.b, r.g): r.weight for r in w.collect()}
    got = {(r.arm, r.b): (r.auprc, r.auroc) for r in bootstrap.rank_replicates(df, "score", "label", "g", bootstrap.draw_vectors(groups, "g", 64, 7), ["arm"]).collect()}
    moved = 0
    for t in written:
        lists = [c for c, kind in t.dtypes if kind.startswith("array")]
        moved += sum(len(r[c]) for r in t.select(*lists).collect() for c in lists)
    assert moved < len(rows) * 64 / 2
    again = bootstrap.rank_replicates(df, "score", "label", "g", w.where("b > 1"), ["arm"])
    assert {(r.arm, r.b): (r.auprc, r.auroc) for r in again.collect()} == {k: v for k, v in got.items() if k[1] > 1}
    assert len(got) == 128
    for (arm, b), (auprc, auroc) in got.items():
        of = [(s, y, drawn.get((b, g), 0)) for a, g, s, y in rows if a == arm]
        p, q = (sum(k for _, y, k in of if y == v) for v in (1, 0))
        above = lambda s, v: sum(k for t, y, k in of if y == v and t >= s)
        assert auprc == pytest.approx(sum(k * above(s, 1) / (above(s, 1) + above(s, 0)) for s, y, k in of if y and k) / p)
        assert auroc == pytest.approx(sum(k * (above(s, 1) - sum(j for t, z, j in of if z and t == s) / 2) for s, y, k in of if not y) / p / q)
