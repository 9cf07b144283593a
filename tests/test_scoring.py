"""Heads, calibration, projections and the multi-seed evaluation."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.operators import evaluation, multifit, quality, ranking, sampling, scoring
from strandwise.sources import features as store
from tests.conftest import rows_of


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(240, 5)) * [1, 2, 0.5, 3, 1] + [0, 1, 2, 3, 4]
    y = (x @ [1.0, -0.5, 0.3, 0.2, 0] + rng.normal(size=240) > 0.5).astype(int)
    return x, y


@pytest.fixture
def rows(frame, data):
    x, y = data
    split = ["train"] * 120 + ["val"] * 60 + ["test"] * 60
    return frame(
        "row_idx long, features array<float>, label int, split string, transcript_id long",
        *[(i, [float(v) for v in r], int(t), s, i // 4) for i, (r, t, s) in enumerate(zip(x, y, split, strict=True))],
    )


def newton(x, y, c, w=None):
    """L2 logistic on standardised features by Newton steps."""
    mean, std = x.mean(0), x.std(0)
    z = np.c_[(x - mean) / std, np.ones(len(x))]
    w = np.ones(len(x)) if w is None else w
    beta, pen = np.zeros(z.shape[1]), np.r_[np.ones(x.shape[1]), 0]
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        grad = c * z.T @ (w * (p - y)) + pen * beta
        hess = c * (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(pen)
        beta -= np.linalg.solve(hess, grad)
    coef = beta[:-1] / std
    return coef, beta[-1] - mean @ coef


@pytest.mark.parametrize("balanced", [False, True])
def test_fit_head_matches_newton(rows, data, balanced):
    x, y = np.float32(data[0][:120]).astype(float), data[1][:120]
    w = np.where(y == 1, 120 / (2 * y.sum()), 120 / (2 * (120 - y.sum()))) if balanced else None
    coef, intercept = newton(x, y, 0.7, w)
    head = scoring.fit_head(
        rows.where("split = 'train'"), rows.where("split = 'val'"), "features", "label", c=0.7, balanced=balanced
    )
    assert np.allclose(head.coefficients["features"], coef, atol=2e-3)
    assert head.intercept == pytest.approx(intercept, abs=5e-3)
    assert (np.diff(head.isotonic_y) >= 0).all()


HEAD = {"isotonic_x": [0.2, 0.6], "isotonic_y": [0.1, 0.9], "intercept": 0.5}


def test_ensemble(rows, data):
    heads = [scoring.Head({"a": [1.0, 0.0], "b": [0.5, -0.25, 0.1]}, **HEAD), scoring.Head({"a": [0.0, 0.3], "b": [0.0, 0.0, 0.0]}, **HEAD)]
    blocks = {"a": rows.select("row_idx", F.slice("features", 1, 2).alias("v")), "b": rows.select("row_idx", F.slice("features", 3, 3).alias("v"))}
    got = {r.row_idx: r.p for r in scoring.ensemble_scores(blocks, {"a": "v", "b": "v"}, heads, "row_idx").collect()}
    x = np.float32(data[0]).astype(float)
    logit = [x @ [1, 0, 0.5, -0.25, 0.1] + 0.5, x @ [0, 0.3, 0, 0, 0] + 0.5]
    want = np.mean([np.interp(1 / (1 + np.exp(-z)), [0.2, 0.6], [0.1, 0.9]) for z in logit], axis=0)
    assert np.allclose([got[i] for i in range(240)], want)
    with pytest.raises(ValueError, match="blocks differ"):
        scoring.ensemble_scores({"a": blocks["a"]}, {"a": "v"}, heads, "row_idx")


@pytest.mark.parametrize(
    "change",
    [{"isotonic_x": [0.6, 0.2]}, {"isotonic_y": [0.9, 0.1]}, {"intercept": float("nan")}, {"threshold": 1.5}, {"isotonic_x": [0.2]}],
)
def test_head_checks(change):
    with pytest.raises(ValueError):
        scoring.Head({"a": [1.0]}, **{**HEAD, **change})


def test_pca(rows, data):
    pca = scoring.fit_pca(rows, "features", 3)
    x = np.float32(data[0]).astype(float)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    top = vectors[:, ::-1][:, :3].T
    top *= np.sign(top[np.arange(3), np.abs(top).argmax(1)])[:, None]
    assert np.allclose(pca.components, top, atol=1e-6)
    assert np.allclose(pca.explained, values[::-1][:3])
    z = scoring.project(rows, "features", pca)
    back = {r.row_idx: (r.projected, r.restored) for r in scoring.reconstruct(z, "projected", pca).select("row_idx", "projected", "restored").collect()}
    want = (x - x.mean(0)) @ top.T
    assert np.allclose([back[i][0] for i in range(240)], want, atol=1e-6)
    assert np.allclose([back[i][1] for i in range(240)], want @ top + x.mean(0), atol=1e-6)


def test_evaluate_arms(rows):
    out = evaluation.evaluate_arms(rows, {"full": "features"}, seeds=[1, 2], negative_cap=40).collect()
    assert {r.seed for r in out} == {"1", "2", "ensemble"}
    assert all(0.5 < r.auroc <= 1 and r.n == 60 for r in out)


def test_heads_fitted_together_equal_single_fits(rows, data):
    x, y = np.float32(data[0]).astype(float), data[1]
    train = sampling.cap_members(rows, "row_idx", "label", 50, [3, 4])
    train = train.withColumn("some", F.slice("features", 1, 3))
    fits = multifit.fit_heads(train, {"all": "features", "some": "some"}, "members", "label", c=0.3)
    kept = {r.row_idx: r.members for r in train.collect()}
    for k in range(2):
        at = np.array([i for i in range(240) if kept[i][k]])
        for arm, width in (("all", 5), ("some", 3)):
            coef, intercept = newton(x[at][:, :width], y[at], 0.3)
            fit = fits[arm][k]
            assert np.allclose(fit.coefficients, coef, atol=1e-6) and fit.intercept == pytest.approx(intercept, abs=1e-6)
            assert (fit.rows, fit.positives) == (len(at), y[at].sum()) and fit.slope <= 1e-9


def test_heads_refuse_one_class_and_other_widths(frame):
    schema = "x array<float>, label int, m array<boolean>"
    one = frame(schema, ([1.0], 1, [True]), ([2.0], 1, [True]))
    with pytest.raises(ValueError, match="both classes"):
        multifit.fit_heads(one, {"a": "x"}, "m", "label")
    ragged = frame(schema, ([1.0], 1, [True]), ([2.0, 3.0], 0, [True]))
    with pytest.raises(Exception, match="features in every row"):
        multifit.fit_heads(ragged, {"a": "x"}, "m", "label")


@pytest.mark.parametrize("cap", [1, 50, 10_000])
def test_cap_members_are_the_rows_that_a_cap_keeps(rows, cap):
    got = sampling.cap_members(rows, "row_idx", "label", cap, [3, 4]).collect()
    for k, seed in enumerate((3, 4)):
        want = {r.row_idx for r in sampling.cap_negatives(rows, "row_idx", "label", cap, seed).collect()}
        assert {r.row_idx for r in got if r.members[k]} == want


def test_evaluation_run_by_hand(rows, data):
    run = evaluation.evaluation_run(rows, {"full": "features"}, seeds=[1, 2], negative_cap=40, position="row_idx")
    x, y = np.float32(data[0]).astype(float), data[1]
    test = np.arange(180, 240)
    p = []
    for f, h in zip(run.fits["full"], run.heads["full"], strict=True):
        p.append(np.interp(1 / (1 + np.exp(-(x[test] @ f.coefficients + f.intercept))), h.isotonic_x, h.isotonic_y))
    p.append(np.mean(p, axis=0))
    got = {r.seed: r for r in run.metrics.collect()}
    pairs = [(i, j) for i in range(60) for j in range(60) if y[test][i] and not y[test][j] and test[i] // 4 == test[j] // 4 and abs(i - j) <= ranking.NEAR]
    for seed, q in zip(("1", "2", "ensemble"), p, strict=True):
        r = got[seed]
        called = q >= run.thresholds["full", seed]
        assert r.recall == pytest.approx((called & (y[test] == 1)).sum() / y[test].sum())
        assert r.n_pairs == len(pairs) and r.win_rate == pytest.approx(np.mean([q[i] > q[j] for i, j in pairs]))


def test_metric_intervals(frame, rows):
    scored = rows.select(F.lit("x").alias("arm"), (F.col("row_idx") / 240).alias("p"), "label", "transcript_id")
    ci = evaluation.metric_intervals(scored, frame("arm string, threshold double", ("x", 0.5)), replicates=30)
    assert all(r.ci_low <= r.ci_high for r in ci.collect())
    assert ci.count() == 3


def test_gather(frame):
    r = frame("row_idx long, v array<double>", (2, [0.0, 1.0]), (5, [2.0, 3.0]), (7, [9.0, 9.0]), (9, [4.0, 5.0]))
    m = frame("src_row_idx long, row_idx long", (2, 0), (5, 1), (9, 2))
    assert rows_of(scoring.gather_compact(r, m), "row_idx", "v") == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]


def test_feature_store_merges_runs_and_refuses(spark, frame, tmp_path):
    shards = frame("row_idx long, a array<double>, b array<double>", (0, [1.0], [2.0]), (1, [3.0], None))
    store.write_store(shards, ["a"], shards.select("row_idx"), str(tmp_path))
    facts = store.write_store(shards, ["b"], shards.select("row_idx"), str(tmp_path))
    assert rows_of(facts, "key", "covered", "complete", "dim") == [("a", 2, True, 1), ("b", 1, False, 1)]
    got = store.load_rows(spark, str(tmp_path), ["a"], shards.where("row_idx = 1"))
    assert rows_of(got) == [(1, [3.0])]
    with pytest.raises(quality.QualityError, match="cover.*b"):
        store.load_rows(spark, str(tmp_path), ["a", "b"], shards)
    with pytest.raises(quality.QualityError, match="no features.*c"):
        store.load_rows(spark, str(tmp_path), ["a", "c"], shards)
    again = shards.withColumn("b", F.array(F.lit(7.0), F.lit(8.0)))
    assert rows_of(store.write_store(again, ["b"], again, str(tmp_path)), "key", "covered", "dim") == [("a", 2, 1), ("b", 2, 2)]
    ragged = frame("row_idx long, c array<double>", (0, [1.0]), (1, [3.0, 4.0]))
    with pytest.raises(quality.QualityError, match="1 to 2 values"):
        store.write_store(ragged, ["c"], ragged, str(tmp_path))
    with pytest.raises(quality.QualityError, match="repeat"):
        store.write_store(shards.union(shards), ["a"], shards, str(tmp_path / "twice"))


def test_feature_store_opens_wanted_blocks_only(spark, tmp_path):
    shards = spark.range(1000).select(F.col("id").alias("row_idx"), F.array(F.col("id").cast("double")).alias("a"))
    store.write_store(shards, ["a"], shards, str(tmp_path), block_rows=50)
    assert store.manifest(spark, str(tmp_path)).count() == 20
    got = store.load_rows(spark, str(tmp_path), ["a"], shards.where("row_idx IN (3, 40, 777)"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*block#\d+L? IN \((0,15|15,0)\)", plan)
    assert rows_of(got) == [(3, [3.0]), (40, [40.0]), (777, [777.0])]


def test_feature_store_refuses_short_arrays(spark, frame, tmp_path):
    shards = frame("row_idx long, a array<double>", (0, [1.0, 2.0]), (1, [3.0, 4.0]))
    store.write_store(shards, ["a"], shards, str(tmp_path))
    frame("row_idx long, features array<double>", (5, [1.0])).write.mode("append").parquet(str(tmp_path / "features" / "a" / "block=0"))
    with pytest.raises(Exception, match="has not 2 values in row 5"):
        store.load_rows(spark, str(tmp_path), ["a"], frame("row_idx long", (5,))).collect()
