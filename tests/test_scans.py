"""Ordered helpers against brute force, with hot keys and hot values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.operators import sampling, scans
from tests.conftest import rows_of


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, 400)
    x[:150] = 7  # one value holds more than a third of the rows
    return x


def test_number_rows_with_a_hot_value(frame, values):
    df = frame("x long, i long", *[(int(v), i) for i, v in enumerate(values)])
    got = {r.i: r.ordinal for r in scans.number_rows(df, "x", ["i"]).collect()}
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    assert got == {i: n for n, i in enumerate(order)}


def test_exact_quantiles(frame, values):
    df = frame("k string, x double", *[("a" if i % 3 else "b", float(v)) for i, v in enumerate(values)])
    got = {r.k: r for r in scans.exact_quantiles(df, ["k"], "x", {"lo": 0.025, "mid": 0.5, "hi": 0.9}).collect()}
    for k, keep in (("a", lambda i: i % 3), ("b", lambda i: not i % 3)):
        own = [v for i, v in enumerate(values) if keep(i)]
        assert [got[k].lo, got[k].mid, got[k].hi] == pytest.approx(np.quantile(own, [0.025, 0.5, 0.9]))


def test_rolling_sums_cross_blocks(frame):
    rng = np.random.default_rng(2)
    dense = rng.poisson(0.4, 300)
    df = frame("k string, pos long, v double", *[("a", i, float(v)) for i, v in enumerate(dense) if v])
    out = scans.rolling_sums(df, ["k"], "pos", {"both": ("v", -30, 30), "left": ("v", -9, -1)}, width=64)
    for r in out.collect():
        assert r.both == dense[max(0, r.pos - 30) : r.pos + 31].sum()
        assert r.left == dense[max(0, r.pos - 9) : r.pos].sum()


def test_previous_marked(frame):
    df = frame("k string, pos long, m boolean", *[("a", i, i % 37 == 5) for i in range(0, 200, 3)])
    out = scans.previous_marked(df, ["k"], "pos", F.col("m"), "last", width=16)
    marks = [i for i in range(0, 200, 3) if i % 37 == 5]
    for r in out.collect():
        assert r["last"] == max((m for m in marks if m <= r.pos), default=None)


def test_number_keys_is_a_bijection(frame):
    df = frame("g string", *[(f"t{i % 90}",) for i in range(300)])
    got = [r.ordinal for r in scans.number_keys(df, "g").collect()]
    assert sorted(got) == list(range(90))


def test_cap_keeps_exactly_the_cap(frame):
    df = frame("row_idx long, label int", *[(i, int(i % 10 == 0)) for i in range(500)])
    a = sampling.cap_negatives(df, "row_idx", "label", 60, 1)
    assert a.count() == 110
    assert rows_of(a) == rows_of(sampling.cap_negatives(df.repartition(7), "row_idx", "label", 60, 1))
    assert sampling.cap_negatives(df, "row_idx", "label", 9999, 1).count() == 500


def test_group_split_is_whole(frame):
    import zlib

    df = frame("g string", *[(f"tx{i % 50}",) for i in range(200)])
    got = {r.g: r.a for r in df.select("g", sampling.group_split(F.col("g"), 0.5, 0).alias("a")).collect()}
    assert got == {g: zlib.crc32(f"0:{g}".encode()) % 10000 < 5000 for g in got}


def test_unique_sites_flags_conflicts(frame):
    m = frame(
        "transcript_id string, mrna_index long, row_idx long, label int",
        ("a", 1, 0, 1), ("a", 1, 1, 1), ("b", 2, 2, 0), ("c", 3, 3, 0), ("c", 3, 4, 1),
    )
    u = sampling.unique_sites(m, ["transcript_id", "mrna_index"], "row_idx", ["label"])
    assert rows_of(u, "row_idx", "conflict") == [(0, False), (2, False), (3, True)]


def test_evenly_spaced(frame):
    df = frame("ordinal long", *[(i,) for i in range(11)])
    want = sorted({int(i) for i in np.linspace(0, 10, 4).round()})
    assert [r[0] for r in rows_of(sampling.evenly_spaced(df, 4))] == sorted(want, key=str)
