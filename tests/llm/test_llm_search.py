"""Both searches against brute force."""

import math

import numpy as np

from strandwise.llm import kmeans_tree, pivots


def usable(vectors, zero):
    rows = [(r.vec_id, r.embedding) for r in vectors.collect() if r.vec_id is not None and r.embedding is not None]
    rows = [(i, np.array(e, float)) for i, e in rows if all(c is not None and math.isfinite(c) for c in e)]
    return [(i, e) for i, e in rows if zero or e.any()]


def test_exact_top_k(vectors):
    rows = [(i, np.floor(64 * e)) for i, e in usable(vectors, True)]
    want = []
    for q, x in {i: e for i, e in rows if i % 20 == 0}.items():
        scores = {}
        for i, e in rows:
            if i != q:
                scores[i] = max(scores.get(i, -math.inf), int(x @ e))
        best = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:20]
        want += [(q, n, i, s) for n, (i, s) in enumerate(best, 1)]
    for rows_, asked in ((1024, 128), (16, 4)):
        got = pivots.top_k(vectors, rows=rows_, asked=asked, pivots=9).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_annuli_leave_blocks_out(vectors, monkeypatch):
    seen = []
    real = pivots.radius
    monkeypatch.setattr(pivots, "radius", lambda q, floor, top: seen.append(1) or real(q, floor, top))
    q, x = np.array([[3.0, 4.0]]), np.array([[3.0, 4.0], [-3.0, 1.0]])
    assert pivots.products(q, x).tolist() == [[25, -5]]
    big = np.array([[2.0**30, 1.0]])
    assert pivots.products(big, big).tolist() == [[2**60 + 1]]
    r = pivots.radius(q, np.array([25]), 25.0)
    assert seen and r[0] < 0.01


def test_recall_of_the_tree(vectors):
    rows = usable(vectors, False)
    m = {}
    for i, e in rows:
        m.setdefault(i, e / np.linalg.norm(e))
    ids = np.array(sorted(m))
    u = np.array([m[i] for i in ids])
    got = kmeans_tree.neighbours(vectors, leaf=24, tests=100).collect()
    hit = total = 0
    for q in ids[ids % 50 == 0]:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and q not in {r.vec_id for r in mine}
        c = u @ m[q]
        best = sorted(c[ids != q], reverse=True)[:5]
        hit += sum(r.score >= best[-1] - 1e-12 for r in mine)
        total += 5
        assert all(abs(r.score - float(m[q] @ m[r.vec_id])) < 1e-9 for r in mine)
    assert hit >= 0.9 * total


def test_tree_visits_every_leaf_once_and_routes():
    rng = np.random.default_rng(0)
    x = kmeans_tree.unit(rng.normal(size=(900, 8)))
    tree = kmeans_tree.Tree()
    tree.grow(x, 8, 20, rng)
    order = list(tree.visits(x[0]))
    assert sorted(order) == list(range(tree.leaves))
    assert tree.route(x[:50]).max() < tree.leaves


def test_few_and_no_vectors(spark, vectors):
    none = vectors.limit(0)
    assert pivots.top_k(none).count() == 0 and kmeans_tree.neighbours(none).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (100, [0.5, 0.5]), (100, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in kmeans_tree.neighbours(few).collect()) == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]
    assert sorted(map(tuple, pivots.top_k(few).collect())) == [(0, 1, 100, 64 * 32 + 128 * 32), (0, 2, 1, 4096), (100, 1, 0, 6144), (100, 2, 1, 2048)]


def test_one_id_under_many_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 8)).astype("float32")
    rows = [(i, v) for i, v in enumerate(x)]
    for q in (0, 40, 100):  # ids 7 and 9 fill the best hits of these queries; 7 is a third of all rows
        rows += [(7 if j % 4 else 9, x[q] * 1.5 + 0.05 * rng.normal(size=8).astype("float32")) for j in range(60)]
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<float>")
    for k, every, whole, found in (
        (20, 20, lambda q, e: int(np.floor(64 * np.float64(q)) @ np.floor(64 * np.float64(e))), pivots.top_k(table, rows=32, asked=4, pivots=5)),
        (5, 20, lambda q, e: np.float64(q) @ np.float64(e) / np.linalg.norm(np.float64(q)) / np.linalg.norm(np.float64(e)), kmeans_tree.neighbours(table, every=20, recall=1.0, leaf=400)),
    ):
        want = []
        for q in range(0, 120, every):
            scores = {}
            for i, e in rows:
                if i != q:
                    scores[i] = max(scores.get(i, -math.inf), whole(x[q], e))
            want += [(q, n, i) for n, (i, _) in enumerate(sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k], 1)]
        assert sorted((r.query_id, r.rank, r.vec_id) for r in found.collect()) == want


def test_the_tree_asks_on_while_ids_repeat(spark):
    rng = np.random.default_rng(6)
    rows = [(7, [float(c) for c in v]) for v in [1, 0, 0, 0] + 0.1 * rng.normal(size=(300, 4))]
    rows += [(i, [float(c) for c in v]) for i, v in enumerate([-1, 0, 0, 0] + 0.1 * rng.normal(size=(40, 4)), 10)] + [(50, [1.0, 0.0, 0.0, 0.0])]
    got = kmeans_tree.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), leaf=16).where("query_id = 50").collect()
    assert len({r.vec_id for r in got}) == len(got) == 5
