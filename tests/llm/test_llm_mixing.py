"""Targets, schedule and words taken."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from strandwise.llm.mixing import block_slots, mix, mixed, source_targets


def targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    whole, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        free = whole - sum(most * sizes[s] for s in full)
        goal = {s: most * sizes[s] if s in full else free * w[s] / sum(w[x] for x in rest) for s in order}
        over = {s for s in rest if goal[s] > most * sizes[s] + 1e-9}
        if not over:
            return goal
        full |= over


def check(docs):
    rows = docs.collect()
    size = lambda t: len((t or "").encode().split())
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += size(r.text)
    goal = targets(dict(sizes))
    got = mix(docs).join(docs.select("doc_id", "text", F.col("source").alias("s")).distinct(), "doc_id").collect() if all(r.doc_id is not None for r in rows) else mix(docs).withColumn("s", F.lit(None)).collect()
    assert len(mix(docs).collect()) == len(rows)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.s] += r.taken
    return goal, taken, sizes, got


def test_targets_are_met(corpus):
    goal, taken, sizes, got = check(corpus)
    for r in got:
        assert r.size == len((r.text or "").encode().split())
        assert r.source_size == sizes[r.s] and abs(r.target - goal[r.s]) < 1e-6
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 1
    again = mix(corpus.repartition(7)).drop("h").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, mix(corpus).drop("h").collect()))


def test_caps_share_the_excess(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(900, "z"), (3, "a"), (5, "B"), (0, "empty"), (40, None), (7, "c")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mix(docs, block=16).collect()}
    goal = targets({"z": 900, "a": 3, "B": 5, "empty": 0, None: 40, "c": 7})
    for i, (_, _, s) in enumerate(rows):
        assert abs(got[i].target - goal[s]) < 1e-6 and abs(got[i].taken - goal[s]) <= 1


def test_schedule_is_spread(spark):
    sized = spark.createDataFrame([("a", 50_000), ("b", 50_000), ("c", 50_000)], "source string, size long")
    slots = sorted(block_slots(source_targets(sized), 100).collect(), key=lambda r: r.slot)
    share = {r.source: r.target / 150_000 for r in source_targets(sized).collect()}
    seen = Counter()
    for n, r in enumerate(slots[:1400], 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - n * share[s]) < 6 for s in share)
    for s in share:
        ranks = [(r.epoch, r.block) for r in slots if r.source == s]
        assert ranks == sorted(ranks) and len(set(ranks)) == len(ranks)


def test_odd_rows(odd, none):
    check(odd)
    assert mix(none).count() == 0
    out = mixed(odd)
    assert out.columns == odd.columns and out.where("text is null").count() == 0
    assert mixed(none).count() == 0
