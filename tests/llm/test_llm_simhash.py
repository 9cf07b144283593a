"""Covering masks, links in crowded cells, and groups against brute force."""

import itertools
import random

import xxhash

from strandwise.llm.common import components
from strandwise.llm.simhash import covering_masks, fingerprint, keep_one, links, simhash_groups


def slow_fingerprint(text):
    own = (text or "").encode().lower().split()
    if not own:
        return 0
    parts = [b" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or [b" ".join(own)]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(prints):
    """Smallest id reachable, by (id, fingerprint) pairs; ids may be None."""
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return {(d, f"{f:016x}", least.get(find(f))) for d, f in prints}


def test_masks_cover_all_pairs():
    masks = covering_masks(2)
    assert len(masks) == 7
    for i, j in itertools.combinations(range(64), 2):
        assert any(not (m >> i) & 1 and not (m >> j) & 1 for m in masks)


def test_groups_equal_brute_force(corpus, odd, none):
    for docs in (corpus, odd):
        rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
        got = simhash_groups(docs).collect()
        assert len(got) == len(rows)
        assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == groups(rows)
    assert simhash_groups(none).count() == 0


def test_crowded_cells_lose_no_link(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(3)]
    values = set(base)
    for _ in range(500):
        x = rng.choice(base)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        values.add(x)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    roots = {r.node: r.root for r in components(links(spark.createDataFrame([(v,) for v in signed], "fp long"), crowd=4)).collect()}
    root = {v: v for v in values}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    slow, fast = {}, {}
    for v, s in zip(values, signed, strict=True):
        slow.setdefault(find(v), set()).add(v)
        fast.setdefault(roots.get(s, s), set()).add(v)
    assert sorted(map(sorted, slow.values())) == sorted(map(sorted, fast.values()))


def test_long_text_in_chunks():
    text = " ".join(str(i % 977) for i in range(70_000))
    assert fingerprint(text.encode()) == slow_fingerprint(text)


def test_one_document_of_each_group_stays(odd, none):
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    named = simhash_groups(odd).collect()
    assert sorted(i for i in ids if i is not None) == sorted({r.component_id for r in named if r.component_id is not None})
    assert keep_one(none).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 160))
