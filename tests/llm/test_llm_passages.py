"""Repeated passages that were planted, exact similarity of links, crowded cells, and odd rows."""

import os
import random

import pytest

from strandwise.llm import passages
from strandwise.llm.common import components
from strandwise.llm.passages import hub_links, repeated_passages, tune_bands, without_passages


def words(rng, n):
    return [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(10**6)}" for _ in range(n)]


def test_planted_passages_are_found_and_clean_documents_are_not(spark):
    rng = random.Random(8)
    passage = words(rng, 55)
    rows, planted = [], set()
    for i in range(120):
        own = words(rng, 150)
        if i % 6 == 0:
            at = rng.randrange(150)
            own[at:at] = passage
            planted.add(i)
        line = rng.choice([0, 40])
        rows.append((i, " ".join(own[:line]) + "\n" + " ".join(own[line:])))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id for r in got}
    assert found <= planted and len(found) >= 0.9 * len(planted)
    assert {r.doc_id for r in got if not r.removed} == {min(found)}
    assert all(r.keeper == min(found) and r.words >= 20 for r in got)


def test_edited_paragraphs_are_linked(spark):
    rng = random.Random(9)
    rows = []
    base = words(rng, 60)
    for i in range(50):  # more than a crowd, all of them different
        own = list(base)
        own[i] = f"changed{i}"
        rows.append((i, "\n".join([" ".join(words(rng, 30)), " ".join(own)])))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), crowd=8).collect()
    assert {r.doc_id for r in got} == set(range(50))
    assert {r.keeper for r in got if r.words >= 55} == {0}


@pytest.mark.parametrize("crowd", [4])
def test_hubs_find_all_that_is_connected(spark, crowd):
    rng = random.Random(3)
    base = list(range(56))
    sets, families = {}, []
    for k in range(70):  # a paragraph, copies with edits of five shingles each, copies of copies, and shorter ones
        own = list(rng.choice(families) if families and rng.random() < 0.4 else base)
        for _ in range(k and rng.choice([0, 1, 1, 2])):
            at = rng.randrange(0, 52)
            own[at : at + 5] = [rng.randrange(10**6) + 100 for _ in range(5)]
        families.append(own)
        sets[k] = sorted({*own[: rng.choice([56, 56, 50])]})
    table = spark.createDataFrame(list(sets.items()), "key long, s array<long>")
    crowds = spark.createDataFrame([(1, k) for k in sets], "cell long, key long")
    got = {r.node: r.root for r in components(hub_links(crowds, table, 0.8, crowd)).collect()}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            common = len({*sets[a]} & {*sets[b]})
            if a < b and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    slow, fast = {}, {}
    for k in sets:
        slow.setdefault(find(k), set()).add(k)
        fast.setdefault(got.get(k, k), set()).add(k)
    assert 1 < len(slow) < len(sets)
    assert sorted(map(sorted, slow.values())) == sorted(map(sorted, fast.values()))


def test_bands():
    assert tune_bands(0.8, 1, 0.99) == 3 and 1 - (1 - 0.8**4) ** tune_bands(0.8, 4, 0.99) >= 0.99


def test_odd_rows(odd, none):
    got = repeated_passages(odd).collect()
    assert {(r.doc_id, r.removed) for r in got} == {(8, False), (9, True)}
    assert repeated_passages(none).count() == 0
    left = without_passages(odd)
    assert left.columns == odd.columns and left.count() == odd.count()
    assert {r.doc_id: r.text for r in left.collect()}[8] == {r.doc_id: r.text for r in odd.collect()}[8]
    assert all(not r.text.strip() for r in left.collect() if r.doc_id == 9)


def lined(tokens, sizes):
    """The tokens in lines of the given sizes, over and over."""
    out, at, i = [], 0, 0
    while at < len(tokens):
        out.append(" ".join(tokens[at : at + sizes[i % len(sizes)]]))
        at += sizes[i % len(sizes)]
        i += 1
    return "\n".join(out)


@pytest.mark.parametrize("one, two", [([6], [6]), ([15, 5], [15, 5]), ([12], [60]), ([7], [60]), ([3, 9], [20])])
def test_lines_do_not_hide_passages(spark, one, two):
    rng = random.Random(11)
    passage = words(rng, 60)
    text = lambda sizes: lined(words(rng, 40), [7]) + "\n" + lined(passage, sizes) + "\n" + lined(words(rng, 30), [30])
    got = repeated_passages(spark.createDataFrame([(1, text(one)), (2, text(two)), (3, lined(words(rng, 90), [6]))], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 40, 60, 1, False), (2, 40, 60, 1, True)]


def test_short_lines_between_edited_paragraphs(spark):
    rng = random.Random(12)
    blocks = [(words(rng, 14), words(rng, 5)) for _ in range(3)]
    text = lambda: "\n".join(" ".join(x) for a, b in blocks for x in ([*a, *words(rng, 1)], b))
    got = repeated_passages(spark.createDataFrame([(1, text()), (2, text())], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start, r.removed) for r in got} == {(1, 0, False), (2, 0, True)} and all(r.words >= 55 for r in got)


def test_passages_in_long_lines_are_found_to_the_word(spark):
    rng = random.Random(13)
    rows, want = [], set()
    for i in range(40):  # exact pastes of 20 to 60 words, and 60 words with one changed in the middle
        passage = words(rng, 60 if i % 2 else 20 + i)
        other = passage[:30] + ["changed"] + passage[31:] if i % 2 else passage
        for d, p in ((2 * i, passage), (2 * i + 1, other)):
            at = rng.randrange(100)
            rows.append((d, " ".join(words(rng, at) + p + words(rng, 120 - at))))
            want.add((d, at, len(p), 2 * i, d % 2 == 1))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)


def test_tables_and_shuffles_go_when_they_are_read(spark, monkeypatch):
    """What is kept until the result is read: no shuffle of a table that is written, no table of seeds."""
    keep, kept, told = passages.settled, {}, []
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_conf = spark.conf.set

    def settled(df, name):
        kept[name] = out = keep(df, name)
        return out

    monkeypatch.setattr(passages, "settled", settled)
    monkeypatch.setattr(type(spark.conf), "set", lambda self, k, v: (told.append((k, v)), set_conf(k, v))[1])
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, words), (2, f"a b c {words} d e"), (3, "other words")], "doc_id long, text string")
    got = passages.repeated_passages(docs)
    assert {r.doc_id for r in got.collect()} == {1, 2}
    assert (key, "true") in told and spark.conf.get(key) == "false"
    gone = {n for n, t in kept.items() if not any(os.path.exists(f.removeprefix("file:")) for f in t.inputFiles())}
    assert {"units", "begun", "beside", "seeds", "spans"} <= gone


def test_crowds_of_different_sizes_make_no_pairs_of_all(spark, monkeypatch):
    """A small paragraph in a cell of larger ones that are all different makes nobody meet the whole cell."""
    rng = random.Random(5)
    fresh = lambda n: [rng.randrange(10**9) + 1000 for _ in range(n)]
    sets = {k: sorted([*range(30), *fresh(20)]) for k in range(150)} | {150: list(range(50)), 151: list(range(4))}
    met = []
    keep = passages.similar
    monkeypatch.setattr(passages, "similar", lambda pairs, *a: (met.append(pairs.count()), keep(pairs, *a))[1])
    table = spark.createDataFrame(list(sets.items()), "key long, s array<long>")
    crowds = spark.createDataFrame([(1, k) for k in sets], "cell long, key long")
    assert hub_links(crowds, table, 0.8, 8).where("a <> b").count() == 0
    assert sum(met) < 10 * len(sets)


def test_runs_of_twenty_words_are_all_found_and_written_as_runs(spark, monkeypatch):
    """Against all windows of 20 words; what is kept on disk of exact runs is a row a run, not some rows a seed."""
    rng = random.Random(14)
    keep, kept = passages.settled, {}

    def settled(df, name):
        kept[name] = out = keep(df, name)
        if name == "exact":
            kept["rows"] = out.count()
        return out

    monkeypatch.setattr(passages, "settled", settled)
    pool = [words(rng, 90) for _ in range(6)]
    docs = {}
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(pool)
            at = rng.randrange(60)
            parts += [*words(rng, rng.randrange(15)), *p[at : at + rng.randrange(10, 60)]]
        docs[i] = parts
    first = {}
    for d, w in docs.items():
        for j in range(len(w) - 19):
            first.setdefault(tuple(w[j : j + 20]), d)
    want = {(d, j + x) for d, w in docs.items() for j in range(len(w) - 19) if first[tuple(w[j : j + 20])] < d for x in range(20)}
    got = repeated_passages(spark.createDataFrame([(d, lined(w, [7, 5])) for d, w in docs.items()], "doc_id long, text string")).collect()
    removed = {(r.doc_id, x) for r in got if r.removed for x in range(r.start, r.start + r.words)}
    assert want <= removed and len(removed) < 1.2 * len(want)
    assert kept["rows"] < 12 * len(docs)
    for r in got:  # what is kept does not lie inside what is removed
        assert r.removed or not {(r.doc_id, x) for x in range(r.start, r.start + r.words)} <= removed


def test_a_crowd_of_cut_and_edited_copies_is_written_as_a_few_rows_a_member(spark, monkeypatch):
    """Copies of different sizes with edits: what is written grows with the members, and what is connected stays so."""
    rng = random.Random(6)
    base, sets = list(range(100)), {}
    for k in range(120):
        own = base[: rng.choice([100, 95, 80, 70])]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(own) - 5)
            own[at : at + 5] = [rng.randrange(10**9) + 1000 for _ in range(5)]
        sets[k] = sorted({*own})
    keep, wrote = passages.settled, []

    def settled(df, name):
        out = keep(df, name)
        wrote.append(out.count())
        return out

    monkeypatch.setattr(passages, "settled", settled)
    table = spark.createDataFrame(list(sets.items()), "key long, s array<long>")
    crowds = spark.createDataFrame([(1, k) for k in sets], "cell long, key long")
    got = components(hub_links(crowds, table, 0.8, 32)).where("root = 1").count()
    alike = lambda a, b: len({*a} & {*b}) >= 0.8 * len({*a} | {*b})
    reached = todo = {1}
    while todo:
        todo = {k for k in sets if k not in reached and any(alike(sets[k], sets[j]) for j in todo)}
        reached = reached | todo
    assert got == len(reached) > 60
    assert sum(wrote) < 20 * len(sets)


def test_nothing_that_grows_with_the_texts_is_broadcast(spark, monkeypatch):
    keep, plans = passages.settled, {}

    def settled(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(passages, "settled", settled)
    rng = random.Random(15)
    line = words(rng, 40)
    docs = [(i, "\n".join(" ".join(x) for x in ([*line[:i], "edit", *line[i + 1 :]], line, words(rng, 30)))) for i in range(6)]
    got = repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"))
    plans["result"] = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() > 0
    for name in ("beside", "begun", "shingles", "links"):
        assert "Join" in plans[name] and "Broadcast" not in plans[name], name
    assert "BroadcastHashJoin" not in plans["result"]
