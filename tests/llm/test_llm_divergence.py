"""Source divergences against a plain count over all documents, spills, many sources, and odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest

from strandwise.llm import divergence
from strandwise.llm.divergence import divergences, exact_shares, merged, stripes_of, terms

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=30, top=50):
    """Rows by definition, from (text, lang, source)."""
    df, count = defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = [w.translate(LOWER) for w in TERM.findall(text or "")]
        groups[lang].add(source)
        df[lang].update(set(words))
        count[lang, source].update(words)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        share = lambda c: (lambda total: {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept})(sum(c[t] for t in kept))  # noqa: B023, E731
        whole = share(sum((count[lang, s] for s in sources), Counter()))
        p = {s: share(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            used = [(t, p[s][t] - whole[t]) for t in kept if count[lang, s][t] and p[s][t] > whole[t]]
            for part, rows, most in (("pair", pairs, len(pairs)), ("term", used, top)):
                rows.sort(key=lambda r: (-r[1], r[0].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(rows[:most])}
    return out


def rows_of(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture
def words(spark):
    """Documents in two languages with a source that holds a third, words in many documents and in one."""
    rng = random.Random(5)
    common = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Été", "straße", "Ωmega"]
    docs = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else f"s{rng.randrange(7)}"
        text = " ".join(rng.choices(common, range(1, 64), k=rng.randrange(0, 40))) + f" only{chr(97 + i % 26)}{chr(97 + i // 26)}. A-b_C9d"
        docs.append((text, "de" if i % 4 else "fr", source))
    return docs, spark.createDataFrame([(i, *d, i, "t") for i, d in enumerate(docs)], "doc_id long, text string, lang string, source string, df long, term string")


def test_equals_a_plain_count(words):
    docs, frame = words
    assert rows_of(divergences(frame)) == brute(docs)
    assert rows_of(divergences(frame, least=2, top=3)) == brute(docs, 2, 3)


def test_spills_tiles_and_blocks_change_nothing(words, monkeypatch):
    docs, frame = words
    want = brute(docs, 5)
    assert rows_of(divergences(frame, least=5, held=50)) == want
    monkeypatch.setattr(divergence, "TILE", 2)
    monkeypatch.setattr(divergence, "TERMS", 7)
    assert rows_of(divergences(frame, least=5)) == want


def test_stripes_merge_by_key(words):
    _, frame = words
    spilled = stripes_of(frame, 40)
    whole = {(r.lang, r.term): (r.df, dict(zip(r.sources, r.counts, strict=True))) for r in merged(spilled, 1).collect()}
    again = defaultdict(lambda: [0, Counter()])
    for r in spilled.collect():
        again[r.lang, r.term][0] += r.df
        again[r.lang, r.term][1].update(dict(zip(r.sources, r.counts, strict=True)))
    assert whole == {k: (n, dict(c)) for k, (n, c) in again.items()}


def test_odd_rows(odd, none):
    docs = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert rows_of(divergences(odd)) == brute(docs)
    assert rows_of(divergences(odd, least=1)) == brute(docs, 1)
    assert divergences(none).count() == 0


def test_terms_and_long_texts(monkeypatch):
    text = "Abc_def9Éa\x7fx \U0001f600Q- ".encode()
    want = [w.translate(LOWER).encode() for w in TERM.findall(text.decode())]
    assert list(terms(text)) == want
    monkeypatch.setattr(divergence, "LONG_TEXT", 1)
    assert list(terms(text)) == want


def test_shares_of_huge_counts_are_exact():
    import numpy as np

    counts = [0, 7, 10**17]
    assert exact_shares(np.array(counts), 2 * 10**17, 3).tolist() == [1 + 10**9 * (c + 5) // (2 * 10**17 + 15) for c in counts]
