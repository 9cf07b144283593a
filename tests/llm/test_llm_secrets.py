"""Base patterns, the field's decoding and learning, and odd rows."""

import itertools

import numpy as np
import pytest

from strandwise.llm.secrets import B, I, O, Field, Finder, base_spans, find_secrets, fit, fit_field, training_windows

HEX = "0123456789abcdef0123456789abcdef"


def test_base_patterns():
    text = f'Password: "abcdef" token=abc api_key = x/y+z_1.2- AKIA{"A1" * 8} AKIASHORT {HEX} {HEX[:23]} ſecret=abcdefgh'
    spans = base_spans(text)
    assert [(k, text[a:b]) for k, a, b in spans] == [("assign", 'Password: "abcdef'), ("assign", "api_key = x/y+z_1.2-"), ("access", "AKIA" + "A1" * 8), ("hex", HEX)]
    both = base_spans(f"secret={HEX}")
    assert [s[0] for s in both] == ["assign", "hex"]
    # a match that is too short is used up all the same
    assert base_spans("secret: token: abcdefgh") == []


def test_decoding_equals_enumeration():
    rng = np.random.default_rng(4)
    field = Field({}, rng.normal(size=(3, 3)))
    field.moves[O, I] = -1e4
    for n in (1, 2, 5):
        rows = list(rng.normal(size=(n, 3)))
        value = lambda path: sum(r[k] for r, k in zip(rows, path, strict=True)) + sum(field.moves[a, b] for a, b in zip((O, *path), (*path, O), strict=True))  # noqa: B023, E731
        best = max(itertools.product((O, B, I), repeat=n), key=value)
        assert tuple(field.decode(rows)) == best


def test_runs_decode_like_the_whole_text():
    docs = [f"plain words here and key: k{i:06d}XyZ{i} end of it\n" + "more plain words, all of them. " * 5 + f"AKIA{'Q7' * 8} tail x{i}-y" for i in range(40)]
    finder = Finder(fit_field([w for d in docs[:30] for w in training_windows(d)], rounds=40))
    whole = Finder(finder.field)
    whole.most = 1e9
    whole.known.clear()
    whole.everything = True
    for d in docs[30:]:
        assert finder.added(d, []) == whole.added(d, [])
        assert any(d[a:b].startswith("AKIA") for _, a, b in finder.added(d, []))


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, fit(docs, sample=600)


def test_field_finds_the_secrets_it_learned_from(learned):
    docs, field = learned
    finder = Finder(field)
    hits = total = 0
    for r in docs.collect():
        for kind, a, b in base_spans(r.text or ""):
            if kind != "assign":
                total += 1
                hits += any(x < b and a < y for _, x, y in finder.added(r.text, []))
    assert total and hits >= 0.8 * total


def test_odd_rows(learned, odd, none):
    _, field = learned
    got = find_secrets(odd, field)
    rows = got.collect()
    assert len(rows) == odd.count()
    assert all(r.spans == "" for r in rows if r.doc_id in (5, 6, 7, 13))
    assert find_secrets(none, field).count() == 0
    assert find_secrets(odd, fit(none)).where("n_crf > 0").count() == 0


def test_base_stays_and_added_spans_do_not_touch_it(learned, corpus):
    _, field = learned
    for r, text in ((r, r.text) for r in find_secrets(corpus, field).join(corpus.select("doc_id", "text"), "doc_id").collect()):
        base = base_spans(text or "")
        assert r.base == ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        all_ = [tuple(s.split(":")) for s in r.spans.split(",") if s]
        assert [s for s in all_ if s[0] != "crf"] == [(k, str(a), str(b)) for k, a, b in base]
        for _, a, b in (s for s in all_ if s[0] == "crf"):
            assert not any(x < int(b) and int(a) < y for _, x, y in base)


def test_rare_matches_are_learned_from(spark):
    rows = [(i, f"plain words of document {i} and no more" + (f" but AKIA{'Q7' * 8} here" if i % 1500 == 13 else "")) for i in range(4500)]
    field = fit(spark.createDataFrame(rows, "doc_id long, text string"), sample=4)
    assert field.weights["top:AKIA"][B] > field.weights["top:AKIA"][O]


@pytest.mark.parametrize("feature, token", [("hint", "pwd:correcthorsebattery"), ("hint", "bearer"), ("has.", "auth.abc.def"), ("c:dl", "a" * 300 + "1234")])
def test_plain_letters_with_other_traits_are_decoded(feature, token):
    finder = Finder(Field({feature: np.array([0.0, 5, 0])}, np.array([[0.0, -1, -1e4], [0, -1, -1], [0, -1, -1]])))
    text = f"some words {token} and more"
    assert not finder.everything and finder.added(text, []) == [("crf", 11, 11 + len(token))]
