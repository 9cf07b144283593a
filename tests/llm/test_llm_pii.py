"""Base patterns against a plain scan, beliefs, other forms on held-out documents, and odd rows."""

import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandwise.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base(text):
    found = sorted((m.start(), i, m.end()) for i, (kind, p) in enumerate(PLAIN.items()) for m in p.finditer(text or "") if passes(kind, m[0]))
    return ",".join(f"{pii.BASE[i]}:{a}:{b}" for a, i, b in found)


def scan(spark, texts):
    rows = [(i, t, "u", 1, 2, "k") for i, t in enumerate(texts)]
    return {r.doc_id: r for r in pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string, hit string, row int, kind int, found string")).collect()}


def spans_in(row, text):
    return [(k, text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in row.spans.split(",") if s)]


def test_base_equals_a_plain_scan(spark):
    parts = ["a.b@c.d", "a@b.c_d@e.f-g.h", "x@y", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+4912345)", "+1 2", "++33 1 23 45 67 89..", "\U0001f600é", "79927398713", "1 2 3 4 5 6 7 8 9 0 1 2 8", "\n", "@@a@b.c@d.e"]
    rng = np.random.default_rng(2)
    texts = parts + ["".join(p + " x,-"[rng.integers(0, 5) : rng.integers(0, 5)] for p in rng.choice(parts, 8)) for _ in range(300)]
    texts += ["".join(rng.choice(list("0123456789 .-+@a_()"), 60)) for _ in range(300)]
    got = scan(spark, texts)
    assert [got[i].base for i in range(len(texts))] == [base(t) for t in texts]
    for i, t in enumerate(texts):
        kinds = [s.split(":")[0] for s in base(t).split(",")]
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [kinds.count(k) for k in pii.BASE]


def test_long_runs_are_read_whole(spark):
    texts = ["a" * 5_000 + "@b.c " + "7" * 2_000 + " +" + "1 " * 2_000 + "1", "1." * 2_000, "x@y." * 2_000]
    got = scan(spark, texts)
    assert [got[i].base for i in range(3)] == [base(t) for t in texts]
    # a plain pattern reads such runs again from each of their characters
    got = scan(spark, ["a" * 300_000 + "@b.c " + "7" * 300_000 + " +" + "1 " * 300_000, "1." * 300_000])
    assert got[0].base == "email:0:300004" and got[1].n_ip == 75_000


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(-1, 1), st.integers(-1, 1), st.integers(-1, 1)), min_size=1, max_size=12), st.integers(1, 50))
def test_beliefs_are_probabilities(votes, times):
    votes = np.array(votes)
    belief, rates, prior = pii.believe(votes, np.full(len(votes), float(times)))
    assert ((belief >= 0) & (belief <= 1)).all() and 0 < prior < 1
    assert np.allclose(rates.sum(axis=2), 1)


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(7)
    truth = rng.random(20_000) < 0.3
    right = (0.95, 0.8, 0.6, 0.9)
    cast = np.stack([np.where(rng.random(len(truth)) < r, truth, ~truth) * 2 - 1 for r in right], axis=1)
    cast[rng.random(cast.shape) < 0.2] = 0
    patterns, times = np.unique(cast, axis=0, return_counts=True)
    belief, rates, prior = pii.believe(patterns, times.astype(float))
    assert abs(prior - 0.3) < 0.02
    for j, r in enumerate(right):
        assert abs(rates[1, j, 2] / 0.8 - r) < 0.05 and abs(rates[0, j, 0] / 0.8 - r) < 0.05
    # the beliefs follow from the rates by Bayes' rule
    for p, b in zip(patterns, belief, strict=True):
        odds = prior / (1 - prior) * np.prod([rates[1, j, v + 1] / rates[0, j, v + 1] for j, v in enumerate(p)])
        assert abs(b - odds / (1 + odds)) < 1e-6


def test_weights_follow_beliefs():
    looks = np.array(list(itertools.product((0.0, 1.0), repeat=2)))
    w = pii.fit_looks(looks, np.full(4, 500.0), np.array([0.02, 0.97, 0.03, 0.98]))
    p = 1 / (1 + np.exp(-(w[0] + looks @ w[1:])))
    assert np.abs(p - [0.02, 0.97, 0.03, 0.98]).max() < 0.02


def corpus(n, seed):
    """Texts with base forms, other forms of the same data, and look-alikes; the spans that are personal, and those that are not."""
    rng = np.random.default_rng(seed)
    texts, yes, no = [], [], []
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    for i in range(n):
        words = " ".join(rng.choice("here are some plain words of a letter that goes on".split(), 12))
        phone = f"({digits(3)}) {digits(3)}-{digits(4)}"
        user = f"{rng.choice(['kim', 'lee', 'max', 'zoe'])}.{rng.choice(['fox', 'hill', 'wood'])}{digits(2)}"
        host = rng.choice(["mail", "post", "corp"])
        forms = [
            (f"call +1 {phone} now", None, None),
            (f"mail to {user}@{host}.example.com please", None, None),
            (f"call {phone} today", phone, None),
            (f"phone {digits(3)}-{digits(3)}-{digits(4)}", None, None),
            (f"write {user} (at) {host} (dot) com soon", f"{user} (at) {host} (dot) com", None),
            (f"version {digits(1)}.{digits(3)}.{digits(4)} of it", None, None),
            (f"on {2000 + int(digits(1))}-{rng.integers(10, 13)}-{rng.integers(10, 29)} at last", None, "date"),
            (f"total {digits(9)} units", None, "digits"),
            ("we look at the.Next one", None, "look at the.Next"),
        ]
        text, want, against = forms[i % len(forms)]
        texts.append(f"{words} {text} {words}")
        yes.append(want)
        no.append(against)
    return texts, yes, no


def test_other_forms_are_found_on_held_out_documents(spark):
    learn, _, _ = corpus(900, 1)
    rows = spark.createDataFrame(list(enumerate(learn)), "doc_id long, text string")
    model = pii.fit(pii.judged(pii.spans_of(pii.durable(pii.found_in(rows), "found"))))
    texts, yes, no = corpus(450, 2)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.durable(pii.found_in(rows), "found")
    scored = pii.judged(pii.spans_of(found)).where("kind >= 4").withColumn("score", model.score()).join(found.select("row", "doc_id"), "row").collect()
    hits = {}
    for r in scored:
        if r.score >= 0:
            hits.setdefault(r.doc_id, []).append(texts[r.doc_id][r.start : r.end])
    asked = [i for i, y in enumerate(yes) if y]
    assert sum(yes[i] in hits.get(i, []) for i in asked) >= 0.95 * len(asked)
    plain = [i for i, n in enumerate(no) if n]
    assert sum(i in hits for i in plain) <= 0.02 * len(plain)


def test_account_numbers_and_check_digits(spark):
    got = spark.createDataFrame([("DE89 3704 0044 0532 0130 00",), ("GB82WEST12345698765432",), ("DE89 3704 0044 0532 0130 01",)], "hit string").select(pii.remainder_97(F.col("hit")).alias("m")).collect()
    assert [r.m == 1 for r in got] == [True, True, False]
    got = spark.createDataFrame([("4111111111111111",), ("4111111111111112",), ("123",)], "d string").select(pii.luhn(F.col("d")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, False, None]


def test_added_spans_touch_no_base_span(spark, corpus):
    rows = corpus.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in pii.find_personal(corpus).collect()}
    for r in rows:
        assert got[r.doc_id].base == base(r.text)
        every = [(s.split(":")[0], int(s.split(":")[1]), int(s.split(":")[2])) for s in got[r.doc_id].spans.split(",") if s]
        own = [s for s in every if s[0] in pii.BASE]
        assert ",".join(f"{k}:{a}:{b}" for k, a, b in own) == base(r.text)
        assert not any(a < y and x < b for k, a, b in every if k in pii.LOOSE for _, x, y in own)


def test_odd_rows(spark, odd, none):
    got = pii.find_personal(odd).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.collect())
    assert all(r.base == "" and r.spans == "" for r in got if r.doc_id in (5, 6, 7, None))
    assert pii.find_personal(none).count() == 0
    same = scan(spark, ["mail a@b.cd now"] * 3 + [None, ""])
    assert [same[i].base for i in range(5)] == ["email:5:11"] * 3 + ["", ""]


@pytest.mark.parametrize("fixture", ["odd"])
def test_no_python_runs_on_rows(fixture, request):
    plan = pii.find_personal(request.getfixturevalue(fixture))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
