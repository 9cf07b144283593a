"""Labels against a plain Viterbi, held-out accuracy, scripts and odd rows."""

from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.llm.language import BUCKETS, NAMES, Model, fit, held_out, identify, known_language, label_words, words_of


def slow_viterbi(scores, penalty):
    best, back = scores[0], []
    for row in scores[1:]:
        move = best[:, None] - penalty * (1 - np.eye(len(best)))
        back.append(move.argmax(axis=0))
        best = move.max(axis=0) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def worth(scores, path, penalty):
    return sum(s[k] for s, k in zip(scores, path, strict=True)) - penalty * sum(a != b for a, b in zip(path, path[1:], strict=False))


def test_labels_equal_a_plain_viterbi():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 60, 80)
    base = np.repeat(rng.integers(0, 3, 80), lengths)
    scores = rng.normal(size=(lengths.sum(), 3)) * 2
    scores[np.arange(len(base)), base] += 1.0
    firsts = np.cumsum(lengths) - lengths
    for penalty in (0.5, 3.0, 10.0):
        labels = label_words(scores, firsts, penalty)
        for f, n in zip(firsts, lengths, strict=True):
            part = scores[f : f + n]
            assert abs(worth(part, labels[f : f + n], penalty) - worth(part, slow_viterbi(part, penalty), penalty)) < 1e-9


def test_words_and_places():
    texts = ["Été, à  Paris", "", "123 x", "Ελλάδα мир"]
    w = words_of(texts)
    assert [texts[d][a:b] for d, a, b in zip(w.doc, w.start, w.end, strict=True)] == ["Été", "à", "Paris", "x", "Ελλάδα", "мир"]
    assert [NAMES[s] for s in w.script] == ["latin"] * 4 + ["greek", "cyrillic"]


def test_script_rules_languages_out():
    scripts = np.zeros((len(NAMES), 2), bool)
    scripts[NAMES.index("latin"), 0] = scripts[NAMES.index("greek"), 1] = True
    model = Model(["la", "el"], np.zeros((BUCKETS, 2), np.float32), np.zeros((BUCKETS, 2), np.float32), scripts)
    assert model.scores(words_of(["word λόγος שלום"])).argmax(axis=1).tolist() == [0, 1, 0]
    assert model.scores(words_of(["שלום"])).tolist() == [[0, 0]]


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, fit(docs)


def test_held_out_accuracy(learned):
    docs, model = learned
    got = identify(docs, model).where(held_out(F.col("doc_id"))).select("doc_id", "lang", "lang_pred", "score").collect()
    assert len(got) == sum(crc32(str(i).encode()) % 4 == 2 for i in range(1000))
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_mixed_text_has_spans(learned, spark):
    docs, model = learned
    parts = {r.lang: r.text for r in docs.where("n_chars between 400 and 900").orderBy("doc_id").limit(60).collect()}
    text = parts["en"] + " " + parts["fr"]
    (row,) = identify(spark.createDataFrame([(text,)], "text string"), model).collect()
    assert [s.lang for s in row.spans if s.end - s.start > 100] == ["en", "fr"]
    assert abs(row.spans[0].end - len(parts["en"])) < 60


def test_odd_rows(learned, odd, none):
    _, model = learned
    got = identify(odd, model)
    assert got.count() == odd.count() and set(odd.columns) <= set(got.columns)
    rows = {r.doc_id: r for r in got.collect()}
    for i in (5, 6, 7, 13):
        assert (rows[i].lang_pred, rows[i].score, rows[i].spans) == ("und", 0.0, [])
    assert all(rows[i].lang_pred in model.langs for i in (1, 8, 10, 11, 12))
    assert identify(none, model).count() == 0
    assert identify(odd, fit(none)).where("lang_pred <> 'und'").count() == 0
    stay = known_language(odd)
    assert stay.columns == odd.columns and {1, 8, 9, 12} <= {r.doc_id for r in stay.collect()}
