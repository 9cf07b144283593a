"""Line dedup against a brute-force version, and its odd rows."""

import hashlib
from collections import defaultdict

from strandwise.llm.line_dedup import NO_ID, drop_common_lines
from strandwise.llm.queries import QUERIES

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, min_chars=20, min_docs=3):
    held = defaultdict(set)
    key = lambda line: line.strip(WHITE).translate(LOWER)
    number = lambda d: NO_ID if d is None else d
    for d, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(number(d))
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(held[key(x)]) < min_docs or number(d) == max(held[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_equals_brute_force(corpus):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    for batches, fanout in ((1, 2), (5, 2)):
        got = drop_common_lines(corpus, batches=batches, fanout=fanout).collect()
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got), key=str) == expected(rows)


def test_odd_rows(odd, none):
    got = drop_common_lines(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_dropped"]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=str) == expected(rows)
    assert {r.doc_id: r.text for r in got.collect()}[4] is not None
    assert drop_common_lines(none).count() == 0


def test_query_digest(spark):
    got = QUERIES["op8_line_dedup"](spark, "/root/testdata/sf0.001").collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = {d: hashlib.sha256(t.encode()).hexdigest() for d, _, _, t in expected(rows)}
    assert {r.doc_id: r.kept_sha256 for r in got} == want
