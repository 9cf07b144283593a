"""Edited counts against a full count of the edited text."""

import random

from pyspark.sql import functions as F

from strandwise.llm.token_counts import EDIT, LEAF, Tree, build, count, counter, edit, recount, sample_edits

KNOWN = counter("byte_bpe_50k.tiktoken")
PARTS = ["'r", "e", "'s", "  ", "\n\n", " ", "x", "é", "123", "don't we're", "ßß", " \n a", "'l", "l", ".", ""]


def whole(text):
    return len(KNOWN.encoding.encode_ordinary(text))


def test_edits_equal_a_full_count(corpus):
    rng = random.Random(5)
    texts = [r.text for r in corpus.orderBy("doc_id").limit(40).collect()]
    for text in [*texts, "", "a", "  ", "'" * 50, "a" * 3000, " " * 500 + "b"]:
        tree = build(text, KNOWN)
        assert tree.tokens == whole(text)
        for _ in range(15):
            put = "".join(rng.choice(PARTS) for _ in range(rng.randrange(4))) if rng.random() < 0.9 else "lorem ipsum " * rng.randrange(200)
            text, tree, _ = edit(text, tree, rng.randrange(len(text) + 2), rng.choice([0, 0, 1, 2, 5, 200, 5000]), put, KNOWN)
            assert tree.tokens == whole(text) and tree.sums[0, 1] == len(text)
            assert (tree.sums[:, 1 : tree.width] == tree.sums[:, 2 : 2 * tree.width : 2] + tree.sums[:, 3 : 2 * tree.width : 2]).all()


def test_small_edits_encode_little():
    text = "some words of a long text, again and again. " * 5000
    tree = build(text, KNOWN)
    _, _, work = edit(text, tree, 100_000, 3, "new", KNOWN)
    assert work < 12 * LEAF * 3
    assert Tree.from_bytes(tree.to_bytes()).tokens == tree.tokens


def test_recount_in_a_table(corpus, odd, none):
    for docs in (corpus, odd):
        counted = count(sample_edits(docs))
        rows = recount(counted).select("doc_id", "text", "tokens", "encoded").collect()
        assert len(rows) == docs.count()
        assert all(r.tokens == whole(r.text or "") for r in rows)
    assert set(odd.columns) <= set(recount(count(sample_edits(odd))).columns)
    assert recount(count(sample_edits(none))).count() == 0


def test_null_edits_change_nothing(spark):
    docs = count(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string"))
    same = recount(docs.withColumn("edits", F.lit(None).cast(EDIT))).collect()
    assert [(r.text, r.tokens) for r in sorted(same, key=lambda r: r.doc_id)] == [("a b c", 3), (None, 0)]
    odd = docs.withColumn("edits", F.expr(f"cast(array(null, struct(null, 1, 'x'), struct(99, 1, null)) as {EDIT})"))
    assert sum(r.tokens for r in recount(odd).collect()) == 3
