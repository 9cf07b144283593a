"""Pieces against the tokenizer, bins against their bound, and the plan's exactness."""

import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from strandwise.llm.packing import pack, plan_bins


def check(docs, size):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in docs.collect():
        ids = whole.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            want.append((str(r.doc_id), k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    got = pack(docs, size).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return len(bins), sum(r.length for r in got) / size


def test_pieces_and_bins(corpus):
    bins, bound = check(corpus, 4096)
    assert bins <= bound * 1.02 + 1


def test_odd_rows(odd, none):
    check(odd, 64)
    assert pack(none).count() == 0
    kept = pack(odd, 64, keep_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in kept)


def test_plan_uses_every_length_once():
    rng = np.random.default_rng(1)
    for size, n in ((20, 60), (100, 1000), (4096, 5000), (7, 0)):
        counts = np.bincount(rng.integers(1, size + 1, n), minlength=size + 1)
        plan = plan_bins(counts)
        used = np.zeros(size + 1, np.int64)
        for lengths, times in plan:
            assert sum(lengths) <= size and times > 0
            for x in lengths:
                used[x] += times
        assert (used == counts).all()
        assert len(plan) <= 3 * np.count_nonzero(counts) + 1
        assert sum(t for _, t in plan) >= (counts * np.arange(size + 1)).sum() / size


def test_complements_are_exact():
    counts = np.zeros(101, np.int64)
    counts[[60, 40]] = 5, 5  # single
    counts[[70, 20, 10]] = 3, 3, 3  # pair
    counts[[55, 25, 15, 5]] = 2, 2, 2, 2  # triple
    assert sum(t for _, t in plan_bins(counts)) == 10
