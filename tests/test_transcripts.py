"""Transcript coordinates, splicing, sequences and annotation text."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.functions import codons, coords
from strandwise.operators import features, tiling, transcripts
from strandwise.sources import gtf
from tests.conftest import rows_of

EXONS = "array<struct<start:bigint,end:bigint>>"


@pytest.fixture
def annotation(frame):
    e = [{"start": 100, "end": 110}, {"start": 200, "end": 220}]
    return frame(f"tx string, chrom string, strand string, exons {EXONS}", ("P", "c", "+", e), ("M", "c", "-", e))


def order(strand):
    bases = [*range(100, 110), *range(200, 220)]
    return bases if strand == "+" else bases[::-1]


def test_lifting_both_ways(annotation):
    p = annotation.withColumn("pos", F.explode(F.sequence(F.lit(95).cast("long"), F.lit(225).cast("long"))))
    t = p.select("strand", "pos", transcripts.genome_to_tx(F.col("pos"), F.col("exons"), F.col("strand")).alias("t"))
    for r in t.collect():
        bases = order(r.strand)
        assert r.t == (bases.index(r.pos) if r.pos in bases else None)
    q = annotation.withColumn("t", F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(31).cast("long"))))
    g = q.select("strand", "t", transcripts.tx_to_genome(F.col("t"), F.col("exons"), F.col("strand")).alias("pos"))
    for r in g.collect():
        assert r.pos == (order(r.strand)[r.t] if 0 <= r.t < 30 else None)


def test_cds_bounds_and_junctions(annotation):
    lo, hi = transcripts.cds_bounds(F.lit(105), F.lit(215), F.col("exons"), F.col("strand"))
    j = transcripts.junctions(F.col("exons"), F.col("strand"))
    got = {r.tx: (r.lo, r.hi, list(r.j)) for r in annotation.select("tx", lo.alias("lo"), hi.alias("hi"), j.alias("j")).collect()}
    assert got == {"P": (5, 25, [10]), "M": (5, 25, [20])}
    bad, _ = transcripts.cds_bounds(F.lit(150), F.lit(215), F.col("exons"), F.col("strand"))
    assert annotation.select(bad.alias("b")).where("b IS NOT NULL").count() == 0


def test_splice_and_base_table(frame, annotation):
    table = transcripts.exon_offsets(annotation, ["tx", "chrom"])
    bases = {(r.tx, r.tx_pos): r.pos for r in transcripts.base_table(table).collect()}
    assert all(bases[(t, i)] == p for t, s in (("P", "+"), ("M", "-")) for i, p in enumerate(order(s)))
    track = frame("chrom string, strand string, pos long, value double", ("c", "+", 105, 2.0), ("c", "-", 219, 3.0), ("c", "+", 150, 9.0))
    got = rows_of(transcripts.splice_track(track, table), "tx", "tx_pos", "value")
    assert got == [("M", 0, 3.0), ("P", 5, 2.0)]


def test_export_keeps_the_first_transcript(frame):
    v = frame("chrom string, strand string, pos long, tx long, value double", ("c", "+", 1, 5, 2.0), ("c", "+", 1, 3, 7.0))
    assert rows_of(transcripts.export_track(v, [], "tx"), "value") == [(7.0,)]


def test_regions(frame):
    df = frame("p long, a long, b long", (1, 5, 25), (5, 5, 25), (8, 5, 25), (9, 5, 25), (25, 5, 25), (3, None, None))
    got = [r.r for r in df.select("p", coords.region_of(F.col("p"), F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == ["utr5", "annotated", "cds_inframe", "cds_outframe", "other", "other"]


def test_enumerate_codons_over_chunks(frame):
    rng = np.random.default_rng(0)
    seq = "".join(rng.choice(list("ACGT"), 9001))
    seq = seq[:4010] + "N" + seq[4011:]
    got = rows_of(transcripts.enumerate_codons(frame("k string, seq string", ("a", seq), ("b", "AC"), ("c", "")), ["k"]), "k", "mrna_index", "codon")
    want = [("a", i, seq[i : i + 3]) for i in range(len(seq) - 2) if "N" not in seq[i : i + 3]]
    assert got == sorted(want, key=lambda t: tuple(map(str, t)))


def test_codons_are_counted_where_they_are_cut(frame):
    rng = np.random.default_rng(4)
    seq = "".join(rng.choice(list("ACGTN"), 9001, p=[0.3, 0.2, 0.2, 0.29, 0.01]))
    texts = [("a", seq), ("b", "AC"), ("c", ""), ("d", None), ("e", "ATGATGR")]
    places = [("a", int(i)) for i in rng.choice(9100, 3000, replace=False)] + [("e", 3), ("e", 3), ("e", -1), ("x", 0)]
    t, known = frame("k string, seq string", *texts), frame("k string, mrna_index int", *places)
    want = {}
    for k, s in texts:
        for i in range(len(s or "") - 2):
            if "N" not in s[i : i + 3]:
                n, at, hit = want.get((k, s[i : i + 3]), (0, 0, 0))
                want[k, s[i : i + 3]] = (n + 1, at + i, hit + ((k, i) in places))
    c = transcripts.codon_totals(t, ["k"], known).groupBy("k", "codon").agg(*[F.sum(x).alias(x) for x in ("n", "index_sum", "positives")])
    assert {(r.k, r.codon): tuple(r)[2:] for r in c.collect()} == want
    assert transcripts.codon_totals(t, ["k"]).where("positives > 0").count() == 0
    only = transcripts.enumerate_codons(t, ["k"], ["ATG", "TGR"]).where("k = 'e'")
    assert rows_of(only, "mrna_index", "codon") == [(0, "ATG"), (3, "ATG"), (4, "TGR")]


def test_a_text_is_cut_once(frame):
    """No filter on the explode's list repeats the cut below it."""
    t = frame("k string, text string", ("a", "ACGT")).repartition("k").select("k", F.upper("text").alias("seq"))
    plan = transcripts.chunk_sequence(t, ["k"], overlap=2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_sequence_windows_pad_and_reverse(frame):
    seq = "".join(np.random.default_rng(1).choice(list("ACGT"), 8100))
    chunks = transcripts.chunk_sequence(frame("k string, seq string", ("a", seq)), ["k"])
    req = [(0, -5, 6, "+"), (1, 3990, 4020, "-"), (2, 8090, 8110, "+"), (3, 3, 4, "+")]
    r = frame("i long, k string, start long, end long, strand string", *[(i, "a", a, b, s) for i, a, b, s in req])
    got = {x.i: x.seq for x in transcripts.fetch_windows(chunks, r, "k", ["i"]).collect()}
    comp = str.maketrans("ACGTN", "TGCAN")
    for i, a, b, s in req:
        want = "".join(seq[p] if 0 <= p < len(seq) else "N" for p in range(a, b))
        assert got[i] == (want if s == "+" else want.translate(comp)[::-1])


def test_orf_stops(frame):
    rng = np.random.default_rng(2)
    seq = "".join(rng.choice(list("ACGT"), 5000))
    c = transcripts.enumerate_codons(frame("k string, seq string", ("a", seq)), ["k"])
    got = {r.start: r.stop for r in features.orf_stops(c, ["k"], F.col("codon") == "ATG").collect()}
    for i in range(len(seq) - 2):
        if seq[i : i + 3] != "ATG":
            continue
        ends = [j + 3 for j in range(i, len(seq) - 2, 3) if seq[j : j + 3] in ("TAA", "TAG", "TGA")]
        assert got[i] == (ends[0] if ends else i + (len(seq) - i) // 3 * 3)


def test_codon_functions(frame):
    df = frame("c string", (" aug ",), ("CTG",), ("aag",), ("NTG",), ("AAA",))
    n = codons.normalize_codon(F.col("c"))
    got = [tuple(r) for r in df.select(n, codons.codon_class(n), codons.candidate_class(F.col("c")), codons.reverse_complement(F.col("c"))).collect()]
    assert got[1] == ("CTG", "other_near_cognate", "near_cognate", "CAG")
    assert got[2][:3] == ("AAG", "AAG", "near_cognate")
    assert got[3][:3] == (None, None, "non_cognate")
    assert got[0][:2] == ("ATG", "AUG")
    hot = df.where("c = 'NTG'").select(codons.one_hot(F.col("c")).alias("h"), codons.base_codes(F.col("c")).alias("b")).first()
    assert hot.h == [0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 1, 0]
    assert hot.b == [4, 3, 2]


def test_three_state_and_locus(frame):
    df = frame("v string", ("True",), ("0",), ("",), (None,), ("x",), ("1.0",), ("0.0",))
    got = [tuple(r) for r in df.select(coords.three_state(F.col("v")), coords.bad_flag(F.col("v"))).collect()]
    assert got == [(True, False), (False, False), (None, False), (None, False), (None, True), (True, False), (False, False)]
    lines = frame("c string", ("RPE1_Que",), ("K_1",), ("HeLa",)).select(coords.line_of(F.col("c")).alias("l"))
    assert [r.l for r in lines.collect()] == ["RPE1", "K_1", "HeLa"]
    one = frame("l string", ("chr1:10-13:-",)).select(coords.parse_locus(F.col("l")).alias("p")).first().p
    assert tuple(one) == ("chr1", 10, 13, "-", 12)


GTF = """#comment
c\ts\tgene\t101\t300\t.\t+\t.\tgene_id "G1";
c\ts\texon\t101\t160\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; gene_name "N1"; tag "MANE_Select";
c\ts\texon\t201\t290\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; gene_name "N1"; tag "MANE_Select";
c\ts\tCDS\t131\t160\t.\t+\t0\tgene_id "G1"; transcript_id "T1"; gene_name "N1"; tag "MANE_Select";
c\ts\texon\t101\t160\t.\t+\t.\tgene_id "G1"; transcript_id "T1b";
c\ts\texon\t501\t560\t.\t-\t.\tgene_id "G2"; transcript_id "T2"; tag "MANE_Select";
c\ts\tCDS\t521\t560\t.\t-\t0\tgene_id "G2"; transcript_id "T2"; tag "MANE_Select";
c\ts\texon\t501\t560\t.\t-\t.\tgene_id "G2"; transcript_id "T9"; tag "MANE_Select";
c\ts\tCDS\t521\t560\t.\t-\t0\tgene_id "G2"; transcript_id "T9"; tag "MANE_Select";
short\tline
"""


def test_annotation_text(spark, frame, tmp_path):
    (tmp_path / "a.gtf").write_text(GTF)
    rows = gtf.parse(gtf.read_lines(spark, str(tmp_path / "a.gtf")))
    models = {r.transcript_id: [tuple(e) for e in r.exons] for r in gtf.exon_models(rows).collect()}
    assert models["T1"] == [(100, 160), (200, 290)]
    assert set(models) == {"T1", "T1b", "T2", "T9"}
    keep = frame("transcript_id string", ("T2",))
    assert rows_of(gtf.exon_models(rows, keep), "transcript_id") == [("T2",)]
    assert rows_of(gtf.gene_spans(rows), "gene_id", "start", "end") == [("G1", 100, 300)]
    units = rows_of(gtf.units(rows), "gene_id", "transcript_id", "gene_name", "start", "end")
    assert units == [("G1", "T1", "N1", 100, 290), ("G2", "T2", "G2", 500, 560)]


def test_tiles(frame):
    c = frame("row_idx long, chrom string, gstart long, strand string", (0, "c", 150, "+"), (1, "c", 150, "+"), (2, "c", 151, "-"), (3, "c", 250, "+"))
    t = tiling.assign_tiles(c, 256, 100)
    got = {r.row_idx: (r.tile_start, r.offset) for r in t.collect()}
    assert got == {0: (72, 78), 1: (72, 78), 2: (72, 177), 3: (72, 178)}  # 1.5 and 2.5 round to 2
    r = tiling.position_requests(t, (0, 1), 256)
    plus = r.where("strand = '+'").select("position", "position_index").distinct()
    assert rows_of(plus) == [(178, 2), (179, 3), (78, 0), (79, 1)]


def test_exon_features(frame):
    df = frame("pos long, j array<bigint>, length long", (0, [10], 30), (10, [10], 30), (12, [10], 30), (5, [], 30))
    out = df.withColumns(features.exon_features(F.col("pos"), F.col("j"), F.col("length"))).collect()
    assert out[0].exon_index == 0 and out[0].first_exon == 1 and out[0].to_next_exon == pytest.approx(np.log1p(10) / 10)
    assert out[1].exon_index == pytest.approx(np.log1p(1) / 3) and out[1].from_exon_start == 0
    assert out[2].to_junction == pytest.approx(np.log1p(2) / 10)
    assert out[3].to_junction == pytest.approx(np.log1p(10000) / 10)


def test_dense_vectors_fill_zeros_and_move_rows_only(frame):
    rows = frame("tx long, tx_pos long, value double", (1, 2, 5.0), (1, 4, 1.0), (2, 0, 3.0))
    dense = transcripts.dense_vectors(rows, frame("tx long, length long", (1, 5), (2, 2), (3, 1), (4, 0)), "tx")
    want = {(1, 2): 5.0, (1, 4): 1.0, (2, 0): 3.0}
    places = [(1, i) for i in range(5)] + [(2, 0), (2, 1), (3, 0)]
    assert rows_of(dense, "tx", "tx_pos", "value") == [(t, i, want.get((t, i), 0.0)) for t, i in places]
    assert {r.length for r in dense.where("tx = 1").collect()} == {5}


def test_windows_in_overlapping_chunks(frame):
    text = "ACGTTGCAAC" * 3
    s = frame("k long, seq string", (1, text), (2, "AC"))
    asked = [(k, a, a + 7, "+-"[a % 2]) for k, n in ((1, 30), (2, 2)) for a in range(-3, n)]
    req = frame("id long, k long, start long, end long, strand string", *[(i, *r) for i, r in enumerate(asked)])
    one = transcripts.fetch_windows(transcripts.chunk_sequence(s, ["k"], size=8, overlap=6), req, "k", ["id"], size=8, overlap=6)
    many = transcripts.fetch_windows(transcripts.chunk_sequence(s, ["k"], size=8), req, "k", ["id"], size=8)
    assert rows_of(one, "id", "seq") == rows_of(many, "id", "seq")
    assert "Aggregate" not in one._jdf.queryExecution().optimizedPlan().toString()


def test_window_requests_move_as_runs(frame):
    """Requests that follow each other in a chunk are one row where they are joined; nulls and repeats stay as they are."""
    s = frame("k long, seq string", (1, "ACGTTGCAAC" * 30), (2, "ACGT"))
    asked = [(None if i == 5 else i, f"t{i % 3}" if i != 7 else None, i / 2, k, i, i + 5, "+-"[i % 2]) for k, n in ((1, 290), (2, 4), (3, 2)) for i in range(-2, n)]
    req = frame("id long, name string, x double, k long, start long, end long, strand string", *asked)
    got = transcripts.fetch_windows(transcripts.chunk_sequence(s, ["k"], size=50, overlap=6), req, "k", ["id", "name", "x"], size=50, overlap=6)
    text = {1: "ACGTTGCAAC" * 30, 2: "ACGT", 3: ""}
    flip = str.maketrans("ACGTN", "TGCAN")

    def cut(k, a, b, strand):
        own = "".join(text[k][p] if 0 <= p < len(text[k]) else "N" for p in range(a, b))
        return own if strand == "+" else own.translate(flip)[::-1]

    want = [(*r, cut(*r[3:])) for r in asked]
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    runs, _ = transcripts._in_runs(req.withColumn("_c", F.floor(F.greatest(F.col("start"), F.lit(0)) / 50)), ["k", "_c"])
    assert runs.count() < 40 < len(asked)
