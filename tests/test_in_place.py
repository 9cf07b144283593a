"""Steps that leave a transcript's rows in their partition, against the joins they stand for."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandwise.operators import concordance, peaks, reports, resample, score_table, transcripts

SF = "/root/testdata/sf0.001"
ROWS = "condition string, library string, tx long, tx_pos long, value double, rep1 double, rep2 double, length long, cds_start long, cds_end long"


def table(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = []
    for c in ("C0", "C1"):
        for lib in ("tis", "chx", "rna"):
            for tx in range(1, 5):
                for p in sorted(rng.sample(range(150), 60)):
                    a, b = float(rng.randrange(4)), float(rng.randrange(4))
                    out.append((c, lib, tx, p, a + b, a, b, 150, 30, 120))
    return spark.createDataFrame(out, ROWS).cache()


def test_windows_are_the_profiles(rows):
    t = rows.where("library = 'tis'")
    sites = t.where("value >= 2").withColumn("site_id", F.concat_ws("_", "condition", "tx", "tx_pos"))
    profiles = peaks.site_profiles(sites.select("site_id", "condition", "tx", "tx_pos"), t.select("condition", "tx", "tx_pos", "value", "rep1", "rep2"))
    at = peaks.hits_at(peaks.windows_at(t, F.col("value") >= 2, ["value", "rep1", "rep2"]), ["rep1", "rep2"])
    at = at.withColumn("site_id", F.concat_ws("_", "condition", "tx", "tx_pos"))
    names = ["site_id", "share", "argmax"]
    assert table(peaks.peaks_at(at, "rep1").select(names)) == table(peaks.site_peaks(profiles, "rep1").select(names))
    assert table(at.select("site_id", "hit_rep1", "hit_rep2")) == table(peaks.site_hits(profiles, ["rep1", "rep2"]))


def test_frames_are_the_sums_of_their_rows(rows):
    both = rows.where("library <> 'rna'")
    tis = F.col("library") == "tis"
    stop = F.when(F.col("tx_pos") % 2 == 0, F.col("tx_pos") + 33).otherwise(F.col("tx_pos"))
    got = peaks.frames_at(both, tis & (F.col("value") >= 2), stop, F.when(tis, 0.0).otherwise(F.col("value")), 12.0)
    orfs = both.where(tis & (F.col("value") >= 2)).select(F.concat_ws("_", "condition", "tx", "tx_pos").alias("site_id"), "condition", "tx", F.col("tx_pos").alias("start"), stop.alias("stop"))
    want = peaks.orf_frame(both.where(~tis).select("condition", "tx", "tx_pos", "value"), orfs, "value", 12.0).where("reads > 0")
    got = got.where("reads > 0").select(F.concat_ws("_", "condition", "tx", "start").alias("site_id"), "reads", "orf_frame")
    assert table(got) == table(want) and got.where("orf_frame IS NULL").count() and got.where("orf_frame > 0").count()


@pytest.mark.parametrize("scale", ["nt", "codon"])
def test_unit_correlations_are_those_of_the_joins(rows, scale):
    units = rows.select("condition", "tx", "length", "cds_start", "cds_end").distinct()
    want = concordance.unit_pearson(rows.drop("length", "cds_start", "cds_end"), units, ["value"], [scale], 2)
    got = concordance.unit_correlations(rows, ["value"], scale, 2)
    assert table(got.select(want.columns)) == table(want)


def test_rna_comparator_without_a_join(spark, rows):
    scalars = spark.createDataFrame([("C0", "tis", 2.0), ("C0", "chx", 3.0), ("C1", "tis", 0.5)], "evaluated string, library string, scalar double")
    cpm = spark.createDataFrame([("C0", 4e6), ("C1", 5e6)], "condition string, genome_total double")
    keys = ["condition", "library", "tx", "tx_pos"]
    want = reports.rna_scaled(rows.where("library <> 'rna'").select(*keys, "rep1", "rep2"), rows.where("library = 'rna'").select("condition", "tx", "tx_pos", "value"), scalars, cpm)
    got = reports.rna_scaled_in_place(rows, scalars, cpm).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("rep1", "rep2", "rna_scaled")])
    assert table(got.select(want.columns)) == table(want)


def test_depth_of_a_column_is_that_of_a_table(rows):
    t = rows.where("library = 'tis'").select("condition", "tx", "tx_pos", "value", "rep1")
    depth = t.groupBy("condition", "tx").agg(F.sum("rep1").alias("reads"))
    got = resample.draw_to_depth(t, "rep1", 4)
    assert table(got) == table(resample.draw_to_depth(t, depth, 4)) and got.where("expected <= 0").count() == 0
    assert table(got.groupBy("condition", "tx").agg(F.sum("value"))) == table(depth)


def test_channels_travel_with_their_position(spark):
    track = spark.createDataFrame([(c, "chr7", s, p, float(p)) for c in ("C0", "C1") for s in "+-" for p in range(0, 400, 7)], "condition string, chrom string, strand string, pos long, value double")
    exons = spark.createDataFrame([(1, "chr7", "+", 10, 300, 0, 290), (2, "chr7", "-", 250, 262, 5, 20)], "tx long, chrom string, strand string, start long, end long, off long, length long")
    names = ["condition", "tx", "pos", "tx_pos", "value"]
    assert table(transcripts.splice_channels(track, exons).select(names)) == table(transcripts.splice_track(track, exons).select(names))


@pytest.mark.parametrize("name", ["peak_summary", "replicate_hit_rates", "unit_pearson_codon", "percent_of_yardstick", "top_share"])
def test_spliced_rows_are_not_moved(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and ("tx_pos" in line or "condition#" in line.split("],")[0] and "tx#" in line)]
    assert not moved


def test_examples_in_place_are_those_of_the_joins(spark):
    names = ["condition", "library", "chrom", "strand", "pos", "value"]
    pooled = spark.createDataFrame([(c, lib, "chr7", "+", p, float(p + len(lib))) for c in ("C0", "C1", "C3") for lib in ("tis", "chx", "rna") for p in range(0, 30, 3)], ", ".join(f"{n} {t}" for n, t in zip(names, ["string"] * 4 + ["long", "double"], strict=True)))
    bases = spark.createDataFrame([(1, 5, "chr7", "+", p, p - 10, 0.5) for p in range(10, 25)], "tx long, gene long, chrom string, strand string, pos long, tx_pos long, f double")
    states = spark.createDataFrame([(5, "C0", True), (5, "C1", False), (5, "C2", True)], "gene long, condition string, expressed boolean")
    scale = spark.createDataFrame([("C0", 2.0), ("C1", 3.0), ("C2", 1.0)], "condition string, scale double")
    listed = bases.join(states.groupBy("gene").agg(F.collect_list(F.struct("condition", "expressed")).alias("conditions")), "gene")
    want = reports.examples(bases, pooled, states, scale, ["f"])
    assert table(reports.examples_in_place(listed, pooled, scale, ["f"]).select(want.columns)) == table(want)


def test_held_out_card_makes_no_peaks(spark, monkeypatch):
    def refuse(*args, **kwargs):
        raise AssertionError("the scorecard needs no site windows")

    monkeypatch.setattr(score_table, "site_stats", refuse)
    assert entry.queries()["heldout_scorecard"](spark, SF).columns[0] == "condition"
