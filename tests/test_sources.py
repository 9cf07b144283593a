"""Readers, writers, count files and sample sheets."""

import pytest

from strandwise.operators import reports
from strandwise.operators.quality import QualityError
from strandwise.session import durable, shared_folder
from strandwise.sources import gtf, tables
from tests.conftest import rows_of


def test_read_table(spark, frame, tmp_path):
    df = frame("a long, b string", (1, "x"), (2, None))
    df.write.parquet(str(tmp_path / "t.parquet"))
    assert rows_of(tables.read_table(spark, str(tmp_path / "t.parquet"))) == rows_of(df)
    tables.write_tsv(df, str(tmp_path / "t.tsv"))
    back = tables.read_table(spark, str(tmp_path / "t.tsv"), "a long, b string")
    assert rows_of(back) == [(1, "x"), (2, "nan")]
    with pytest.raises(TypeError):
        tables.read_table(spark, 5)


def test_rename_project_drops_unmapped(frame):
    df = frame("a long, junk long, b long", (1, 2, 3))
    assert tables.rename_project(df, {"b": "y", "none": "z", "a": "x"}).columns == ["y", "x"]


def test_count_files(frame):
    s = frame("sample_id string", ("A_L1",), ("B_L1",), ("C_L1",), ("D_L1",))
    names = ("A_L1", "A_L2", "B_L2", "C_L2", "C_L3")
    f = frame("file string", *[(n + "_htseqcount.txt",) for n in names])
    got = {r.sample_id: (r.status, r.file) for r in tables.resolve_count_files(s, f).collect()}
    assert got == {
        "A_L1": ("exact", "A_L1_htseqcount.txt"), "B_L1": ("lane", "B_L2_htseqcount.txt"),
        "C_L1": ("ambiguous", None), "D_L1": ("missing", None),
    }


def test_gene_counts(frame):
    t = frame("text string", ("G1\t5",), ("__no_feature\t9",))
    assert rows_of(tables.gene_counts(t)) == [("G1", 5)]


SHEET = "cell_line string, condition string, treatment string, type string, rep string, sample_id string, bam_path string"


def full_sheet():
    lines = [("HeLa", "x"), ("K562", "x"), ("U2OS", "x"), ("RPE1", "Async"), ("RPE1", "Quiescent"), ("RPE1", "Senescent")]
    kinds = [("TIS", "RPF"), ("CHX", "RPF"), ("TIS", "Input")]
    return [
        (c, s, t, k, f"{r}.0", f"{c}{s}{t}{k}{r}", "p.bam") for c, s in lines for t, k in kinds for r in (1, 2)
    ] + [("K562", "x", "TIS", "RPF", "1", "blank", " "), ("K562", "x", "CHX", "Input", "1", "other", "p.bam")]


def test_sample_sheet(frame):
    sheet = frame(SHEET, *full_sheet())
    new = frame("sample_id string, bam string", ("K562xTISRPF1", "new.bam"))
    s = tables.load_samples(sheet, new)
    tables.require_full_sheet(s, new)
    assert s.count() == 36
    assert s.where("bam = 'new.bam'").first().condition == "K562"
    assert s.where("condition = 'RPE1_Que'").count() == 6
    with pytest.raises(QualityError, match="expected 36"):
        tables.require_full_sheet(s.where("rep = 1"))
    with pytest.raises(QualityError, match="unknown sample_id"):
        tables.require_full_sheet(s, frame("sample_id string, bam string", ("zz", "b")))


def test_append_evolving(spark, frame, tmp_path):
    path = str(tmp_path / "r")
    tables.append_evolving(spark, path, frame("a long", (1,)))
    got = tables.append_evolving(spark, path, frame("a long, b double", (2, 0.5)))
    assert got.columns == ["a", "b"]
    assert rows_of(got) == [(1, None), (2, 0.5)]


def test_track_round_trip(spark, frame, tmp_path):
    t = frame("library string, chrom string, pos long, value double", ("x", "c", 5, 1.0), ("x", "d", 1, 2.0))
    tables.write_track(t, str(tmp_path / "t"), ["library", "chrom"])
    back = spark.read.parquet(str(tmp_path / "t")).select(*t.columns)
    assert rows_of(back) == rows_of(t)


def test_durable(spark, frame):
    df = frame("a long", (1,), (2,))
    assert rows_of(durable(df, "t")) == [(1,), (2,)]
    assert shared_folder(spark) == shared_folder(spark)


def test_shared_folder_of_a_cluster_must_be_set():
    class Unset:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"
        getConf = Unset

    class Session:
        conf, sparkContext = Unset(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_read_lines_keep_the_order_of_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.gtf").write_text("".join(f"{i}-{j}\n" for j in range(4)))
    rows = gtf.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r.text for r in rows] == [f"{i}-{j}" for i in range(3) for j in range(4)]


def test_stored_run_needs_one_row(frame):
    m = frame("arm string, seed string, metric string, value double", ("a", "ensemble", "auprc", 0.5), ("a", "ensemble", "auprc", 0.6))
    s = frame("arm string, stratum string, metric string, value double", ("a", "AUG", "auprc", 0.7))
    c = frame("arm string, metric string, ci_low double, ci_high double", ("a", "auprc", 0.4, 0.6))
    assert {r.problem for r in reports.stored_run(m, s, c, "a").collect()} == {"not_one_ensemble_row"}
    one = reports.stored_run(m.where("value = 0.5"), s, c, "a")
    assert rows_of(one, "stratum", "value", "ci_low", "problem") == [("AUG", 0.7, None, None), ("all", 0.5, 0.4, None)]
