"""The registered queries: contract, plans and one check against SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from strandwise.plans import catalog
from strandwise.plans import surrogates as sv

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "lineitem", "orders", "events", "embeddings", "documents", "part")
CHECKED = ("start_precision_recall", "merge_spans", "gene_track_totals", "recall_at_fp_budget", "spliced_offsets")


def test_contract(spark):
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names)
    assert len([n for n in catalog.QUERIES if n not in sql]) <= 5
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = duck.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert tidy(df.collect()) == tidy(want)


@pytest.mark.parametrize("name", ["top_k_calls", "merge_spans", "points_in_region", "gene_track_totals", "near_neighbour_pairs", "assign_windows", "spliced_track"])
def test_no_nested_loop_or_cartesian(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    assert "Cartesian" not in plan


def test_scan_reads_only_what_it_needs(spark):
    df = sv.candidates(spark, SF).where("condition = 'R'").select("gpos", "score")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in plan
    assert "l_shipdate" not in plan


def test_top_k_limits_before_the_shuffle(spark):
    plan = entry.queries()["top_k_calls"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_calls_are_aligned_by_transcript_and_place(spark, frame, tmp_path):
    """Places beyond a million share a ``row_idx`` with other transcripts."""
    schema = "l_orderkey long, l_partkey long, l_extendedprice double, l_returnflag string, l_linenumber int"
    frame(schema, (0, 1_000_002, 100.0, "A", 1), (16, 2, 100.0, "R", 1)).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert catalog.QUERIES["calls_alignment_check"](spark, str(tmp_path)).first()["n_matched"] == 2


def test_texts_without_a_base_have_no_composition(spark, frame, tmp_path):
    frame("doc_id long, text string", (1, "12 34"), (2, ""), (3, None), (4, "aac")).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["base_composition_codes"](spark, str(tmp_path))
    assert sorted((r["doc_id"], r["code"], r["n"], r["at"]) for r in got.collect()) == [(4, 0, 2, 1), (4, 1, 1, 2)]
