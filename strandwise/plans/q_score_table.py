"""Score tables of several sources over spliced tracks: peak rows, scorecard, wide row and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.operators import concordance, features, score_table
from strandwise.plans.q_concordance import ALLSCALES, LONGCARD, PERCENT, SITES, R, rounded, scored_rows, sites, unit_lists, unit_rows, units, units_of
from strandwise.plans.registry import query
from strandwise.session import durable

#: Sources to score: columns of the spliced rows.
SOURCES = ["mixed", "pred"]
LIMITS = {"min_reads": 2, "min_frame_reads": 1, "min_orf_reads": 3.0, "top_reads": 5.0, "pause_reads": 1.0, "pause_height": 3.0}
SHOWN = {"real": "pooled", "mixed": "mixed", "pred": "pred"}
DRAWN = ("top1_resampled", "chx_pause_pred", "chx_pause_ratio")
#: Every nineteenth base, in an order of the transcript's own, opens a stop codon.
STOPS = "(tx * 7 + {p}) % 19 = 0"


def with_pred(rows):
    return rows.withColumn("pred", F.col("rep1") + (F.col("tx_pos") % 5) / 8.0)


def spliced(spark, sf):
    return with_pred(scored_rows(spark, sf))


def sites_with_stops(rows, u):
    """Sites with the end of the frame they open; stops come from each transcript's codons."""
    s = sites((rows, u)).select("site_id", "condition", "tx", "tx_pos", "codon", "utr5")
    p = F.explode(F.expr("sequence(0L, length - 3)"))
    bases = u.where("length >= 3").select("tx", "length").distinct().withColumn("mrna_index", p)
    starts = s.where("utr5").select("tx", F.col("tx_pos").alias("mrna_index")).distinct().withColumn("_start", F.lit(True))
    codons = bases.withColumn("codon", F.when(F.expr(STOPS.format(p="mrna_index")), "TAA").otherwise("CTG"))
    codons = codons.join(starts, ["tx", "mrna_index"], "left")
    stops = features.orf_stops(codons, ["tx"], F.coalesce(F.col("_start"), F.lit(False)))
    s = s.join(stops.select("tx", F.col("start").alias("tx_pos"), "stop"), ["tx", "tx_pos"], "left")
    return s.withColumn("stop", F.coalesce("stop", "tx_pos"))


def tables(spark, sf):
    rows, u = durable(spliced(spark, sf), "spliced"), durable(units(spark, sf), "units")
    return score_table.score_table(rows, u, sites_with_stops(rows, u), SOURCES, heldout=("C0",), **LIMITS)


def _side(source: str) -> str:
    v = SHOWN[source]
    rep = "rep1" if source == "real" else v
    share = lambda tag: f"CASE WHEN {tag}total_{v} > 0 THEN coalesce({tag}centre_{v}, 0) / {tag}total_{v} END"
    at0 = lambda tag: f"CASE WHEN {tag}total_{v} > 0 THEN ({tag}arg_{v} = 0)::INT END"
    hit = lambda c: f"coalesce(abs(arg_{c}) <= 1, false)"
    return f"""SELECT condition, '{source}' AS source, is_atg, region, in_cds, utr5, {share('')} AS share, {at0('')} AS argmax, {share('near_')} AS near, {at0('near_')} AS near0,
      {hit(rep)} AS hit, {hit('rep1')} AS hit1, {hit('rep2')} AS hit2, orf_{v} AS orf FROM s JOIN st USING (site_id) LEFT JOIN orf USING (site_id)"""


def _stats() -> str:
    out = []
    for v in ("pooled", "rep1", "rep2", "mixed", "pred"):
        for reach, tag in ((30, ""), (15, "near_")):
            held = f"{v} > 0 AND abs(o) <= {reach}"
            out += [f"sum({v}) FILTER ({held}) AS {tag}total_{v}", f"sum({v}) FILTER ({held} AND o = 0) AS {tag}centre_{v}", f"arg_min(o, (-{v}, o)) FILTER ({held}) AS {tag}arg_{v}"]
    return ", ".join(out)


def _peak_columns() -> dict[str, str]:
    """Column to its SQL over ``each``, the ratios apart."""
    mean = lambda value, where: f"avg(({value})::DOUBLE) FILTER ({where})"
    out = {"meta_share": "avg(share)", "argmax0": "avg(argmax)", "sites": "count(share)"}
    classes = {"atg": "is_atg", "nc": "NOT is_atg"}
    for c, of in classes.items():
        out |= {f"meta_share_{c}": mean("share", of), f"argmax0_{c}": mean("argmax", of), f"sites_{c}": f"count(share) FILTER ({of})"}
        for part, mask in (("", "TRUE"), ("_incds", "in_cds"), ("_outcds", "NOT in_cds")):
            for region in score_table.REGIONS:
                where = f"{of} AND hit2 AND {mask}" + (f" AND region = '{region[1:]}'" if region else "")
                key = f"{c}{region}{part}"
                out |= {f"rep_hit_{key}": mean("hit", where), f"rep_ref_{key}": mean("hit1", where), f"rep_n_{key}": f"count(*) FILTER ({where})"}
                out[f"rep_ratio_{key}"] = f"{mean('hit', where)} / nullif({mean('hit1', where)}, 0)"
        out[f"rep_both_{c}"] = mean("hit", f"{of} AND hit1 AND hit2")
    out |= {"utr5_tis_rep_hit": mean("hit", "utr5 AND hit2"), "utr5_tis_rep_ref": mean("hit1", "utr5 AND hit2"), "utr5_tis_rep_n": "count(*) FILTER (utr5 AND hit2)"}
    out["utr5_tis_rep_ratio"] = f"{mean('hit', 'utr5 AND hit2')} / nullif({mean('hit1', 'utr5 AND hit2')}, 0)"
    out |= {"utr5_orf_frame": mean("orf", "utr5"), "utr5_orf_framed": mean("orf > 0.5", "utr5"), "utr5_orf_n": "count(orf) FILTER (utr5)"}
    for c, of in (classes | {"utr5": "utr5"}).items():
        out |= {f"sharp_share15_{c}": mean("near", of), f"sharp_argmax15_{c}": mean("near0", of), f"sharp_n_{c}": f"count(near) FILTER ({of})"}
    return out


COUNTED = ("sites", "rep_n_", "utr5_tis_rep_n", "utr5_orf_n", "sharp_n_", "top1_n", "chx_pause_n")
PEAK_COLUMNS = _peak_columns()
OUTER = [*PEAK_COLUMNS, "top1", "top1_n", "chx_pause_ref", "chx_pause_n"]


def is_count(column: str) -> bool:
    return column.startswith(COUNTED)


HEIGHT = "CASE WHEN sum({c}) OVER w > 0 THEN {c} / (sum({c}) OVER w / 61) ELSE 0 END"
TABLES = f"""{SITES},
src AS (SELECT *, rep1 + (tx_pos % 5) / 8.0::DOUBLE AS pred FROM k),
stops AS (SELECT s.site_id, CASE WHEN count(q.p) > 0 THEN min(q.p) + 3 ELSE any_value(s.tx_pos + (s.length - s.tx_pos) // 3 * 3) END AS stop
  FROM s LEFT JOIN (SELECT tx, p FROM (SELECT tx, unnest(range(0, length - 2)) AS p FROM tx) WHERE {STOPS.format(p='p')}) q ON q.tx = s.tx AND q.p >= s.tx_pos AND (q.p - s.tx_pos) % 3 = 0
  WHERE s.utr5 GROUP BY s.site_id),
x AS (SELECT s.site_id, c.tx_pos - s.tx_pos AS o, c.pooled, c.rep1, c.rep2, c.mixed, c.pred FROM s JOIN src c ON c.condition = s.condition AND c.tx = s.tx AND c.library = 'tis' AND abs(c.tx_pos - s.tx_pos) <= 30),
st AS (SELECT site_id, {_stats()} FROM x GROUP BY site_id HAVING sum(pooled) > 0),
orf AS (SELECT s.site_id, {", ".join(f"coalesce(sum({v}) FILTER ((c.tx_pos - s.tx_pos) % 3 = 0), 0) / nullif(sum({v}), 0) AS orf_{v}" for v in ("pooled", "mixed", "pred"))}
  FROM s JOIN stops USING (site_id) JOIN src c ON c.condition = s.condition AND c.tx = s.tx AND c.library = 'chx' AND c.tx_pos >= s.tx_pos AND c.tx_pos < stop GROUP BY s.site_id HAVING sum(c.pooled) >= 3),
each AS ({" UNION ALL ".join(map(_side, SHOWN))}),
peak AS (SELECT condition, source, {", ".join(f"{sql} AS {name}" for name, sql in PEAK_COLUMNS.items())} FROM each GROUP BY ALL),
ranked AS (SELECT condition, tx, source, v, length, row_number() OVER (PARTITION BY condition, tx, source ORDER BY v DESC) AS r FROM (
  SELECT condition, tx, length, unnest(['real', 'mixed', 'pred']) AS source, unnest([pooled::DOUBLE, mixed::DOUBLE, pred]) AS v FROM src WHERE library = 'tis')),
enough AS (SELECT condition, tx FROM src WHERE library = 'tis' GROUP BY ALL HAVING sum(pooled) >= 5),
tops AS (SELECT condition, source, avg(share) AS top1, count(*) AS top1_n FROM (
  SELECT condition, tx, source, sum(v) FILTER (r <= greatest(1, ceil(0.01 * length))) / sum(v) AS share FROM ranked JOIN enough USING (condition, tx) GROUP BY ALL) GROUP BY ALL),
heights AS (SELECT *, {HEIGHT.format(c='rep1')} AS h1, {HEIGHT.format(c='rep2')} AS h2 FROM src WHERE library = 'chx' WINDOW w AS (PARTITION BY condition, tx ORDER BY tx_pos RANGE BETWEEN 30 PRECEDING AND 30 FOLLOWING)),
pauses AS (SELECT condition, avg(h1) AS chx_pause_ref, count(*) AS chx_pause_n FROM heights WHERE tx_pos >= cds_start + 30 AND tx_pos < cds_end - 30 AND rep2 >= 1 AND h2 >= 3 GROUP BY ALL),
whole AS (SELECT p.*, t.top1, coalesce(t.top1_n, 0) AS top1_n, u.chx_pause_ref, coalesce(u.chx_pause_n, 0) AS chx_pause_n FROM peak p LEFT JOIN tops t USING (condition, source) LEFT JOIN pauses u USING (condition))"""


@query(
    "transcript_score_table",
    f"WITH {TABLES} SELECT condition, source, " + ", ".join(f"{c}::BIGINT AS {c}" if is_count(c) else f"round({c}, {R}) AS {c}" for c in OUTER) + " FROM whole",
    "txtrack tx expression",
)
def _(spark, sf):
    _, peaks = tables(spark, sf)
    return peaks.select("condition", "source", *[F.col(c).cast("long").alias(c) if is_count(c) else F.round(c, R).alias(c) for c in OUTER])


@query(
    "heldout_scorecard",
    f"WITH {SITES}, {ALLSCALES}, {LONGCARD} SELECT condition, condition = 'C0' AS heldout, library, source, scale, round(value, {R}) AS value, round(yardstick, {R}) AS yardstick, n, round({PERCENT}, 4) AS percent FROM card WHERE source = 'mixed'",
    "txtrack tx expression",
)
def _(spark, sf):
    # the scorecard alone: peaks and draws have queries of their own
    lists = durable(unit_lists(spark, sf), "units")
    fact = concordance.spliced_fact(unit_rows(spark, sf, lists=lists))
    card = score_table.card_of(fact, units_of(lists), ["mixed"], heldout=("C0",), min_reads=LIMITS["min_reads"], min_frame_reads=LIMITS["min_frame_reads"])
    return rounded(card.where("source = 'mixed'"), "value", "yardstick").withColumn("percent", F.round("percent", 4))


CONDITIONS = ("C0", "C1", "C2")


CELLS = score_table.cells([*OUTER, *DRAWN])
#: Columns without draws.
WIDE = [n for n in score_table.result_columns(CONDITIONS) if CELLS.get(n.split("_", 1)[1], ("", False))[0] not in DRAWN]
CARD_NAMES = [n for n in WIDE if n.split("_", 1)[1] not in CELLS]
CARD_CELLS = ", ".join(f"round(max(cell) FILTER (name = '{n}'), 4) AS {n}" for n in CARD_NAMES)
def _wide_sql() -> str:
    """The wide row's columns from the peak rows of the source and of ``real``, and from the card."""
    out = []
    for name in WIDE:
        condition, rest = name.split("_", 1)
        if rest in CELLS:
            column, real = CELLS[rest]
            out.append(f"round(max({column}) FILTER (condition = '{condition}' AND source = '{'real' if real else 'mixed'}'), {R})::DOUBLE AS {name}")
    return ", ".join(out)


PRIMARIES = """round(("C0_tis_codon" + "C0_tis_nt") / 2, 4) AS "primary", round(("C0_tis_nt" + 100 * least(1, "C0_tis_peak_argmax0_nc" / nullif("C0_tis_peak_argmax0_nc_real", 0))) / 2, 4) AS primary2,
  round(("C0_tis_nt" + 100 * least(1, "C0_tis_rep_hit_nc" / nullif("C0_tis_rep_ref_nc", 0))) / 2, 4) AS primary3"""


@query(
    "wide_results_primaries",
    f"""WITH {TABLES}, {ALLSCALES}, {LONGCARD}, cells AS (SELECT condition || '_' || library || '_' || scale AS name, CASE WHEN scale = 'frame' THEN value ELSE {PERCENT} END AS cell FROM card WHERE source = 'mixed'),
    of_card AS (SELECT {CARD_CELLS} FROM cells), of_peaks AS (SELECT {_wide_sql()} FROM whole)
    SELECT 'mixed' AS source, *, {PRIMARIES} FROM of_card, of_peaks""",
    "txtrack tx expression",
)
def _(spark, sf):
    card, peaks = tables(spark, sf)
    wide = score_table.wide_rows(card, peaks, SOURCES, CONDITIONS, "C0").where("source = 'mixed'")
    digits = lambda c: 4 if c in CARD_NAMES or c.startswith("primary") else R
    return wide.select("source", *[F.round(c, digits(c)).alias(c) for c in ("primary", "primary2", "primary3", *WIDE)])


@query(
    "transcript_draw_facts",
    f"""WITH {TABLES}, t AS (SELECT condition, tx, sum(pooled) AS reads, sum(mixed) AS mixed, sum(pred) AS pred, count(*) FILTER (mixed > 0) AS n_mixed, count(*) FILTER (pred > 0) AS n_pred
      FROM src WHERE library = 'tis' GROUP BY ALL HAVING sum(pooled) >= 5)
    SELECT condition, unnest(['mixed', 'pred']) AS source, unnest([sum(CASE WHEN mixed > 0 THEN reads END), sum(CASE WHEN pred > 0 THEN reads END)])::BIGINT AS drawn,
      unnest([count(*) FILTER (mixed > 0), count(*) FILTER (pred > 0)]) AS transcripts, true AS shares_fit FROM t GROUP BY condition""",
    "txtrack tx expression",
)
def _(spark, sf):
    # rows of units stay where their transcript's exons are, so neither rows nor units are written
    draws = score_table.transcript_draws(with_pred(unit_rows(spark, sf)), SOURCES, min_reads=5.0, pause_reads=1.0, pause_height=3.0)
    # a share of the top places is at least that of one read, and at most all
    fits = (F.col("top1_resampled") * F.col("reads") >= 1 - 1e-9) & (F.col("top1_resampled") <= 1) & (F.col("drawn") == F.col("reads"))
    kept = draws.where("source <> 'real' AND drawn IS NOT NULL")
    return kept.groupBy("condition", "source").agg(F.sum("drawn").alias("drawn"), F.count(F.lit(1)).alias("transcripts"), F.bool_and(fits).alias("shares_fit"))
