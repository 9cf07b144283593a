"""Feature tables, linear heads, sampling and resampling."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from strandwise.functions import arrays
from strandwise.operators import evaluation, isotonic, quality, resample, sampling, scoring, tracks
from strandwise.plans import surrogates as sv
from strandwise.plans.q_intervals import gene_table
from strandwise.plans.q_tracks import IN_REGION, PLACED, REGION, placed, pooled, region, track
from strandwise.plans.q_transcripts import txtrack
from strandwise.plans.registry import query
from strandwise.session import shared_folder
from strandwise.sources import features as store

R = 6
WIDTH = 64
HALF = 32
XS = (0.1, 0.3, 0.5, 0.7, 0.9)
YS = (0.05, 0.2, 0.4, 0.8, 0.95)


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, R) for c in cols})


def coefficients(seed: int) -> list[float]:
    """Fixed coefficients by rule: ``((7 j + 13 seed) mod 11 - 5) / 4``."""
    return [((7 * j + 13 * seed) % 11 - 5) / 4 for j in range(1, WIDTH + 1)]


def heads():
    out = []
    for s in (1, 2, 3):
        c = coefficients(s)
        out.append(scoring.Head({"a": c[:HALF], "b": c[HALF:]}, 0.1 * s, XS, YS, 0.6))
    return out


def blocks(spark, sf):
    f = sv.features(spark, sf)
    a = f.select("row_idx", "label", F.slice("features", 1, HALF).alias("v"))
    b = f.select("row_idx", F.slice("features", HALF + 1, HALF).alias("v"))
    return {"a": a, "b": b}


def knots(p):
    """Isotonic interpolation in SQL."""
    out = f"CASE WHEN {p} <= {XS[0]} THEN {YS[0]} WHEN {p} >= {XS[-1]} THEN {YS[-1]} "
    for i in range(4):
        out += f"WHEN {p} < {XS[i + 1]} THEN {YS[i]} + ({YS[i + 1]} - {YS[i]}) * ({p} - {XS[i]}) / ({XS[i + 1]} - {XS[i]}) "
    return f"({out} END)::DOUBLE"


LOGITS = """z AS (SELECT row_idx, label, s, list_sum(list_transform(range(1, 33), lambda j: features[j]::DOUBLE * (((7 * j + 13 * s) % 11 - 5) / 4.0::DOUBLE))) AS za,
   list_sum(list_transform(range(33, 65), lambda j: features[j]::DOUBLE * (((7 * j + 13 * s) % 11 - 5) / 4.0::DOUBLE))) AS zb
  FROM feats, unnest([1, 2, 3]) u(s)),
pr AS (SELECT row_idx, label, s, 1 / (1 + exp(-(za + zb + 0.1 * s))) AS p, 1 / (1 + exp(-(za + zb + 0.1 * s - 0.001))) AS pl, 1 / (1 + exp(-(za + zb + 0.1 * s + 0.001))) AS ph FROM z)"""
ENS = f"ens AS (SELECT row_idx, label, avg({knots('p')}) AS p, avg({knots('pl')}) AS p_low, avg({knots('ph')}) AS p_high FROM pr GROUP BY ALL)"


def ensemble(spark, sf):
    return scoring.ensemble_scores(blocks(spark, sf), {"a": "v", "b": "v"}, heads(), "row_idx")


@query("partial_logits", f"WITH {LOGITS} SELECT row_idx, s - 1 AS head, round(za, {R}) AS logit FROM z", "feats")
def _(spark, sf):
    p = scoring.partial_logits(blocks(spark, sf)["a"], heads(), "a", "v")
    pair = [F.struct(F.lit(i).cast("long").alias("head"), F.round(f"a_{i}", R).alias("logit")) for i in range(3)]
    return p.select("row_idx", F.inline(F.array(*pair)))


@query(
    "partial_logits_by_expression",
    f"WITH {LOGITS} SELECT row_idx, round(za + zb, {R}) AS logit FROM z WHERE s = 2",
    "feats",
)
def _(spark, sf):
    z = arrays.dot(F.col("features"), arrays.literal_array(coefficients(2)))
    return sv.features(spark, sf).select("row_idx", F.round(z, R).alias("logit"))


@query(
    "isotonic_interpolation",
    f"SELECT row_idx, round({knots('score')}, 9) AS p FROM labelled",
    "labelled",
)
def _(spark, sf):
    p = arrays.interpolate(F.col("score"), arrays.literal_array(XS), arrays.literal_array(YS))
    return sv.labelled(spark, sf).select("row_idx", F.round(p, 9).alias("p"))


@query("ensemble_scores", f"WITH {LOGITS}, {ENS} SELECT row_idx, round(p, {R}) AS p, round(p_low, {R}) AS p_low, round(p_high, {R}) AS p_high FROM ens", "feats")
def _(spark, sf):
    return rounded(ensemble(spark, sf).select("row_idx", "p", "p_low", "p_high"), "p", "p_low", "p_high")


@query(
    "threshold_band",
    f"WITH {LOGITS}, {ENS} SELECT count(*) AS n, count(*) FILTER (p >= 0.6) AS called, count(*) FILTER (p_low >= 0.6) AS called_low, count(*) FILTER (p_high >= 0.6) AS called_high FROM ens",
    "feats",
)
def _(spark, sf):
    return scoring.threshold_band(ensemble(spark, sf), 0.6)


@query(
    "called_rows",
    f"WITH {LOGITS}, {ENS} SELECT row_idx, label, round(p, {R}) AS p, p >= 0.6 AS called FROM ens",
    "feats",
)
def _(spark, sf):
    rows = sv.features(spark, sf).select("row_idx", "label")
    e = ensemble(spark, sf).join(rows, "row_idx")
    return e.select("row_idx", "label", F.round("p", R).alias("p"), (F.col("p") >= 0.6).alias("called"))


def fitted_head(f):
    return scoring.fit_head(
        f.where("row_idx % 3 <> 0"), f.where("row_idx % 3 = 0"), "features", "label", key="features"
    )


@query("fitted_head_scores")
def fitted_head_scores(spark, sf):
    f = sv.features(spark, sf)
    head = fitted_head(f)
    out = scoring.ensemble_scores({"features": f}, {"features": "features"}, [head], "row_idx")
    return rounded(out.select("row_idx", "p"), "p")


SEEDS = (1, 2, 3)
CAP = 60


def run_of(spark, sf):
    """Two feature sets and three draws of training negatives over all vectors."""
    f = sv.features(spark, sf).withColumn("half", F.slice("features", 1, HALF))
    split = F.when(F.col("row_idx") % 5 == 0, "test").when(F.col("row_idx") % 5 < 3, "val").otherwise("train")
    rows = f.select("*", split.alias("split"), F.expr("row_idx div 16").alias("transcript_id"))
    return evaluation.evaluation_run(rows, {"whole": "features", "half": "half"}, seeds=SEEDS, position="row_idx", negative_cap=CAP)


@query("multi_seed_run")
def multi_seed_run(spark, sf):
    m = run_of(spark, sf).metrics
    return rounded(m, *[c for c, t in m.dtypes if t == "double"])


@query(
    "multi_seed_facts",
    f"""WITH s AS (SELECT label, CASE WHEN row_idx % 5 = 0 THEN 'test' WHEN row_idx % 5 < 3 THEN 'val' ELSE 'train' END AS split, row_idx // 16 AS g FROM feats),
    c AS (SELECT count(*) FILTER (split = 'train' AND label = 1) AS p, count(*) FILTER (split = 'train' AND label = 0) AS n, count(*) FILTER (split = 'test') AS t,
      count(*) FILTER (split = 'test' AND label = 1) AS tp, count(DISTINCT g) FILTER (split = 'test') AS groups FROM s)
    SELECT arm, seed, p + least(n, {CAP}) AS train_rows, p AS train_positives, 0.0::DOUBLE AS slope, t AS test_rows, tp AS test_positives, groups AS test_groups
    FROM c, unnest(['whole', 'half']) a(arm), unnest(['1', '2', '3']) b(seed)""",
    "feats",
)
def _(spark, sf):
    run = run_of(spark, sf)
    fits = [(a, str(s), f.rows, f.positives, round(f.slope, R) + 0.0) for a, fs in run.fits.items() for s, f in zip(SEEDS, fs, strict=True)]
    fitted = spark.createDataFrame(fits, "arm string, seed string, train_rows long, train_positives long, slope double")
    counted = run.scored.groupBy("arm", "seed", "transcript_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
    counted = counted.groupBy("arm", "seed").agg(F.sum("n").alias("test_rows"), F.sum("p").alias("test_positives"), F.count(F.lit(1)).alias("test_groups"))
    return fitted.join(counted, ["arm", "seed"])


# What holds of the one optimum: the penalised loss has no slope, and calibration keeps the mean label.
@query(
    "fitted_head_facts",
    f"""SELECT count(*) FILTER (row_idx % 3 <> 0) AS train_rows, count(*) FILTER (row_idx % 3 = 0) AS calibration_rows, 0.0::DOUBLE AS slope,
    round(avg(label) FILTER (row_idx % 3 = 0), {R}) AS calibrated_mean, true AS rising FROM feats""",
    "feats",
)
def _(spark, sf):
    f = sv.features(spark, sf)
    head = fitted_head(f)
    train, held = f.where("row_idx % 3 <> 0"), f.where("row_idx % 3 = 0")
    slope = round(scoring.penalised_slope(train, head, "features", "label"), 3)
    p = scoring.ensemble_scores({"features": held}, {"features": "features"}, [head], "row_idx")
    rising = bool((np.diff(head.isotonic_y) >= 0).all() and (np.diff(head.isotonic_x) > 0).all())
    return p.agg(
        F.lit(train.count()).cast("long").alias("train_rows"), F.count(F.lit(1)).alias("calibration_rows"), F.lit(slope).alias("slope"),
        F.round(F.avg("p"), R).alias("calibrated_mean"), F.lit(rising).alias("rising"),
    )


@query(
    "isotonic_calibration",
    """WITH c AS (SELECT score, sum(label)::DOUBLE AS t, count(*) AS w, row_number() OVER (ORDER BY score) AS i FROM labelled GROUP BY score),
    cum AS (SELECT *, sum(t) OVER o AS st, sum(w) OVER o AS sw FROM c WINDOW o AS (ORDER BY score)),
    means AS (SELECT a.i AS j, b.i AS k, (b.st - a.st + a.t) / (b.sw - a.sw + a.w) AS m FROM cum a JOIN cum b ON b.i >= a.i),
    low AS (SELECT j, k AS i, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS v FROM means),
    fit AS (SELECT i, max(v) AS v FROM low GROUP BY i)
    SELECT score, w::BIGINT AS n, round(v, 9) AS calibrated FROM c JOIN fit USING (i)""",
    "labelled",
)
def _(spark, sf):
    rows = sv.labelled(spark, sf)
    xs, ys = isotonic.knots(isotonic.isotonic_pools(rows, "score", "label"))
    counted = rows.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("score", "n", F.round(isotonic.interpolated(F.col("score"), xs, ys), 9).alias("calibrated"))


@query("pca_coordinates")
def _(spark, sf):
    f = sv.features(spark, sf)
    pca = scoring.fit_pca(f.where("row_idx % 3 <> 0"), "features", 4)
    p = scoring.project(f, "features", pca)
    return p.select("row_idx", *[F.round(F.col("projected")[i], 5).alias(f"pc{i}") for i in range(4)])


@query(
    "compact_gather",
    f"""WITH m AS (SELECT row_idx AS src_row_idx, row_number() OVER (ORDER BY row_idx) - 1 AS row_idx FROM feats WHERE row_idx % 3 <> 0)
    SELECT m.row_idx, m.src_row_idx, round(list_sum(features)::DOUBLE, 4) AS total FROM feats f JOIN m ON m.src_row_idx = f.row_idx""",
    "feats",
)
def _(spark, sf):
    from strandwise.operators.scans import number_rows

    f = sv.features(spark, sf)
    wanted = f.where("row_idx % 3 <> 0").select(F.col("row_idx").alias("src_row_idx"))
    m = number_rows(wanted, "src_row_idx", name="row_idx")
    total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v.cast("double"))
    g = scoring.gather_compact(f, m)
    return g.select("row_idx", "src_row_idx", F.round(total, 4).alias("total"))


@query(
    "aligned_feature_blocks",
    """SELECT row_idx, 64 AS width, round(list_sum(list_transform(range(1, 65), lambda j: features[(j + 31) % 64 + 1]::DOUBLE * j)), 4) AS weighted FROM feats""",
    "feats",
)
def _(spark, sf):
    b = blocks(spark, sf)
    a = scoring.align_features({"b": b["b"], "a": b["a"]}, "v", "row_idx")
    w = F.aggregate(
        F.transform("features", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda x, v: x + v
    )
    return a.select("row_idx", F.size("features").alias("width"), F.round(w, 4).alias("weighted"))


@query(
    "feature_key_coverage",
    """SELECT 'a' AS key, count(*) FILTER (row_idx % 7 <> 0) AS covered, count(*) AS expected, count(*) FILTER (row_idx % 7 <> 0) = count(*) AS complete FROM feats
    UNION ALL SELECT 'b', count(*), count(*), true FROM feats""",
    "feats",
)
def _(spark, sf):
    b = blocks(spark, sf)
    wanted = sv.features(spark, sf).select("row_idx")
    return scoring.key_coverage({"a": b["a"].where("row_idx % 7 <> 0"), "b": b["b"]}, wanted, "row_idx")


def stored(spark, sf):
    """A store of both blocks, written in two runs; the first key lacks each seventh row."""
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    b = blocks(spark, sf)
    wanted = sv.features(spark, sf).select("row_idx")
    store.write_store(b["a"].where("row_idx % 7 <> 0").withColumnRenamed("v", "a"), ["a"], wanted, path, block_rows=128)
    return path, store.write_store(b["b"].withColumnRenamed("v", "b"), ["b"], wanted, path, block_rows=128)


@query(
    "feature_store_provenance",
    f"""SELECT 'a' AS key, count(*) FILTER (row_idx % 7 <> 0) AS covered, count(*) AS expected, count(*) FILTER (row_idx % 7 <> 0) = count(*) AS complete, {HALF} AS dim FROM feats
    UNION ALL SELECT 'b', count(*), count(*), true, {HALF} FROM feats""",
    "feats",
)
def _(spark, sf):
    return stored(spark, sf)[1]


@query(
    "feature_store_manifest",
    f"""SELECT 'a' AS key, row_idx // 128 AS block, count(*) AS rows, min(row_idx) AS first, max(row_idx) AS last, {HALF} AS dim FROM feats WHERE row_idx % 7 <> 0 GROUP BY ALL
    UNION ALL SELECT 'b', row_idx // 128, count(*), min(row_idx), max(row_idx), {HALF} FROM feats GROUP BY ALL""",
    "feats",
)
def _(spark, sf):
    return store.manifest(spark, stored(spark, sf)[0]).drop("block_rows")


# A selective read is the feature: training rows of a split, by id.
@query(
    "feature_store_read",
    f"""SELECT row_idx, round(list_sum(list_transform(range(1, {HALF + 1}), lambda j: features[j]::DOUBLE * j)), 4) AS a,
     round(list_sum(list_transform(range(1, {HALF + 1}), lambda j: features[j + {HALF}]::DOUBLE * j)), 4) AS b FROM feats WHERE row_idx % 7 <> 0 AND label = 1""",
    "feats",
)
def _(spark, sf):
    wanted = sv.features(spark, sf).where("row_idx % 7 <> 0 AND label = 1")
    got = store.load_rows(spark, stored(spark, sf)[0], ["a", "b"], wanted)
    digest = lambda c: F.round(F.aggregate(F.transform(c, lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda x, v: x + v), 4)
    return got.select("row_idx", digest("a").alias("a"), digest("b").alias("b"))


@query(
    "row_completeness",
    """SELECT count(*) AS n_rows, count(DISTINCT row_idx) AS n_distinct, min(row_idx) AS first, max(row_idx) AS last, count(*) = count(DISTINCT row_idx) AS is_unique,
     count(*) = count(DISTINCT row_idx) AND min(row_idx) = 0 AND max(row_idx) = count(DISTINCT row_idx) - 1 AS is_contiguous,
     (SELECT count(*) FROM (SELECT DISTINCT row_idx + 3 AS r FROM feats) WHERE r NOT IN (SELECT row_idx FROM feats)) AS n_uncovered FROM feats""",
    "feats",
)
def _(spark, sf):
    f = sv.features(spark, sf).select("row_idx")
    return quality.completeness(f, "row_idx", f.select((F.col("row_idx") + 3).alias("row_idx")))


@query(
    "vector_parity",
    """WITH d AS (SELECT f.row_idx, CASE WHEN f.row_idx % 10 = 0 THEN 0.5 ELSE 0 END AS shift FROM feats f WHERE row_idx % 11 <> 0)
    SELECT count(*) FILTER (row_idx % 11 <> 0) AS n_matched, count(*) FILTER (row_idx % 11 = 0) AS only_a, 0::BIGINT AS only_b, 0::BIGINT AS n_width_differs,
     count(*) FILTER (row_idx % 11 <> 0 AND row_idx % 10 = 0) AS n_value_differs, 0.5::DOUBLE AS max_abs_diff FROM feats""",
    "feats",
)
def _(spark, sf):
    f = sv.features(spark, sf).select("row_idx", "features")
    shift = F.when(F.col("row_idx") % 10 == 0, 0.5).otherwise(0.0)
    moved = F.transform("features", lambda v: v.cast("double") + shift)
    b = f.where("row_idx % 11 <> 0").withColumn("features", moved)
    out = quality.parity(f, b, "row_idx", "features", rtol=1e-5, atol=1e-6)
    return rounded(out, "max_abs_diff")


@query(
    "feature_shard_checks",
    """SELECT unnest(['null_id', 'missing_v', 'not_finite_v', 'repeated_id', 'width_varies_v']) AS rule,
      unnest([0, count(*) FILTER (row_idx % 13 = 0), count(*) FILTER (row_idx % 13 <> 0 AND row_idx % 17 = 0), 0, 1]::BIGINT[]) AS violations FROM feats""",
    "feats",
)
def _(spark, sf):
    v = F.slice("features", 1, HALF)
    bad = F.concat(F.array(F.lit(float("nan")).cast("float")), F.slice("features", 2, HALF - 1))
    col = F.when(F.col("row_idx") % 13 == 0, None).when(F.col("row_idx") % 17 == 0, bad)
    col = col.when(F.col("row_idx") % 19 == 0, F.slice("features", 1, 5)).otherwise(v)
    rows = sv.features(spark, sf).select("row_idx", col.alias("v"))
    return quality.shard_violations(rows, "row_idx", ["v"])


# Sampling.
HASH = "('0x' || substr(md5('{seed}:' || {id}), 1, 8))::BIGINT"


@query(
    "negative_cap",
    f"""WITH n AS (SELECT row_idx, row_number() OVER (ORDER BY {HASH.format(seed=7, id='row_idx')}, row_idx) AS r FROM labelled WHERE split = 'train' AND label = 0)
    SELECT row_idx, 0 AS label FROM n WHERE r <= 5000 UNION ALL SELECT row_idx, 1 FROM labelled WHERE split = 'train' AND label = 1""",
    "labelled",
)
def _(spark, sf):
    rows = sv.labelled(spark, sf).where("split = 'train'").select("row_idx", "label")
    return sampling.cap_negatives(rows, "row_idx", "label", 5000, 7)


CRC = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length({s}) + 1), lambda i: ascii({s}[i])::UBIGINT)), lambda crc, b:
   list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END))"""


def crc(s):
    return f"xor({CRC.format(s=s)}, 4294967295::UBIGINT)::BIGINT"


@query(
    "group_hash_split",
    f"""SELECT transcript_id, {crc('t')} % 10000 < 3000 AS first_part, {crc('u')} % 8 AS shard, n FROM (
      SELECT transcript_id, '11:' || transcript_id AS t, transcript_id::VARCHAR AS u, count(*) AS n FROM labelled GROUP BY ALL)""",
    "labelled",
)
def _(spark, sf):
    t = F.col("transcript_id")
    per = sv.labelled(spark, sf).groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n"))
    return per.select(
        "transcript_id", sampling.group_split(t, 0.3, 11).alias("first_part"), sampling.group_shard(t, 8).alias("shard"), "n"
    )


@query(
    "unique_sites",
    """WITH m AS (SELECT l_orderkey AS transcript_id, l_linenumber::BIGINT AS mrna_index, l_partkey AS row_idx, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem)
    SELECT transcript_id, mrna_index, min(row_idx) AS row_idx, count(*) AS n_rows, min(label) <> max(label) AS conflict FROM m GROUP BY ALL""",
)
def _(spark, sf):
    li = sv.table(spark, sf, "lineitem")
    m = li.select(
        F.col("l_orderkey").alias("transcript_id"), F.col("l_linenumber").cast("long").alias("mrna_index"),
        F.col("l_partkey").alias("row_idx"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )
    u = sampling.unique_sites(m, ["transcript_id", "mrna_index"], "row_idx", ["label"])
    return u.drop("label")


@query(
    "store_selection",
    f"""WITH h AS (SELECT *, {HASH.format(seed=3, id='row_idx')} AS h FROM labelled),
    a AS (SELECT row_idx FROM h WHERE codon_class <> 'non_cognate' AND (split <> 'train' OR label = 1)),
    b AS (SELECT row_idx FROM h WHERE codon_class <> 'non_cognate' AND split = 'train' AND label = 0 ORDER BY h, row_idx LIMIT 4000),
    c AS (SELECT row_idx FROM h WHERE codon_class = 'non_cognate' AND split = 'test')
    SELECT row_idx AS src_row_idx, row_number() OVER (ORDER BY row_idx) - 1 AS row_idx FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""",
    "labelled",
)
def _(spark, sf):
    rows = sv.labelled(spark, sf).select("row_idx", "label", "split", "codon_class")
    s = sampling.store_selection(rows, "row_idx", "label", 4000, seed=3)
    return s.select("src_row_idx", "row_idx")


@query(
    "split_statistics",
    """SELECT split, codon_class, count(*) AS n, count(DISTINCT transcript_id) AS n_transcripts, sum(label)::BIGINT AS positives FROM labelled GROUP BY ALL""",
    "labelled",
)
def _(spark, sf):
    per = sv.labelled(spark, sf).groupBy("split", "codon_class", "transcript_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")
    )
    return per.groupBy("split", "codon_class").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_transcripts"), F.sum("p").alias("positives")
    )


@query(
    "test_class_filter",
    "SELECT row_idx, codon_class FROM labelled WHERE split = 'test' AND codon_class IN ('AUG', 'near_cognate')",
    "labelled",
)
def _(spark, sf):
    return sampling.test_rows_of(sv.labelled(spark, sf), ("AUG", "near_cognate")).select("row_idx", "codon_class")


# Counting noise.
FRAC = f"""{REGION}, x AS (SELECT condition, library, rep, sum(value) AS total FROM track t WHERE {IN_REGION.format(t='t', p='pos')} GROUP BY ALL),
frac AS (SELECT *, total / sum(total) OVER (PARTITION BY condition, library) AS fraction FROM x)"""


@query(
    "expected_counts",
    f"""WITH {FRAC} SELECT p.condition, p.library, f.rep, p.chrom, p.strand, p.pos, round_even(p.value * 1.7 * f.fraction, 0) AS expected FROM pooled p JOIN frac f USING (condition, library)""",
    "track pooled windows",
)
def _(spark, sf):
    f = tracks.replicate_fractions(track(spark, sf), region(spark, sf))
    p = pooled(spark, sf).withColumn("value", F.col("value") * 1.7)
    return resample.expected_counts(p, f).select("condition", "library", "rep", "chrom", "strand", "pos", "expected")


@query(
    "depth_factors",
    """SELECT condition, library, sum(value) AS real_total, round(sum(rep1 * 1.5 + 0.25), 6) AS predicted_total, round(sum(value) / sum(rep1 * 1.5 + 0.25), 9) AS factor FROM pooled GROUP BY ALL""",
    "pooled",
)
def _(spark, sf):
    p = pooled(spark, sf)
    d = resample.depth_factors(p.withColumn("value", F.col("rep1") * 1.5 + 0.25), p)
    return d.withColumns({"predicted_total": F.round("predicted_total", 6), "factor": F.round("factor", 9)})


@query("poisson_resample")
def poisson_resample(spark, sf):
    f = tracks.replicate_fractions(track(spark, sf), region(spark, sf))
    p = pooled(spark, sf)
    shares = p.join(f.select("condition", "library", "rep", "fraction"), ["condition", "library"])
    return resample.draw_counts(shares.withColumn("value", F.col("value") * F.col("fraction")), 5)


# What holds of any right draw: nothing where the rate is zero, and a total within six deviations.
@query(
    "poisson_resample_facts",
    "SELECT condition, library, rep, 0 AS off_support, TRUE AS total_fits FROM track WHERE value > 0 GROUP BY ALL",
    "track",
)
def _(spark, sf):
    t = track(spark, sf).where("value > 0")
    drawn = resample.draw_counts(t.select("condition", "library", "rep", "chrom", "strand", "pos", (F.col("value") / 2).alias("value")), 7)
    keys = ["condition", "library", "rep", "chrom", "strand", "pos"]
    both = t.select(*keys, (F.col("value") / 2).alias("rate")).join(drawn, keys, "full_outer")
    out = both.groupBy("condition", "library", "rep").agg(
        F.count(F.when(F.col("rate").isNull(), 1)).alias("off_support"), F.sum("rate").alias("m"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("v")
    )
    return out.select("condition", "library", "rep", "off_support", (F.abs(F.col("v") - F.col("m")) <= 6 * F.sqrt("m") + 1).alias("total_fits"))


@query(
    "resampled_depth_totals",
    "SELECT condition, tx, sum(rep1) AS value, 0 AS off_support FROM txtrack WHERE library = 'tis' GROUP BY ALL HAVING sum(rep1) > 0",
    "txtrack",
)
def _(spark, sf):
    t = txtrack(spark, sf, ("tis",))
    drawn = resample.draw_to_depth(t.select("condition", "tx", "tx_pos", "value", "rep1"), "rep1", 5)
    off = F.coalesce(F.col("expected") <= 0, F.lit(True))
    return drawn.groupBy("condition", "tx").agg(F.sum("value").alias("value"), F.count(F.when(off, 1)).alias("off_support"))


@query(
    "leakage_guards",
    """SELECT 'window_on_held_out_chrom' AS rule, count(*) AS violations FROM windows WHERE chrom IN ('chr8', 'chr9')
    UNION ALL SELECT 'fit_condition_in_held_out_group', count(DISTINCT condition) FROM expression WHERE condition IN ('C1', 'C2') AND condition = 'C2'""",
    "windows expression",
)
def _(spark, sf):
    from strandwise.functions.coords import line_of

    w = sv.windows(spark, sf)
    held = w.where("chrom IN ('chr8', 'chr9')").select("chrom")
    c = gene_table(spark, sf).select("condition").distinct().withColumn("line", line_of(F.col("condition")))
    return quality.leakage(w, held, c.where("condition <> 'C0'"), c.where("condition = 'C2'"))


TILES = """a AS (SELECT row_idx, chrom, strand, CASE WHEN strand = '-' THEN gstart - 1 ELSE gstart END AS a FROM placed),
t AS (SELECT *, (round_even(a / 100.0::DOUBLE, 0) * 100 - 128)::BIGINT AS tile_start FROM a),
m AS (SELECT *, CASE WHEN strand = '-' THEN tile_start + 255 - a ELSE a - tile_start END AS "offset" FROM t)"""


def tiles(spark, sf):
    from strandwise.operators.tiling import assign_tiles

    return assign_tiles(placed(spark, sf), 256, 100)


@query("candidate_tiles", f'WITH {PLACED}, {TILES} SELECT row_idx, chrom, strand, tile_start, "offset" FROM m', "exons")
def _(spark, sf):
    return tiles(spark, sf).select("row_idx", "chrom", "strand", "tile_start", "offset")


@query(
    "tile_position_requests",
    f"""WITH {PLACED}, {TILES}, q AS (SELECT *, o AS feature_offset, "offset" + o AS position FROM m, unnest([-1, 0, 1, 2]) u(o))
    SELECT row_idx, feature_offset, position, dense_rank() OVER (PARTITION BY chrom, tile_start, strand ORDER BY position) - 1 AS position_index FROM q""",
    "exons",
)
def _(spark, sf):
    from strandwise.operators.tiling import position_requests

    r = position_requests(tiles(spark, sf), (-1, 0, 1, 2), 256)
    return r.select("row_idx", "feature_offset", "position", F.col("position_index").cast("long").alias("position_index"))


@query(
    "transcript_tiles",
    """WITH r AS (SELECT tx, length, greatest(0, ceil((length - 60) / 25.0))::BIGINT AS s FROM tx),
    i AS (SELECT tx, length, s, i, greatest(least(i * 25, length - 60), 0) AS start FROM r, unnest(range(s + 1)) u(i)),
    e AS (SELECT *, least(start + 60, length) AS "end" FROM i)
    SELECT tx, start, "end", coalesce(greatest(start, floor((lag(start) OVER w + lag("end") OVER w + start + "end" - 2) / 4.0)::BIGINT + 1), start) AS lo,
      coalesce(least("end", floor((lead(start) OVER w + lead("end") OVER w + start + "end" - 2) / 4.0)::BIGINT + 1), "end") AS hi
    FROM e WINDOW w AS (PARTITION BY tx ORDER BY i)""",
    "tx",
)
def _(spark, sf):
    from strandwise.operators.tiling import tile_transcripts
    from strandwise.plans.q_transcripts import annotation

    return tile_transcripts(annotation(spark, sf).select("tx", "length"), "tx", 60, 25)


@query(
    "window_predictions",
    """SELECT w.chrom, w.start, round(sum(CASE WHEN strand = '+' THEN value ELSE 0 END) / sum(value), 9) AS share
    FROM windows w JOIN pooled p ON p.chrom = w.chrom AND p.pos >= w.start AND p.pos < w."end" GROUP BY ALL""",
    "pooled windows",
)
def _(spark, sf):
    """A user's predictor over windows: here the share of each window's reads per strand."""
    from strandwise.operators import intervals
    from strandwise.operators.tiling import predict_windows

    hits = intervals.points_in_spans(pooled(spark, sf), sv.windows(spark, sf), ["chrom"])
    plus = F.sum(F.when(F.col("strand") == "+", F.col("value")).otherwise(0.0))
    w = hits.groupBy("chrom", "start").agg(plus.alias("plus"), F.sum("value").alias("total"))

    def predict(batches):
        for b in batches:
            b["share"] = (b["plus"] / b["total"]).round(9)
            yield b[["chrom", "start", "share"]]

    return predict_windows(w, predict, "chrom string, start long, share double")
