"""Group bootstrap: resample groups with replacement, metrics per replicate, intervals.

Draws are a pure function of the seed, so a lost task recomputes the same draws. All draws of a group travel as one
vector, and once, not with each of its rows. Additive metrics need only per-group counts;
rank metrics are prefix sums over scores of vectors with one entry a replicate.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from strandwise.functions.arrays import stable_hash
from strandwise.functions.numeric import count_if, safe_ratio
from strandwise.operators import ranking
from strandwise.operators.scans import bucket_count, exact_quantiles, number_keys, runs
from strandwise.session import durable

LOW, HIGH = 0.025, 0.975
#: Groups in a block of draws, draws that a task sorts at once, scores in a block, and cells of a matrix held at once.
BLOCK, DRAWS, SCORES, CELLS = 512, 4_000_000, 1024, 4_000_000


def draw_vectors(groups: DataFrame, group: str, replicates: int, seed: int) -> DataFrame:
    """``(group, counts)``: how often a group was drawn in each replicate ``b = 0, 1, ...``, ``n`` draws of ``n``.

    Draw ``i`` of replicate ``b`` takes the group numbered ``hash(seed, b, i) mod n``. A task sorts its draws by blocks of
    ``BLOCK`` numbers and sends each block's draws as one list of codes; a block is one matrix of counts.
    """
    if replicates <= 0:
        raise ValueError("replicates must be positive")
    numbered = number_keys(groups, group)
    n = groups.select(group).distinct().count()
    if not n:
        return numbered.select(group, F.array().cast("array<int>").alias("counts"))
    spark = groups.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-replicates * n // DRAWS))
    draws = spark.range(0, replicates * n, 1, tasks)
    b = F.floor(F.col("id") / n).cast("long")
    ordinal = stable_hash(F.lit(seed), b, F.col("id") - b * n) % n

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                at, b = batch.column("ordinal").to_numpy(), batch.column("b").to_numpy()
                held.append((at // BLOCK * replicates + b) * BLOCK + at % BLOCK)
            if held and (batch is None or sum(map(len, held)) >= DRAWS):
                codes = np.sort(np.concatenate(held))
                held = []
                block = codes // (BLOCK * replicates)
                first = np.flatnonzero(np.diff(block, prepend=-1))
                ends = pa.array(np.append(first, len(codes)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(block[first]), pa.ListArray.from_arrays(ends, pa.array(codes - block * (BLOCK * replicates)))], ["block", "codes"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block,), parts in runs(batches, ["block"]):
            total = np.zeros(replicates * BLOCK, np.int32)
            for part in parts:
                total += np.bincount(part.column("codes").flatten().to_numpy(), minlength=len(total)).astype(np.int32)
            counts = np.ascontiguousarray(total.reshape(replicates, BLOCK).T)
            drawn = np.flatnonzero(counts.any(axis=1))
            ends = pa.array(np.arange(len(drawn) + 1) * replicates, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(block * BLOCK + drawn), pa.ListArray.from_arrays(ends, pa.array(counts[drawn].ravel()))], ["ordinal", "counts"])

    sent = draws.select(b.alias("b"), ordinal.alias("ordinal")).mapInArrow(packed, "block long, codes array<long>")
    each = sent.repartition("block").sortWithinPartitions("block").mapInArrow(counted, "ordinal long, counts array<int>")
    return each.join(numbered, "ordinal").select(group, "counts")


def draw_arrays(groups: DataFrame, group: str, replicates: int, seed: int) -> DataFrame:
    """``(group, draws)``: in which replicates ``b`` a group was drawn and how often (``weight``); see :func:`draw_vectors`.

    A group that was never drawn has no row.
    """
    each = F.transform("counts", lambda w, b: F.struct(b.cast("long").alias("b"), w.cast("long").alias("weight")))
    return draw_vectors(groups, group, replicates, seed).select(group, F.filter(each, lambda d: d["weight"] > 0).alias("draws"))


def draw_weights(groups: DataFrame, group: str, replicates: int, seed: int) -> DataFrame:
    """``(b, group, weight)``: the draws of :func:`draw_arrays`, one row for each replicate that drew the group."""
    return draw_arrays(groups, group, replicates, seed).select(group, F.inline("draws")).select("b", group, "weight")


def _arrays(weights: DataFrame, group: str) -> DataFrame:
    """The draws of each group as one array."""
    if "draws" in weights.columns:
        return weights
    return weights.groupBy(group).agg(F.collect_list(F.struct("b", "weight")).alias("draws"))


def group_counts_at(
    df: DataFrame, score: str, label: str, group: str, threshold: Column | float, extra: Sequence[str] = ()
) -> DataFrame:
    """Additive statistics per group (and ``extra`` keys) at a threshold."""
    cut = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    y = F.col(label).cast("boolean")
    called = F.col(score) >= cut
    return df.groupBy(*extra, group).agg(
        count_if(y).alias("p"),
        count_if(called & y).alias("tp"),
        count_if(called & ~y).alias("fp"),
    )


def additive_replicates(
    stats: DataFrame, weights: DataFrame, group: str, extra: Sequence[str] = ()
) -> DataFrame:
    """Recall, precision and false positives per drawn group for each replicate."""
    w = F.col("weight")
    drawn = stats.join(_arrays(weights, group), group).select(*extra, "p", "tp", "fp", F.inline("draws"))
    summed = drawn.groupBy(*extra, "b").agg(
        F.sum(F.col("p") * w).alias("p"),
        F.sum(F.col("tp") * w).alias("tp"),
        F.sum(F.col("fp") * w).alias("fp"),
        F.sum(w).alias("drawn"),
    )
    one = F.lit(1).cast("long")
    return summed.select(
        *extra,
        "b",
        (F.col("tp") / F.greatest(F.col("p"), one)).alias("recall"),
        (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one)).alias("precision"),
        (F.col("fp") / F.greatest(F.col("drawn"), one)).alias("fp_per_group"),
    )


def _vectors(weights: DataFrame, group: str) -> tuple[DataFrame, list[int] | None]:
    """The draws of each group as one vector over the replicates, and those (None: 0, 1, ...)."""
    if "counts" in weights.columns:
        return weights.select(group, "counts"), None
    arrays = _arrays(weights, group)
    names = sorted(r["b"] for r in arrays.select(F.explode("draws.b").alias("b")).distinct().collect())

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = batch.column("draws")
            b, weight = (x.to_numpy() for x in draws.flatten().flatten())
            row = np.repeat(np.arange(len(draws)), pc.list_value_length(draws).to_numpy())
            counts = np.bincount(row * len(names) + np.searchsorted(names, b), weight, len(draws) * len(names)).astype(np.int32)
            ends = pa.array(np.arange(len(draws) + 1) * len(names), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(group), pa.ListArray.from_arrays(ends, pa.array(counts))], [group, "counts"])

    pairs = F.transform("draws", lambda d: F.struct(d["b"].cast("long").alias("b"), d["weight"].cast("long").alias("weight")))
    shape = T.StructType([arrays.schema[group], T.StructField("counts", T.ArrayType(T.IntegerType()))])
    return arrays.select(group, pairs.alias("draws")).mapInArrow(dense, shape), names


class _Curve:
    """Weighted negatives and positives by score (rising) and replicate."""

    def __init__(self, replicates: int) -> None:
        self.score = np.empty(0)
        self.cells = np.zeros((2, 0, replicates))
        self.seen = np.zeros(replicates, bool)

    def add(self, kind: int, score: np.ndarray, cells: np.ndarray) -> None:
        """``score`` is rising and distinct."""
        all_scores = np.unique(np.concatenate([self.score, score]))
        if len(all_scores) > len(self.score):
            wider = np.zeros((2, len(all_scores), len(self.seen)))
            wider[:, np.searchsorted(all_scores, self.score)] = self.cells
            self.score, self.cells = all_scores, wider
        self.cells[kind, np.searchsorted(self.score, score)] += cells


def rank_replicates(
    df: DataFrame, score: str, label: str, group: str, weights: DataFrame, extra: Sequence[str] = ()
) -> DataFrame:
    """AUPRC and AUROC per replicate, from positives and negatives per distinct score as vectors over the replicates.

    The draws of a group move once and meet its rows in one sorted stream; a task sums positives and negatives by score
    and replicate before they move on. Scores are cut into blocks, and one total a block and replicate is carried.
    Equal scores count together; rows without a score take no part.
    """
    keys, names = [*extra, "_bucket"], list(extra)
    vectors, replicates = _vectors(weights, group)
    y = F.col(label).cast("boolean")
    kind = F.when(y, 1).when(~y, 0).otherwise(-1)
    rows = df.select(*extra, F.col(group).alias("_group"), F.col(score).cast("double").alias("_score"), kind.alias("_kind"))
    rows = durable(rows.where(F.col("_score").isNotNull() & F.col("_group").isNotNull()), "scores")
    distinct = rows.select(F.approx_count_distinct("_score")).first()[0]
    edges = np.array(ranking.quantile_edges(rows, "_score", max(bucket_count(rows), distinct // SCORES)))
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*extra).schema)
    shape = to_arrow_schema(_parse_datatype_string(f"{own}_bucket long, _kind int, _scores array<double>, _cells array<int>"))

    def pieces(key: tuple, curve: _Curve) -> Iterator[pa.RecordBatch]:
        """The cells of a curve by bucket, in lists of some thousand; seen replicates have the kind -1."""
        bucket = np.searchsorted(edges, curve.score, "right")
        step = max(1, CELLS // 64 // len(curve.seen))
        for k in np.unique(bucket) if len(bucket) else [0]:
            at = np.flatnonzero(bucket == k)
            out = [(-1, [], curve.seen.astype(np.int32))]
            for kind in (0, 1):
                used = at[curve.cells[kind, at].any(axis=1)]
                for lo in range(0, len(used), step):
                    part = used[lo : lo + step]
                    rest = curve.cells[kind, part]
                    while rest.any():
                        now = np.minimum(rest, 2**31 - 1)
                        out.append((kind, curve.score[part], now.ravel().astype(np.int32)))
                        rest = rest - now
            for kind, scores, cells in out:
                values = [*key, k, kind, scores, cells]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, shape, strict=True)], schema=shape)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curves: dict[tuple, _Curve] = {}
        draws = None
        for batch in batches:
            if draws is not None:
                batch = pa.concat_batches([draws, batch])
            heads = np.flatnonzero(pc.is_valid(batch.column("counts")).to_numpy(zero_copy_only=False))
            if not len(heads):
                continue
            draws = batch.slice(heads[-1], 1)
            lists = batch.column("counts").take(pa.array(heads))
            weight = lists.flatten().to_numpy().reshape(len(heads), -1)
            head = np.searchsorted(heads, np.arange(len(batch)), "right") - 1
            same = pc.equal(batch.column("_group").take(pa.array(heads[np.maximum(head, 0)])), batch.column("_group"))
            here = pc.is_valid(batch.column("_score")).to_numpy(zero_copy_only=False) & (head >= 0)
            here &= same.to_numpy(zero_copy_only=False)
            own, code = {}, np.zeros(len(batch), int)
            if names:
                tuples = list(zip(*[batch.column(c).to_pylist() for c in names], strict=True))
                code = np.array([own.setdefault(t, len(own)) for t in tuples])
            for key, c in (own or {(): 0}).items():
                rows = np.flatnonzero(here & (code == c))
                if not len(rows):
                    continue
                curve = curves.setdefault(key, _Curve(weight.shape[1]))
                curve.seen |= weight[np.unique(head[rows])].any(axis=0)
                value = batch.column("_score").take(pa.array(rows)).to_numpy()
                kinds = batch.column("_kind").take(pa.array(rows)).to_numpy()
                step = max(1, CELLS // 2 // weight.shape[1])
                for kind in (0, 1):
                    at = np.flatnonzero(kinds == kind)
                    at = at[np.argsort(value[at], kind="stable")]
                    for lo in range(0, len(at), step):
                        part = at[lo : lo + step]
                        scores, first = np.unique(value[part], return_index=True)
                        curve.add(kind, scores, np.add.reduceat(weight[head[rows[part]]], first, axis=0, dtype=float))
                if sum(c.cells.size for c in curves.values()) > 4 * CELLS:
                    for done, full in curves.items():
                        yield from pieces(done, full)
                    curves = {}
        for done, full in curves.items():
            yield from pieces(done, full)

    # A group's vector stands before its rows: nulls sort first.
    heads = vectors.where(F.col(group).isNotNull()).select(F.col(group).alias("_group"), "counts")
    met = rows.unionByName(heads, allowMissingColumns=True).repartition("_group").sortWithinPartitions("_group", F.col("_score").isNotNull())
    parts = durable(met.mapInArrow(summed, own + "_bucket long, _kind int, _scores array<double>, _cells array<int>"), "curve")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                kind, cells = batch.column("_kind")[i].as_py(), batch.column("_cells")[i].values.to_numpy()
                b = len(cells) // max(1, len(batch.column("_scores")[i]))
                total = cells.reshape(-1, b).sum(axis=0, dtype=float)
                use = np.flatnonzero(total > 0)
                none = np.zeros(len(use))
                row = pa.array(np.full(len(use), i))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(row) for c in keys], pa.array(use), pa.array(total[use] if kind == 1 else none), pa.array(total[use] if kind == 0 else none)], [*keys, "b", "pos", "neg"]
                )

    whole = Window.partitionBy(*extra, "b")
    above = whole.orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.mapInArrow(totals, f"{own}_bucket long, b long, pos double, neg double").groupBy(*keys, "b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    none = lambda c: F.coalesce(c, F.lit(0.0))
    carried = carried.select(
        *keys, "b", none(F.sum("pos").over(above)).alias("tp"), none(F.sum("neg").over(above)).alias("fp"), F.sum("pos").over(whole).alias("all_pos"), F.sum("neg").over(whole).alias("all_neg")
    )

    def areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, run in runs(batches, keys):
            curve, ahead = None, []
            for part in run:
                lists = pc.is_valid(part.column("_cells")).to_numpy(zero_copy_only=False)
                if not lists.all():
                    ahead.append(part.filter(pa.array(~lists)).select(["b", "tp", "fp", "all_pos", "all_neg"]))
                for i in np.flatnonzero(lists):
                    kind, scores, cells = part.column("_kind")[i].as_py(), part.column("_scores")[i].values.to_numpy(), part.column("_cells")[i].values.to_numpy()
                    curve = curve or _Curve(len(cells) // max(1, len(scores)))
                    if kind >= 0:
                        curve.add(kind, scores, cells.reshape(len(scores), -1))
            b, tp, fp, all_pos, all_neg = (c.to_numpy() for c in pa.Table.from_batches(ahead))
            neg, pos = curve.cells[:, ::-1][:, :, b]
            tp, fp = tp + pos.cumsum(axis=0), fp + neg.cumsum(axis=0)
            precise = np.where(pos > 0, pos * tp / np.maximum(tp + fp, 1e-300), 0.0).sum(axis=0)
            under = (neg * (tp - pos / 2)).sum(axis=0)
            named = b if replicates is None else np.array(replicates, np.int64)[b]
            values = [pa.array([k] * len(b), f.type) for k, f in zip(key[:-1], shape, strict=False)]
            yield pa.RecordBatch.from_arrays([*values, *map(pa.array, (named, precise, under, all_pos, all_neg))], [*names, "b", "_pr", "_roc", "all_pos", "all_neg"])

    beside = parts.unionByName(carried, allowMissingColumns=True).repartition(*keys).sortWithinPartitions(*keys)
    ends = beside.mapInArrow(areas, f"{own}b long, _pr double, _roc double, all_pos double, all_neg double")
    return ends.groupBy(*extra, "b").agg(
        safe_ratio(F.sum("_pr"), F.max("all_pos")).alias("auprc"), safe_ratio(F.sum("_roc"), F.max("all_pos") * F.max("all_neg")).alias("auroc")
    )


def win_replicates(
    pairs: DataFrame, weights: DataFrame, group: str, score: str = "score", extra: Sequence[str] = ()
) -> DataFrame:
    """Near-neighbour win rate per replicate."""
    win = F.col(f"pos_{score}") > F.col(f"neg_{score}")
    stats = pairs.groupBy(*extra, group).agg(
        count_if(win).alias("_w"), F.count(F.lit(1)).alias("_n")
    )
    drawn = stats.join(_arrays(weights, group), group).select(*extra, "_w", "_n", F.inline("draws"))
    return drawn.groupBy(*extra, "b").agg(
        safe_ratio(F.sum(F.col("_w") * F.col("weight")), F.sum(F.col("_n") * F.col("weight"))).alias(
            "win_rate"
        )
    )


def intervals(replicates: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Exact 2.5% and 97.5% quantiles of each metric over replicates, long by metric."""
    long = replicates.select(
        *keys,
        F.inline(
            F.array(
                *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
            )
        ),
    )
    return exact_quantiles(long, [*keys, "metric"], "value", {"ci_low": LOW, "ci_high": HIGH}).drop("n")


def paired_differences(
    replicates: DataFrame, metrics: Sequence[str], arm: str, reference: str
) -> DataFrame:
    """Per replicate: each arm's metric minus the reference arm's on the same draws."""
    base = replicates.where(F.col(arm) == reference).select(
        "b", *[F.col(m).alias(f"_r_{m}") for m in metrics]
    )
    return (
        replicates.where(F.col(arm) != reference)
        .join(base, "b")
        .select(
            F.concat(F.col(arm), F.lit(f"-{reference}")).alias("comparison"),
            "b",
            *[(F.col(m) - F.col(f"_r_{m}")).alias(m) for m in metrics],
        )
    )
