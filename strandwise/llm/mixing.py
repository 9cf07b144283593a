"""Mixing sources to target weights by a low-discrepancy schedule over shuffled equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.llm.common import hash_bits, leading, packed, running_total, unpacked
from strandwise.session import durable

WORD = r"[^\x20\x09-\x0D]+"
#: Slots that are numbered together.
CHUNK = 65_536
#: The golden ratio's fraction, as a step of the 2^48 points of the unit circle: an odd number, so no point repeats.
STEP, CIRCLE = 173_961_102_589_771, 2**48


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target, lo, hi) by source, from rows of (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn. Targets share the sum of all sizes by
    weight but stop at ``most`` times a source's size; what is over goes to the others by weight until none
    is above. With the sources in order of cap over weight, the capped ones are a prefix, so running sums
    find the level. [lo, hi) is a source's part of the unit circle. The windows hold one row per source.
    """
    totals = durable(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    named = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.expr(f"element_at(array({','.join(map(str, map(float, weights)))}), cast(pmod(row_number() over (order by source asc nulls last) - 1, {len(weights)}) + 1 as int))")
    ranked = totals.withColumn("w", turn).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    ranked = ranked.withColumn("all", F.sum("source_size").over(whole))
    ranked = ranked.withColumn("share", (F.col("all") - F.coalesce(F.sum("cap").over(level), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(level), F.lit(0.0))))
    ranked = ranked.withColumn("open", F.col("share") * F.col("w") <= F.col("cap"))
    height = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("share")))).over(whole)["share"]
    ranked = ranked.withColumn("target", F.least(F.col("cap"), height * F.col("w")))
    ahead = named.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hi = F.round(F.sum("target").over(ahead) / F.col("all") * CIRCLE).cast("long")
    ranked = ranked.withColumn("hi", F.coalesce(hi, F.lit(0)))
    return ranked.withColumn("lo", F.coalesce(F.lag("hi").over(named), F.lit(0))).select("source", "source_size", "target", "lo", "hi")


def block_slots(targets: DataFrame, block: int) -> DataFrame:
    """(slot, source, epoch, block, words): which block of which source each place of the mix holds.

    Slot i is the golden-ratio point i * STEP on the circle and goes to the source whose part of the circle
    holds it; its rank among its source's slots names the block and the pass over the source. A source needs
    just the slots that hold its target: points beyond them are left out, and the few that the sequence's
    discrepancy leaves short stand at the end. Points meet parts by equal cells of the circle.
    """
    spark = targets.sparkSession
    need = targets.withColumn("goal", F.round("target").cast("long")).where("goal > 0")
    need = need.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}")).withColumn("full", F.expr("goal div source_size")).withColumn("rest", F.expr("goal % source_size"))
    need = durable(need.withColumn("slots", F.expr(f"full * blocks + (rest + {block - 1}) div {block}")), "needs")
    size = need.agg(F.sum("slots").alias("n"), F.count("*").alias("sources")).first()
    wide = CIRCLE // 2 ** max(12, (4 * size["sources"]).bit_length())
    parts = need.where("hi > lo").withColumn("cell", F.explode(F.expr(f"sequence(lo div {wide}, (hi - 1) div {wide})")))
    points = spark.range(size["n"] or 0).select(F.col("id").alias("slot"), F.expr(f"cast((cast(id + 1 as decimal(20,0)) * {STEP}) % {CIRCLE} as long)").alias("at"))
    points = points.withColumn("cell", F.expr(f"at div {wide}")).withColumn("chunk", F.expr(f"slot div {CHUNK}"))
    dealt = points.join(parts, "cell").where("at >= lo and at < hi").select("slot", "chunk", "source")
    ranked = running_total(dealt, ["source"], "chunk", ["slot"], F.lit(1), "rank")
    ranked = ranked.join(need.select(F.col("source").alias("_s"), "slots"), F.col("source").eqNullSafe(F.col("_s"))).where("rank < slots")
    ranked = durable(ranked.select("slot", "source", "rank"), "slots")
    had = ranked.groupBy("source").agg(F.count("*").alias("had")).withColumnRenamed("source", "_s")
    short = need.join(had, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < slots")
    short = short.select(F.lit(size["n"] or 0).alias("slot"), "source", F.explode(F.expr("sequence(had, slots - 1)")).alias("rank"))
    placed = ranked.unionByName(short).join(need.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    placed = placed.withColumn("epoch", F.expr("rank div blocks")).withColumn("block", F.expr("rank % blocks"))
    left = F.when(F.col("epoch") < F.col("full"), F.col("source_size")).otherwise(F.col("rest")) - F.col("block") * block
    return placed.select("slot", "source", "epoch", "block", F.least(F.lit(block), left).alias("words"))


def with_size(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h) by document: its number of words, and the hash that shuffles it."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("doc_id", F.xxhash64("text")).alias("h"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, block: int = 256) -> DataFrame:
    """(doc_id, size, source_size, target, taken, h) of every document; ``taken`` counts the words the mix takes of it.

    The documents of a source stand in the order of a hash (the shuffle), as one stream of words cut into
    blocks of ``block`` words, the last one shorter. ``block_slots`` schedules blocks to the targets, and a
    document gets what its blocks' slots take. A source takes its target rounded to a word, a document at
    most ``most`` passes. Documents reach the blocks by (source, block), so a hot source spreads evenly.

    Edge cases: a null text has size 0 and takes 0; a null source is a source, last in order; repeated rows
    and null doc_ids each stand in the stream; an empty table gives no rows; other columns are not read.
    """
    sized = durable(with_size(docs), "sized")
    targets = durable(source_targets(sized, weights, most), "targets")
    slots = block_slots(targets, block).groupBy("source", "block", "words").agg(F.count("*").alias("times"))
    bits = hash_bits(sized.count())
    placed = running_total(sized.where("size > 0").withColumn("bucket", leading(F.col("h"), bits)), ["source"], "bucket", ["h", "doc_id", "size"], F.col("size"), "start")
    cut = placed.select("doc_id", "h", "source", "size", "start", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    slots = slots.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "words", "times")
    used = cut.join(slots, (F.col("block") == F.col("_b")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    part = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size") - F.col("block") * block, F.col("words")) - F.greatest(F.col("start") - F.col("block") * block, F.lit(0)))
    taken = used.groupBy("doc_id", "h", "source", "size", "start").agg(F.coalesce(F.sum(part * F.col("times")), F.lit(0)).cast("long").alias("taken"))
    whole = taken.drop("start").unionByName(sized.where("size = 0").select("doc_id", "h", "source", "size", F.lit(0).cast("long").alias("taken")))
    named = targets.select(F.col("source").alias("_s"), "source_size", "target")
    return whole.join(named, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "size", "source_size", "target", "taken", "h")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, a part of a document of half its words or more counted whole.

    Rows that share doc_id and text are counted together. Documents without words are not taken.
    """
    counts = mix(docs, **options).where("size > 0").groupBy("doc_id", "h").agg(F.round(F.sum("taken") / F.max("size")).cast("int").alias("_copies")).where("_copies > 0")
    counts = counts.select(F.col("doc_id").alias("_id"), F.col("h").alias("_hash"), "_copies")
    rows = packed(docs, "doc_id", "text", "source").withColumn("_h", F.xxhash64("doc_id", F.xxhash64("text")))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_h", "doc_id").orderBy("source"))).where("_nth = 1")
    rows = rows.join(counts, (F.col("_h") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*unpacked(docs.columns, "doc_id", "text", "source"))
