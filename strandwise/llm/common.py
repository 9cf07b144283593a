"""Small helpers of the operators: batches of bytes, running totals, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.session import durable

#: ASCII white space: what ``bytes.split()`` and ``bytes.strip()`` take by default.
WHITE = b" \t\n\x0b\x0c\r"


def small_batches(spark: SparkSession) -> SparkSession:
    """Texts go to Python a few megabytes at a time, so that workers stay small beside the executor's heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def octets(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """``docs`` as the columns ``own`` and all others in one struct, so that no name of a user's meets one of an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(*rest or [F.lit(True).alias("none")]).alias("user_row"))


def unpacked(columns: list[str], *own: str) -> list[Column]:
    """The columns of the table that was packed, in their order."""
    return [F.col(c) if c in own else F.col("user_row").getField(c).alias(c) for c in columns]


def runs_of(rows: Iterator, weight: Iterator[int], most: int) -> Iterator[list]:
    """``rows`` in lists whose weights sum to ``most`` at least, the last one excepted: bounds memory in a task."""
    group: list = []
    total = 0
    for row, w in zip(rows, weight, strict=True):
        group.append(row)
        total += w
        if total >= most:
            yield group
            group, total = [], 0
    if group:
        yield group


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[Column | str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before this one in the order (bucket, ``order``) of its key.

    A key's rows never meet in one task: rows are summed inside a bucket of the key, and only one total a bucket
    is carried. ``bucket`` must be a prefix of the order and small enough for a task. Keys may be null.
    """
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
    totals = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(bucket).alias("_b"), "_ahead")
    same = F.col(bucket) == F.col("_b")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(totals, same).withColumn(name, F.col("_ahead") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return joined.drop("_b", "_ahead", *[f"_k{i}" for i in range(len(keys))])


def hash_bits(rows: int, per_bucket: int = 50_000) -> int:
    """How many leading bits of a hash cut ``rows`` into buckets of about ``per_bucket``; follows the data without an upper end."""
    return max(1, (max(rows, 1) // per_bucket).bit_length())


def leading(hashed: Column, bits: int) -> Column:
    """The first ``bits`` bits of a 64-bit hash, in the hash's own order."""
    return F.shiftright(hashed, 64 - bits)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of an edge list: root is the smallest node reachable.

    Alternating large-star and small-star: each round points the neighbours of a node to the smallest of
    them by one aggregate and one join, so a hub's neighbours are never gathered. Rounds are written to the
    shared folder, which cuts lineage; they end when the edges no longer change.
    """
    now = durable(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("x")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        small = large.join(low, F.col("u") == F.col("x"))
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        now = durable(small, "edges")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark or not seen[0]:
            break
        mark = seen
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
