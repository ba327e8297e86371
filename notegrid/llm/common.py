"""Shared pieces: tables written to the cluster's shared folder, distributed
running totals, connected components and byte tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from notegrid.sources.shared import new_path

#: Bytes up to which a staged table may be broadcast, counted over its values.
BROADCAST_BYTES = 8 << 20


def stage(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither
    recompute it nor depend on the executor that made it."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that is no longer needed."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/notegrid-tables/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def matched(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on null-safe equality of the named columns, kept from the left."""
    right = right.withColumnsRenamed({n: f"_ng_right_{n}" for n in names})
    on = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_ng_right_{n}")) for n in names])
    return left.join(right, on, how).drop(*[f"_ng_right_{n}" for n in names])


def weight(df: DataFrame):
    """Bytes of a row's values: 16 for a number, the length of texts and arrays of numbers."""
    def of(name: str, kind: T.DataType):
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.octet_length(F.col(f"`{name}`")) + 16
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return F.octet_length(F.to_json(F.col(f"`{name}`"))) + 32
        return F.lit(16)

    return sum((F.coalesce(of(f.name, f.dataType), F.lit(16)) for f in df.schema.fields), F.lit(0))


def small(df: DataFrame) -> DataFrame:
    """Hint a broadcast of a staged table only if its values take at most
    BROADCAST_BYTES, whatever its number of rows; beyond that Spark shuffles both sides."""
    size = df.agg(F.sum(weight(df))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, out: str, label: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``group`` up
    to and with this row in ``order``; rows that tie get the same sum.

    Rows are range-partitioned by group and order, so a hot group spreads over
    as many tasks as it needs; sums of whole partitions give the offsets.
    """
    dealt = df.repartitionByRange(partitions(df.sparkSession), *group, *order)
    dealt = stage(dealt.withColumn("_ng_part", F.spark_partition_id()), label)
    sums = dealt.groupBy("_ng_part", *group).agg(F.sum(value).alias("_ng_sum"))
    before = Window.partitionBy(*group).orderBy("_ng_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_ng_before", F.coalesce(F.sum("_ng_sum").over(before), F.lit(0))).drop("_ng_sum")
    keys = ["_ng_part", *group]
    within = Window.partitionBy(*keys).orderBy(*order)
    total = F.sum(value).over(within) + F.col("_ng_before")
    return matched(dealt, offsets, keys).withColumn(out, total).drop("_ng_part", "_ng_before")


def components(edges: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest
    node of its connected component. Alternating large-star and small-star
    rounds, each written to the shared folder; nothing is collected."""
    a, b = F.col("a"), F.col("b")

    def tidy(df: DataFrame) -> DataFrame:
        return df.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()

    def print_of(df: DataFrame):
        return df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()

    current = stage(tidy(edges), f"{label}-edges")
    seen = print_of(current)
    for _ in range(max_rounds):
        both = current.unionByName(current.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), a).alias("m"))
        large = both.join(low, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b"))
        large = tidy(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        starred = large.join(low, "a").select(F.explode(F.array(F.struct(b.alias("a"), F.col("m").alias("b")), F.struct(a.alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        after = stage(tidy(starred), f"{label}-stars")
        now = print_of(after)
        unstage(current)
        current = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = current.select(a.alias("node"), b.alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns of these names, in any case: an operator's own
    output columns replace input columns of the same name."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])
