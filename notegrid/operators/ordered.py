"""Ordered-row operators: lag differences, islands, anchored runs, gap merges,
numbering, near-even buckets, samples and cuts. All keyed: nothing sorts the
whole table in one task."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from notegrid.sources.shared import staged


def _over(keys, order):
    return Window.partitionBy(*keys).orderBy(*order)


def change_series(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Absolute difference to the row before, 0 for the first (WIN-1)."""
    before = F.lag(value).over(_over(keys, order))
    return df.withColumn("change", F.coalesce(F.abs(F.col(value) - before), F.lit(0.0)))


def true_runs(df: DataFrame, keys: list[str], order: list[str], mask, least: int = 1) -> DataFrame:
    """Maximal runs of rows where ``mask`` holds: first and last position,
    both inclusive, of runs of at least ``least`` rows (WIN-2, FLT-2)."""
    placed = df.withColumn("_pos", F.row_number().over(_over(keys, order)) - 1).where(mask)
    island = F.col("_pos") - F.row_number().over(_over(keys, ["_pos"]))
    runs = placed.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("_pos").alias("a"), F.max("_pos").alias("b"))
    return runs.where(F.col("b") - F.col("a") + 1 >= least).drop("_island")


def weighted_runs(df: DataFrame, keys: list[str], pos: str, weight: str, least: float) -> DataFrame:
    """Runs of neighbouring positions of at least ``least`` weight: first and
    last position, and their centre by weight (WIN-2, AGG-5)."""
    heavy = df.where(F.col(weight) >= least)
    island = F.col(pos) - F.row_number().over(_over(keys, [pos]))
    runs = heavy.withColumn("_island", island).groupBy(*keys, "_island")
    return runs.agg(F.min(pos).alias("a"), F.max(pos).alias("b"), (F.sum(F.col(pos) * F.col(weight)) / F.sum(weight)).alias("centre")).drop("_island")


def anchored_runs(df: DataFrame, keys: list[str], t: str, row: str, value: str, step: float, drift: float) -> DataFrame:
    """Runs that go on while a row is nearer than ``step`` to the row before
    and nearer than ``drift`` to the run's first row (WIN-3). One pass over
    sorted rows that holds one open run, whatever a key's length."""
    width, kinds = len(keys), dict(df.dtypes)
    names = [*keys, "i0", "i1", "t0", "t1", "n"]

    def run(batches):
        group, open_run, anchor, last = None, None, None, None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            done = []
            for own, (at, i, v) in zip(zip(*columns[:width]), zip(*columns[width:])):
                if own == group and abs(v - last) < step and abs(v - anchor) < drift:
                    open_run[1], open_run[3], open_run[4] = i, at, open_run[4] + 1
                else:
                    if open_run:
                        done.append((*group, *open_run))
                    group, open_run, anchor = own, [i, i, at, at, 1], v
                last = v
            yield batch_of(done)
        if open_run:
            yield batch_of([(*group, *open_run)])

    schema = df.select(*keys, F.col(row).alias("i0"), F.col(row).alias("i1"), F.col(t).alias("t0"), F.col(t).alias("t1"), F.lit(1).alias("n")).schema
    arrow = to_arrow_schema(schema)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], names=names)

    dealt = df.select(*keys, t, row, F.col(value).cast("double").alias("_v")).repartition(*keys).sortWithinPartitions(*keys, t, row)
    return dealt.mapInArrow(run, schema)


def merge_spans(df: DataFrame, keys: list[str], a: str, b: str, gap, order: list[str] | None = None) -> DataFrame:
    """Spans sorted by start, merged while the next starts within ``gap`` of
    the end before (WIN-5); with the centre of each (PRJ-5)."""
    by = _over(keys, order or [a])
    new = (F.col(a) - F.lag(b).over(by) > gap).cast("int")
    marked = df.withColumn("_new", F.coalesce(new, F.lit(0)))
    marked = marked.withColumn("_group", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(*keys, "_group").agg(F.min(a).alias("a"), F.max(b).alias("b"), F.count("*").alias("n"))
    return out.drop("_group").withColumn("centre", (F.col("a") + F.col("b")) / 2)


def ranked_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median of the rows of each key, of all without keys, nulls left out. Values
    are counted before they meet, so a hot key costs its distinct values, and
    ranks come from running sums, which spill, not from an aggregate's list."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    if not keys:
        return _whole_median(counts)
    by = Window.partitionBy(*keys)
    placed = counts.withColumns({"_upto": F.sum("_n").over(by.orderBy("_x")), "_all": F.sum("_n").over(by)})
    low, high = F.expr("(_all + 1) DIV 2"), F.expr("(_all + 2) DIV 2")
    holds = lambda r: (F.col("_upto") >= r) & (F.col("_upto") - F.col("_n") < r)
    return placed.groupBy(*keys).agg(((F.max(F.when(holds(low), F.col("_x"))) + F.max(F.when(holds(high), F.col("_x")))) / 2).alias("median"))


def _whole_median(counts: DataFrame) -> DataFrame:
    """The median of all counted values, one row. Values are dealt by range; the
    sums of whole partitions, a row each, tell which one holds a rank, and only
    that one is sorted."""
    spark = counts.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = staged(counts.repartitionByRange(parts, "_x").withColumn("_part", F.spark_partition_id()), "median")
    sums = dealt.groupBy("_part").agg(F.sum("_n").alias("n")).orderBy("_part").collect()
    total, found = sum(r.n for r in sums), []
    for rank in ((total + 1) // 2, (total + 2) // 2) if total else ():
        for r in sums:
            if rank <= r.n:
                upto = F.sum("_n").over(Window.partitionBy("_part").orderBy("_x"))
                held = dealt.where(F.col("_part") == r["_part"]).withColumn("_upto", upto).where(F.col("_upto") >= rank)
                found.append(held.agg(F.min("_x")).first()[0])
                break
            rank -= r.n
    return spark.createDataFrame([(sum(found) / 2 if found else None,)], "median double")


def join_marks(df: DataFrame, keys: list[str], box: tuple[str, str, str, str], tie: str, overlap: float, gap: float, scope: list[str] | None = None) -> DataFrame:
    """Marks of a line joined to the mark before if they overlap in height by
    ``overlap`` of the smaller and stand closer than ``gap`` median widths
    (WIN-6, AGG-7, AGG-8). The median is over all marks, or over all of the same
    ``scope``, columns that are never null."""
    x0, y0, x1, y1 = box
    widths = ranked_median(df.withColumn("_w", F.col(x1) - F.col(x0) + 1), scope or [], "_w").withColumnRenamed("median", "_width")
    if scope:
        df, width = df.join(widths, scope), F.col("_width")
    else:
        width = widths.scalar()
    by = _over(keys, [x0, tie])
    p0, p1, px = (F.lag(c).over(by) for c in (y0, y1, x1))
    high = F.least(F.col(y1), p1) - F.greatest(F.col(y0), p0) + 1
    least = F.least(F.col(y1) - F.col(y0), p1 - p0) + 1
    joined = (high >= F.lit(overlap) * least) & (F.col(x0) - px - 1 < F.lit(gap) * width)
    marked = df.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("_note", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_note").agg(F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max(x1).alias("x1"), F.max(y1).alias("y1"), F.count("*").alias("digits")).drop("_note")


def near_even_groups(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """Deal ordered rows into the least number of groups of at most ``most``,
    sizes as even as can be, larger first (WIN-10)."""
    n = F.count("*").over(Window.partitionBy(*keys))
    i = F.row_number().over(_over(keys, order)) - 1
    out = df.withColumns({"_n": n, "_i": i}).withColumn("_g", F.ceil(F.col("_n") / most))
    out = out.withColumn("_q", F.expr("_n div _g")).withColumn("_r", F.col("_n") % F.col("_g"))
    group = F.expr("CASE WHEN _i < _r * (_q + 1) THEN _i div (_q + 1) ELSE _r + (_i - _r * (_q + 1)) div _q END")
    out = out.withColumn("grid", group.cast("int"))
    at = F.row_number().over(_over([*keys, "grid"], order)) - 1
    return out.withColumn("cell", at).drop("_n", "_i", "_g", "_q", "_r")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Rows of a key numbered from 0 in order (WIN-9, TOP-5)."""
    return df.withColumn(name, F.row_number().over(_over(keys, order)) - 1)


def coverage(df: DataFrame, keys: list[str], mask) -> DataFrame:
    """Share of a key's rows that a mask covers, and whether any or all are (AGG-4, AGG-6)."""
    return df.groupBy(*keys).agg(F.avg(F.when(mask, 1.0).otherwise(0.0)).alias("cover"), F.bool_or(mask).alias("any_ink"), F.bool_and(mask).alias("all_ink"))


def even_sample(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each key, evenly spaced by position, rounded
    half to even (TOP-7)."""
    placed = df.withColumn("_i", F.row_number().over(_over(keys, order)) - 1)
    wanted = placed.groupBy(*keys).agg(F.count("*").alias("_n"))
    k = F.least(F.col("_n"), F.lit(most))
    at = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.when(k == 1, F.lit(0.0)).otherwise(F.rint((F.col("_n") - 1) * j / (k - 1))).cast("int"))
    wanted = wanted.select(*keys, F.explode(F.array_distinct(at)).alias("_i"))
    return placed.join(wanted, [*keys, "_i"]).withColumnRenamed("_i", "position")


def time_grid(df: DataFrame, fps, count, rate: int) -> DataFrame:
    """Sample times k / rate within the duration, each with its nearest frame
    (TOP-8, JOI-8): no join is needed."""
    length = count / fps
    ks = F.filter(F.sequence(F.lit(0), F.ceil(length * rate).cast("int")), lambda k: k / rate < length)
    out = df.withColumn("k", F.explode(ks)).withColumn("t", F.col("k") / rate)
    return out.withColumn("frame", F.least(F.floor(F.col("t") * fps + 0.5), count - 1).cast("long"))


def running_offsets(df: DataFrame, keys: list[str], order: list[str], step: str) -> DataFrame:
    """Offset of each row: the sum of the steps before it, first 0 (WIN-8)."""
    by = _over(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(step).over(by), F.lit(0)))


def isolated_peaks(df: DataFrame, keys: list[str], order: list[str], cover: str, least: float, edge: float) -> DataFrame:
    """Runs of covered columns whose neighbours outside are nearly empty
    (FLT-4, WIN-12); a missing neighbour counts as empty."""
    by = _over(keys, order)
    placed = df.withColumn("_pos", F.row_number().over(by) - 1)
    island = F.col("_pos") - F.row_number().over(_over(keys, ["_pos"]))
    placed = placed.withColumns({"_before": F.coalesce(F.lag(cover).over(by), F.lit(0.0)), "_after": F.coalesce(F.lead(cover).over(by), F.lit(0.0))})
    covered = placed.where(F.col(cover) >= least).withColumn("_island", island)
    runs = covered.groupBy(*keys, "_island").agg(F.min("_pos").alias("a"), F.max("_pos").alias("b"), F.min_by("_before", "_pos").alias("left"), F.max_by("_after", "_pos").alias("right"))
    return runs.where(F.greatest("left", "right") < edge).drop("_island")


def cuts_of(bars: list[float], notes: list[float], end: float, width: float) -> list[tuple[float, float, bool]]:
    """(x0, x1, split) of the rows of one key; ``bars`` and ``notes`` are sorted
    and distinct. Each cut is found by bisection among the positions that are left."""
    middles = [(a + b) / 2 for a, b in zip(notes, notes[1:])]
    at, out = min(0.0, notes[0] if notes else 0.0), []
    while end - at > width:
        bar = bisect_right(bars, at + width) - 1
        gap = bisect_right(middles, at + width) - 1
        if bar >= 0 and bars[bar] > at:
            cut, split = bars[bar], False
        elif gap >= 0 and notes[gap] > at:
            cut, split = middles[gap], True
        else:
            cut, split = at + width, True
        out.append((at, cut, split))
        at = cut
    return [*out, (at, end, False)]


def cut_rows(spans: DataFrame, keys: list[str], bars: str, notes: str, end: str, width: float) -> DataFrame:
    """Cut a long row at the last bar that fits, else midway between notes,
    else at the width (WIN-13, TOP-4). ``bars`` and ``notes`` are sorted arrays
    of distinct positions: one key's bars and notes are one row."""
    kinds, size = dict(spans.dtypes), len(keys)
    names = [*keys, "r", "x0", "x1", "split"]

    def run(batches):
        for pdf in batches:
            rows = []
            for own in pdf.itertuples(index=False, name=None):
                found = cuts_of(*([] if a is None else list(a) for a in own[size:size + 2]), own[size + 2], float(width))
                rows += [(*own[:size], r, *c) for r, c in enumerate(found)]
            yield pd.DataFrame(rows, columns=names)

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "r int, x0 double, x1 double, split boolean"])
    return spans.select(*keys, bars, notes, F.col(end).cast("double")).mapInPandas(run, schema)


def even_groups(df: DataFrame, keys: list[str], x: str, tie: str, tol: float, size: int = 6) -> DataFrame:
    """Groups of ``size`` neighbouring positions with even gaps whose neighbours
    outside would not carry on the spacing, left to right without overlap
    (FLT-3, WIN-4, WIN-7, AGG-17): position of the first, its and the last x,
    and the spacing.

    Starts nearer than ``size`` to the start before are one cluster; any other
    start is free whatever came before, so only clusters are folded, not keys."""
    by = _over(keys, [x, tie])
    at = [F.col(x), *[F.lead(x, k).over(by) for k in range(1, size + 1)]]
    names = [f"_x{k}" for k in range(size + 1)]
    placed = df.select(*keys, (F.row_number().over(by) - 1).alias("_pos"), F.lag(x).over(by).alias("_out"), *[c.alias(n) for c, n in zip(at, names)])
    last = names[size - 1]
    placed = placed.where(F.col(last).isNotNull()).withColumn("_s", (F.col(last) - F.col("_x0")) / F.lit(float(size - 1)))
    near = lambda a, b: F.coalesce(F.abs(F.col(b) - F.col(a) - F.col("_s")) <= F.lit(tol) * F.col("_s"), F.lit(False))
    even = near(names[0], names[1])
    for a, b in zip(names[1:size - 1], names[2:size]):
        even = even & near(a, b)
    hits = placed.where(even & ~near("_out", "_x0") & ~near(last, names[size]))
    order = _over(keys, ["_pos"])
    new = F.when(F.col("_pos") - F.lag("_pos").over(order) < size, 0).otherwise(1)
    hits = hits.withColumn("_new", new).withColumn("_cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.struct(F.col("_pos").alias("pos"), F.col("_x0").alias("first"), F.col(last).alias("last"), F.col("_s").alias("s"))
    folded = hits.groupBy(*keys, "_cluster").agg(F.array_sort(F.collect_list(start)).alias("_starts"))
    kept = F.expr(f"""aggregate(_starts, slice(_starts, 1, 0), (done, c) ->
        CASE WHEN size(done) = 0 OR c.pos >= element_at(done, -1).pos + {size} THEN concat(done, array(c)) ELSE done END)""")
    return folded.select(*keys, F.explode(kept).alias("c")).select(*keys, "c.*")
