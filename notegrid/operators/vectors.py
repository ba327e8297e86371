"""Correlation, shift scans, medians, templates, coverage and thresholds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def ncc(a: str, b: str, n: str) -> str:
    """SQL of the zero-mean correlation of two arrays of ``n`` doubles: centred
    first, 0 if one is flat (AGG-3)."""
    mean = lambda v: f"(aggregate({v}, 0D, (s, x) -> s + x) / {n})"
    return f"""transform(array(struct({mean(a)} AS ma, {mean(b)} AS mb)), m ->
        transform(array(aggregate(zip_with({a}, {b}, (x, y) -> struct(x - m.ma AS x, y - m.mb AS y)), struct(0D AS xy, 0D AS xx, 0D AS yy),
            (s, z) -> struct(s.xy + z.x * z.y AS xy, s.xx + z.x * z.x AS xx, s.yy + z.y * z.y AS yy))),
            s -> CASE WHEN s.xx * s.yy > 0 THEN s.xy / sqrt(s.xx * s.yy) ELSE 0D END)[0])[0]"""


def next_pairs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Each row with the one after it (JOI-13)."""
    by = Window.partitionBy(*keys).orderBy(order)
    out = df.withColumns({"next_id": F.lead(order).over(by), "next_value": F.lead(value).over(by)})
    return out.where("next_id IS NOT NULL")


def shift_scores(a: np.ndarray, b: np.ndarray, overlap: int) -> np.ndarray:
    """Correlation of a's right part with b's left part at every shift that
    leaves ``overlap`` values, 0 where one is flat: all products by one
    transform, all sums by running ones."""
    n = len(a)
    shifts = np.arange(n - overlap + 1)
    a, b = a - a.mean(), b - b.mean()  # no score changes, and no digits are lost to a common level
    size = 2 * n
    both = np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size)[shifts]
    left = n - shifts
    right_of = lambda v: v[::-1].cumsum()[::-1][shifts]
    left_of = lambda v: v.cumsum()[left - 1]
    spread = lambda s, q: np.maximum(q - s * s / left, 0.0)
    va, vb = spread(right_of(a), right_of(a * a)), spread(left_of(b), left_of(b * b))
    flat = (va <= 1e-12 * (a * a).sum()) | (vb <= 1e-12 * (b * b).sum())
    return np.where(flat, 0.0, (both - right_of(a) * left_of(b) / left) / np.sqrt(np.where(flat, 1.0, va * vb)))


def shift_scan(pairs: DataFrame, a: str, b: str, overlap: int) -> DataFrame:
    """``pairs`` plus scores, an array of (dx, ncc) at every shift that leaves
    ``overlap`` values (JOI-12): a transform for each pair, not a pass for each shift."""
    kinds = StructType([*pairs.schema.fields, *StructType.fromDDL("scores array<struct<dx: int, ncc: double>>").fields])
    kind = pa.list_(pa.struct([("dx", pa.int32()), ("ncc", pa.float64())]))

    def run(batches):
        for batch in batches:
            scores = [[{"dx": k, "ncc": round(float(x), 6) + 0.0} for k, x in enumerate(shift_scores(np.array(p, float), np.array(q, float), overlap))]
                      for p, q in zip(batch.column(batch.schema.get_field_index(a)).to_pylist(), batch.column(batch.schema.get_field_index(b)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, kind)], names=[*batch.schema.names, "scores"])

    return pairs.mapInArrow(run, kinds)


def best_shift(scanned: DataFrame, exclude: int) -> DataFrame:
    """The best score, smallest shift on ties, and the best one farther than
    ``exclude`` from it, null if there is none (TOP-1, TOP-2)."""
    top = "array_max(transform(scores, s -> struct(s.ncc AS ncc, -s.dx AS neg)))"
    out = scanned.withColumn("_best", F.expr(top))
    out = out.withColumn("_second", F.expr(f"array_max(transform(filter(scores, s -> abs(s.dx + _best.neg) > {exclude}), s -> struct(s.ncc AS ncc, -s.dx AS neg)))"))
    return out.withColumns({"shift": -F.col("_best.neg"), "ncc": F.col("_best.ncc"), "second_shift": -F.col("_second.neg"), "second_ncc": F.col("_second.ncc")}).drop("_best", "_second", "scores")


def refusal(least: float, margin: float):
    """First reason why a stitch is refused, in order (CHK-4)."""
    return F.when(F.col("ncc") < least, "ncc").when(F.col("second_ncc").isNotNull() & (F.round(F.col("ncc") - F.col("second_ncc"), 6) < margin), "ambiguous")


def element_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median of every position over the rows of a key (AGG-2, AGG-11), nulls
    left out. Ranks from a sort, which spills, in place of an aggregate that
    holds every distinct value of a key in memory."""
    each = df.select(*keys, F.posexplode(value).alias("pos", "v")).withColumn("v", F.col("v").cast("double")).where("v IS NOT NULL")
    whole = Window.partitionBy(*keys, "pos")
    each = each.withColumns({"r": F.row_number().over(whole.orderBy("v")), "n": F.count("*").over(whole)})
    middle = each.where("r = (n + 1) DIV 2 OR r = (n + 2) DIV 2")
    return middle.groupBy(*keys, "pos").agg(F.avg("v").alias("median"))


def leave_one_out_medians(df: DataFrame, label: str, member: str, value: str) -> DataFrame:
    """Median of every position over the other members of the class (AGG-12);
    null if there are none. One sort of each class and position: leaving out
    a row moves the median among the three values in the middle, which windows
    find without a list of the class."""
    each = df.select(label, member, F.posexplode(value).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    whole = Window.partitionBy(label, "pos")
    each = each.withColumns({"r": F.row_number().over(whole.orderBy("v", member)), "n": F.count("*").over(whole)})
    each = each.withColumn("m", F.expr("CAST(n DIV 2 AS INT)"))
    middle = {name: F.max(F.when(F.col("r") == F.col("m") + k, F.col("v"))).over(whole) for k, name in enumerate(("low", "mid", "high"))}
    left = (F.when(F.col("n") == 1, F.lit(None))
            .when(F.col("n") % 2 == 0, F.when(F.col("r") > F.col("m"), F.col("low")).otherwise(F.col("mid")))
            .when(F.col("r") <= F.col("m"), (F.col("mid") + F.col("high")) / 2)
            .when(F.col("r") == F.col("m") + 1, (F.col("low") + F.col("high")) / 2).otherwise((F.col("low") + F.col("mid")) / 2))
    return each.withColumns(middle).select(label, member, "pos", "v", left.alias("loo"))


def grouped_ncc(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Correlation of two columns within a key, centred by window means (AGG-3)."""
    by = Window.partitionBy(*keys)
    c = df.withColumns({"_a": F.col(a) - F.avg(a).over(by), "_b": F.col(b) - F.avg(b).over(by)})
    s = c.groupBy(*keys).agg(F.sum(F.col("_a") * F.col("_b")).alias("ab"), F.sum(F.col("_a") * F.col("_a")).alias("aa"), F.sum(F.col("_b") * F.col("_b")).alias("bb"))
    return s.select(*keys, F.when(F.col("aa") * F.col("bb") > 0, F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).otherwise(0.0).alias("ncc"))


def read_template(scores: DataFrame, keys: list[str], least: float, margin: float) -> DataFrame:
    """Best class by (ncc, class), both descending, its margin over the second,
    and whether it is accepted (TOP-3, FLT-11)."""
    top = scores.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(F.struct("ncc", "digit")), False), 1, 2).alias("top"))
    out = top.withColumns({"digit": F.get("top", 0)["digit"], "best": F.get("top", 0)["ncc"], "margin": F.round(F.get("top", 0)["ncc"] - F.get("top", 1)["ncc"], 6)})
    ok = (F.col("best") >= least) & (F.col("margin").isNull() | (F.col("margin") >= margin))
    return out.withColumn("accepted", ok).drop("top")


def _normed(values):
    """An array centred and scaled to length 1, zeros if it is flat."""
    n = F.size(values)
    total = lambda v, f: F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x))
    one = lambda v, body: F.get(F.transform(F.array(v), body), 0)  # noqa: E731  computed once
    centred = one(total(values, lambda x: x) / n, lambda m: F.transform(values, lambda x: x - m))
    return one(centred, lambda c: one(total(c, lambda x: x * x), lambda q: F.transform(c, lambda x: F.when(q > 0, x / F.sqrt(q)).otherwise(0.0))))


def class_scores(df: DataFrame, label: str, member: str, value: str, templates: DataFrame | None = None) -> DataFrame:
    """Correlation of every row with every class's median (JOI-14, AGG-11):
    ``member``, digit, ncc. Classes are few: their templates are one row of
    normed arrays, so a row meets them without a shuffle or an explode."""
    medians = element_medians(templates if templates is not None else df.where(F.col(label).isNotNull()), [label], value)
    arrays = medians.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "median"))), lambda x: x["median"]).alias("m"))
    one = arrays.select(F.col(label).alias("digit"), _normed(F.col("m")).alias("m")).agg(F.sort_array(F.collect_list(F.struct("digit", "m"))).alias("classes"))
    rows = df.select(member, _normed(F.transform(value, lambda x: x.cast("double"))).alias("_v")).withColumn("_c", F.explode(one.scalar()))
    dot = F.aggregate(F.zip_with("_v", "_c.m", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return rows.select(member, "_c.digit", F.round(dot, 6).alias("ncc"))


def template_scores(df: DataFrame, label: str, member: str, value: str, class_least: float, least_members: int) -> DataFrame:
    """Correlation of every row with every class's template (AGG-12, FLT-10):
    ``member``, digit, ncc.

    A row under ``class_least`` with the median of its class without it is an
    outlier and leaves the template; a class needs ``least_members`` rows after
    that. A member meets its own class's template without itself, everything
    else the whole one. Rows without a label are only read. Correlations are
    rounded to six places, so that thresholds do not hang on summation order."""
    loo = leave_one_out_medians(df.where(F.col(label).isNotNull()), label, member, value).where("loo IS NOT NULL")
    outliers = grouped_ncc(loo, [member], "v", "loo").where(F.round("ncc", 6) < class_least).select(member)
    kept = df.where(F.col(label).isNotNull()).join(outliers, member, "left_anti")
    classes = kept.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") >= least_members).select(label)
    kept = kept.join(classes, label)
    own = grouped_ncc(leave_one_out_medians(kept, label, member, value), [member, label], "v", "loo").select(member, F.col(label).alias("digit"), F.round("ncc", 6).alias("ncc"))
    mine = kept.select(F.col(member), F.col(label).alias("digit"))
    other = class_scores(df, label, member, value, kept).join(mine, [member, "digit"], "left_anti")
    return own.unionByName(other)


def otsu_levels(df: DataFrame, keys: list[str], level: str, levels: int = 256) -> DataFrame:
    """Smallest level that splits a key's histogram with the largest variance
    between classes (PRJ-2)."""
    hist = df.groupBy(*keys, F.col(level).alias("level")).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    mass = F.col("n") * F.col("level")
    cum = hist.withColumns({"below": F.sum("n").over(by), "mass": F.sum(mass).over(by), "all": F.sum("n").over(every), "all_mass": F.sum(mass).over(every)})
    above = F.col("all") - F.col("below")
    gap = F.try_divide(F.col("mass"), F.col("below")) - F.try_divide(F.col("all_mass") - F.col("mass"), above)
    cum = cum.withColumn("between", F.round(F.coalesce(F.col("below") * 1.0 * above * gap * gap, F.lit(0.0)), 3))
    best = cum.groupBy(*keys).agg(F.max(F.struct(F.col("between"), (-F.col("level")).alias("neg"))).alias("b"))
    return best.select(*keys, (-F.col("b.neg")).alias("threshold"))


def nearest_residual(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Largest distance from a position on either side to its nearest on the
    other (JOI-7): state is 'none' if both sides are empty, 'one side' if one is
    (the residual is then infinite). One sort of both sides: the nearest is the
    last of the other side before or the first after."""
    side = lambda c, k: df.select(*keys, F.explode(c).alias("_x"), F.lit(k).alias("_side"))
    both = side(a, 0).unionByName(side(b, 1))
    by = Window.partitionBy(*keys).orderBy("_x", "_side")
    upto, onward = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    of = lambda k: F.when(F.col("_side") == k, F.col("_x"))
    near = lambda k: F.least(F.col("_x") - F.last(of(k), ignorenulls=True).over(upto), F.first(of(k), ignorenulls=True).over(onward) - F.col("_x"))
    far = both.withColumn("_d", F.when(F.col("_side") == 0, near(1)).otherwise(near(0))).groupBy(*keys).agg(F.max("_d").alias("residual"))
    state = F.when((F.size(a) == 0) & (F.size(b) == 0), "none").when((F.size(a) == 0) | (F.size(b) == 0), "one side").otherwise("both")
    return df.select(*keys, state.alias("state")).join(far, keys, "left")


def composite(strips: DataFrame, keys: list[str], offset: str, value: str) -> DataFrame:
    """Least value of overlapping strips at each place of the canvas (PRJ-21)."""
    each = strips.select(*keys, F.col(offset).alias("_o"), F.posexplode(value).alias("pos", "v"))
    return each.withColumn("x", F.col("_o") + F.col("pos")).groupBy(*keys, "x").agg(F.min("v").alias("v"))


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Zero-mean correlation of two arrays, 0 if one is flat (AGG-3)."""
    x, y = (np.ravel(v) - np.mean(v) for v in (a, b))
    scale = np.linalg.norm(x) * np.linalg.norm(y)
    return float(np.dot(x, y) / scale) if scale else 0.0


def thinned(members: list, most: int) -> list:
    """At most ``most`` evenly spaced members, places rounded half to even (TOP-7)."""
    return members if len(members) <= most else [members[int(i)] for i in np.rint(np.linspace(0, len(members) - 1, most))]


def merge_similar(df: DataFrame, keys: list[str], order: str, value: str, least: float, most: int = 31) -> DataFrame:
    """Neighbours merged while the next correlates by ``least`` with the median
    of what is merged so far (WIN-11): keys, first and last ``order``, n.

    The median is of at most ``most`` members, so each merge changes what the
    next row is compared with: one pass over sorted rows, holding one run."""
    width = len(keys)
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"a {kinds[order]}", f"b {kinds[order]}", "n int"])
    names = [*keys, "a", "b", "n"]

    def run(batches):
        group, first, last, members, median = None, None, None, [], None
        for pdf in batches:
            done = []
            for row in zip(*[pdf[c] for c in pdf.columns]):
                own, at, v = row[:width], row[width], np.asarray(row[width + 1], dtype=float)
                if own == group and correlation(median, v) >= least:
                    last, members = at, [*members, v]
                    median = np.median(np.stack(thinned(members, most)), axis=0)
                else:
                    if members:
                        done.append((*group, first, last, len(members)))
                    group, first, last, members, median = own, at, at, [v], v
            yield pd.DataFrame(done, columns=names)
        if members:
            yield pd.DataFrame([(*group, first, last, len(members))], columns=names)

    dealt = df.select(*keys, order, value).repartition(*keys).sortWithinPartitions(*keys, order)
    return dealt.mapInPandas(run, schema)
