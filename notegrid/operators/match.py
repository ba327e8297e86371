"""Tolerance join, one-to-one assignment, metrics and targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrid.config import TARGETS
from notegrid.operators.ordered import ranked_median
from notegrid.sources.shared import staged


def candidate_pairs(truth: DataFrame, pred: DataFrame, keys: list[str], tol) -> DataFrame:
    """All pairs of equal keys with abs(dx) <= tol (JOI-1). Both sides have
    (keys, i or j, x). x is dealt into buckets of width tol and the prediction
    probes three of them, so a hot key does not meet itself row by row."""
    t = truth.withColumn("_b", F.floor(F.col("x") / tol)).withColumnRenamed("x", "tx")
    p = pred.withColumn("_p", F.floor(F.col("x") / tol)).withColumn("_b", F.explode(F.array(F.col("_p") - 1, F.col("_p"), F.col("_p") + 1))).drop("_p").withColumnRenamed("x", "px")
    return t.join(p, [*keys, "_b"]).withColumn("dx", F.abs(F.col("tx") - F.col("px"))).where(F.col("dx") <= tol).drop("_b")


def match_pairs(truth: DataFrame, pred: DataFrame, keys: list[str], tol, rounds: int = 200) -> DataFrame:
    """One-to-one assignment, nearest first, ties by i, then j (JOI-2, TOP-6).

    Under the total order (dx, i, j), a pair that is first at both of its ends
    is in the assignment whatever happens elsewhere; such pairs are taken and
    the pairs that touch them dropped, round after round. Rounds are joins over
    ends, so no key or cluster is one task's work, and a round leaves few of the
    pairs of the one before."""
    left, out = staged(candidate_pairs(truth, pred, keys, tol).select(*keys, "i", "j", "dx"), "pairs"), None
    edge = F.struct("dx", "i", "j")
    for _ in range(rounds):
        first = [left.groupBy(*keys, end).agg(F.min(edge).alias(f"_{end}")) for end in "ij"]
        marked = left.join(first[0], [*keys, "i"]).join(first[1], [*keys, "j"])
        marked = staged(marked.select(*keys, "i", "j", "dx", (F.col("_i") == edge).alias("_a"), (F.col("_j") == edge).alias("_b")), "pairs")
        taken = marked.where("_a AND _b").select(*keys, "i", "j", "dx")
        out = taken if out is None else out.unionByName(taken)
        rest = marked.where("NOT (_a AND _b)").join(taken.select(*keys, "i"), [*keys, "i"], "left_anti").join(taken.select(*keys, "j"), [*keys, "j"], "left_anti")
        left = staged(rest.select(*keys, "i", "j", "dx"), "pairs")
        if left.isEmpty():
            return out.select(*keys, "i", "j", "dx").hint("merge")  # a union of staged tables
    raise RuntimeError(f"the assignment did not settle in {rounds} rounds")


def metrics(matched: DataFrame, truth: DataFrame, pred: DataFrame, width: float, keys: list[str]) -> DataFrame:
    """Counts and null-safe fractions of matched notes (AGG-13, AGG-14, SET-2).

    truth: keys, i, x, fret; pred: keys, j, x, fret, flagged; matched: keys, i, j, dx."""
    t, p = truth.withColumnRenamed("fret", "true_fret").drop("x"), pred.drop("x")
    m = matched.select(*keys, "i", "j", "dx").join(t, [*keys, "i"]).join(p, [*keys, "j"])
    wrong = ~F.col("true_fret").eqNullSafe(F.col("fret"))
    hit = m.agg(F.count("*").alias("matched"), F.count_if(wrong).alias("wrong_fret"), F.count_if(wrong & F.col("flagged")).alias("wrong_flagged"), F.max(F.col("dx") / width).alias("x_error_max"))
    middle = ranked_median(matched.withColumn("_e", F.col("dx") / width), [], "_e").withColumnRenamed("median", "x_error_median")
    extra = p.join(matched.select(*keys, "j"), [*keys, "j"], "left_anti").agg(F.count("*").alias("extra"), F.count_if("flagged").alias("extra_flagged"))
    missing = t.join(matched.select(*keys, "i"), [*keys, "i"], "left_anti").agg(F.count("*").alias("missing"))
    total = p.agg(F.count("*").alias("n_pred"), F.count_if("flagged").alias("flagged"))
    one = hit.withColumn("_k", F.lit(1))
    for part in (middle, extra, missing, total):  # single rows
        one = one.join(part.withColumn("_k", F.lit(1)), "_k")
    one = one.withColumn("n_true", F.col("matched") + F.col("missing"))
    errors = F.col("missing") + F.col("extra") + F.col("wrong_fret") - F.col("extra_flagged") - F.col("wrong_flagged")
    one = one.withColumns({"unflagged_errors": errors, "flagged_errors": F.col("extra_flagged") + F.col("wrong_flagged")})
    share = F.try_divide
    return one.select("matched", "missing", "extra", "wrong_fret", "unflagged_errors", "flagged", "flagged_errors",
                      share(F.col("matched"), F.col("n_true")).alias("recall"), share(F.col("matched"), F.col("n_pred")).alias("precision"),
                      share(F.col("matched") - F.col("wrong_fret"), F.col("matched")).alias("fret_accuracy"), share(F.col("unflagged_errors"), F.col("n_true")).alias("unflagged_frac"),
                      "x_error_median", "x_error_max", share(F.col("flagged"), F.col("n_pred")).alias("flag_rate"), share(F.col("flagged_errors"), F.col("flagged")).alias("flag_precision"))


def metrics_by(matched: DataFrame, truth: DataFrame, pred: DataFrame, keys: list[str], by: str, width: str) -> DataFrame:
    """The metrics of :func:`metrics` for each ``by`` (one of ``keys``, as is
    ``width``), from one aggregation over hits, misses and extras. A ``by`` with
    notes on one side only has its row; one without any has none."""
    t, p = truth.withColumnRenamed("fret", "true_fret").drop("x"), pred.drop("x")
    hit = matched.select(*keys, "i", "j", "dx").join(t, [*keys, "i"]).join(p, [*keys, "j"])
    none = F.lit(None).cast("double")
    hit = hit.select(by, F.lit("hit").alias("kind"), (~F.col("true_fret").eqNullSafe(F.col("fret"))).alias("wrong"), "flagged", (F.col("dx") / F.col(width)).alias("error"))
    extra = p.join(matched.select(*keys, "j"), [*keys, "j"], "left_anti").select(by, F.lit("extra").alias("kind"), F.lit(False).alias("wrong"), "flagged", none.alias("error"))
    missing = t.join(matched.select(*keys, "i"), [*keys, "i"], "left_anti").select(by, F.lit("missing").alias("kind"), F.lit(False).alias("wrong"), F.lit(False).alias("flagged"), none.alias("error"))
    is_hit, bad = F.col("kind") == "hit", F.col("wrong") | (F.col("kind") == "extra")
    out = hit.unionByName(extra).unionByName(missing).groupBy(by).agg(
        F.count_if(is_hit).alias("matched"), F.count_if(F.col("kind") == "missing").alias("missing"), F.count_if(F.col("kind") == "extra").alias("extra"), F.count_if("wrong").alias("wrong_fret"),
        F.count_if(F.col("kind").eqNullSafe("missing") | (bad & ~F.col("flagged"))).alias("unflagged_errors"), F.count_if("flagged").alias("flagged"), F.count_if(bad & F.col("flagged")).alias("flagged_errors"),
        F.max("error").alias("x_error_max"))
    out = out.join(ranked_median(hit, [by], "error").withColumnRenamed("median", "x_error_median"), by, "left")
    n_true, n_pred, share = F.col("matched") + F.col("missing"), F.col("matched") + F.col("extra"), F.try_divide
    return out.withColumns({"recall": share("matched", n_true), "precision": share("matched", n_pred), "fret_accuracy": share(F.col("matched") - F.col("wrong_fret"), F.col("matched")),
                            "unflagged_frac": share("unflagged_errors", n_true), "flag_rate": share("flagged", n_pred), "flag_precision": share("flagged_errors", "flagged")})


def targets_failed(measured: DataFrame, targets=TARGETS) -> DataFrame:
    """Targets that a metric misses; a null always misses (FLT-15)."""
    spark: SparkSession = measured.sparkSession
    names = [t[0] for t in targets]
    long = measured.unpivot([], names, "metric", "value") if len(names) > 1 else measured.select(F.lit(names[0]).alias("metric"), F.col(names[0]).alias("value"))
    bounds = spark.createDataFrame(list(targets), "metric string, kind string, bound double")
    missed = F.col("value").isNull() | ((F.col("kind") == "min") & (F.col("value") < F.col("bound"))) | ((F.col("kind") == "max") & (F.col("value") > F.col("bound")))
    return long.join(F.broadcast(bounds), "metric").where(missed)  # a row per target
