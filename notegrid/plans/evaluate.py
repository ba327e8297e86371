"""Evaluation of predicted tables against true ones, each video on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.config import DEFAULTS, TARGETS
from notegrid.operators.match import match_pairs, metrics_by
from notegrid.sources.shared import staged

KEYS = ["video_id", "string", "width"]


def evaluate(truth: DataFrame, predicted: DataFrame, targets=TARGETS, tol: float = DEFAULTS.match_tol_frac) -> DataFrame:
    """A row per video of either table (as sources.tables.read_tabs gives them):
    video_id, refused, the metrics, failed (names of the targets it misses) and
    passed (CTL-6, JOI-16, CHK-6, AGG-13, FLT-15).

    A video without a truth or a prediction, with a document that was refused,
    or with unequal widths is refused and does not stop the others. Notes match
    on a string within ``tol`` of the width. A metric that is null misses its
    target; a video with no notes on either side has null metrics."""
    t = truth.select("video_id", F.struct("tab_width_px", "notes", "refused").alias("t"))
    p = predicted.select("video_id", F.struct("tab_width_px", "notes", "refused").alias("p"))
    both = t.join(p, "video_id", "full")
    reason = (F.when(F.col("t").isNull(), "no truth").when(F.col("p").isNull(), "no prediction")
              .when(F.col("t.refused").isNotNull(), F.concat(F.lit("truth: "), "t.refused")).when(F.col("p.refused").isNotNull(), F.concat(F.lit("prediction: "), "p.refused"))
              .when(F.col("t.tab_width_px") != F.col("p.tab_width_px"), "widths"))
    both = both.withColumn("refused", reason)
    fair = both.where("refused IS NULL").withColumn("width", F.col("t.tab_width_px"))
    true = fair.select("video_id", "width", F.posexplode("t.notes").alias("i", "n")).select(*KEYS[::2], "n.string", "i", "n.x", "n.fret")
    pred = fair.select("video_id", "width", F.posexplode("p.notes").alias("j", "n")).select(*KEYS[::2], "n.string", "j", "n.x", "n.fret", (F.col("n.status") == "flagged").alias("flagged"))
    true, pred = staged(true, "true-notes"), staged(pred, "predicted-notes")  # a list's order, so i and j, may differ each time it is made
    pairs = match_pairs(true.drop("fret"), pred.drop("fret", "flagged"), KEYS, F.lit(tol) * F.col("width"))
    measured = metrics_by(pairs, true, pred, KEYS, "video_id", "width")
    out = both.select("video_id", "refused").join(measured, "video_id", "left")
    missed = [F.when(F.coalesce(F.col(name) < bound if kind == "min" else F.col(name) > bound, F.lit(True)), name) for name, kind, bound in targets]
    failed = F.when(F.col("refused").isNull(), F.array_compact(F.array(*missed)))
    return out.withColumn("failed", failed).withColumn("passed", F.coalesce(F.size("failed") == 0, F.lit(False)))
