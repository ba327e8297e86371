"""Pages of a video put side by side: page checks, the shift scan over pixels,
refusals as data, canvas offsets and the composite. Tables are keyed by
(video_id, k), k the page's place; a bad video refuses itself only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notegrid.config import DEFAULTS, Thresholds
from notegrid.operators.image import joined, levels, pixels
from notegrid.operators.layout import shared_bars
from notegrid.operators.ordered import running_offsets
from notegrid.operators.vectors import nearest_residual

KEY = ["video_id", "k"]


def page_refusals(images: DataFrame, rows: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """(video_id, refused): the first page's first reason, in the order dark,
    rows (not exactly one), moved (lines off the first page's), or null (CHK-3,
    AGG-15, AGG-16)."""
    found = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.min_by("line_y", "row").alias("line_y"))
    pages = levels(images, KEY).join(found, KEY, "left")
    first = F.first("line_y").over(Window.partitionBy("video_id").orderBy("k"))
    moved = F.array_max(F.zip_with("line_y", first, lambda a, b: F.abs(a - b)))
    reason = F.when(F.col("level") < t.light_min_level, "dark").when(F.coalesce("n", F.lit(0)) != 1, "rows").when(moved > t.line_y_match, "moved")
    return pages.withColumn("reason", reason).groupBy("video_id").agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("k"))).alias("refused"))


def shift_scores(a: np.ndarray, b: np.ndarray, overlap: int) -> np.ndarray:
    """Correlation of a's right part with b's left part at every shift that
    leaves ``overlap`` columns, 0 where one is flat.

    All products come from one Fourier transform of each row and all sums from
    running ones, so a scan costs about one pass, not one for each shift. Gray
    levels are whole numbers: rounded, every sum is exact."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    high, wide = a.shape
    spectrum = (np.fft.rfft(a, 2 * wide) * np.conj(np.fft.rfft(b, 2 * wide))).sum(axis=0)
    shifts = np.arange(wide - overlap + 1)
    both = np.rint(np.fft.irfft(spectrum, 2 * wide)[shifts]).astype(np.int64)
    n = high * (wide - shifts)
    right = lambda v: v.sum(axis=0)[::-1].cumsum()[::-1][shifts]
    left = lambda v: v.sum(axis=0).cumsum()[wide - 1 - shifts]
    spread = (n * right(a * a) - right(a) ** 2).astype(float) * (n * left(b * b) - left(b) ** 2)
    return np.divide(n * both - right(a) * left(b), np.sqrt(spread), out=np.zeros(len(shifts)), where=spread > 0)


def stitched_pairs(images: DataFrame, rows: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Each page with the next (RED-3, JOI-12, JOI-13): video_id, k, shift,
    overlap, ncc, second_shift, second_ncc (the best one far from it, null if
    there is none), state and residual of their bars, and refused, the first of
    ncc, ambiguous and residual (CHK-4). Only pairs of pages with one row each."""
    kind = dict(images.dtypes)["video_id"]
    one = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.first(F.struct("line_y", "s", "extent", "bar_x")).alias("tab")).where("n = 1").drop("n")
    by = Window.partitionBy("video_id").orderBy("k")
    after = joined(images.select(*KEY, "h", "w", "px"), one.select(*KEY, "tab.line_y", "tab.s"), KEY)
    after = after.withColumns({"next_k": F.lead("k").over(by), "next_px": F.lead("px").over(by)}).where("next_k IS NOT NULL")
    names = ["video_id", "k", "next_k", "w", "shift", "ncc", "second_shift", "second_ncc"]

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                top, bottom = max(int(np.floor(r.line_y[0] - r.s)), 0), min(int(np.ceil(r.line_y[-1] + r.s)) + 1, r.h)
                a, b = (pixels(px, r.h, r.w)[top:bottom] for px in (r.px, r.next_px))
                scores = shift_scores(a, b, int(np.ceil(t.stitch_min_overlap * r.w)))
                best = int(scores.argmax())
                far = np.flatnonzero(np.abs(np.arange(len(scores)) - best) > t.stitch_exclude)
                second = int(far[scores[far].argmax()]) if len(far) else None
                out.append((r.video_id, r.k, r.next_k, r.w, best, float(scores[best]), second, None if second is None else float(scores[second])))
            yield pd.DataFrame(out, columns=names).astype({"second_shift": "Int64"})

    scored = after.mapInPandas(run, f"video_id {kind}, k int, next_k int, w int, shift int, ncc double, second_shift int, second_ncc double")
    left, right = one.withColumnRenamed("tab", "a"), one.withColumnRenamed("tab", "b").withColumnRenamed("k", "next_k")
    pairs = shared_bars(scored.join(left, KEY).join(right, ["video_id", "next_k"]), "a", "b", "shift")
    residual = nearest_residual(pairs, KEY, "bars_a", "bars_b")
    reason = (F.when(F.col("ncc") < t.stitch_min_ncc, "ncc").when(F.col("ncc") - F.col("second_ncc") < t.stitch_min_margin, "ambiguous")
              .when((F.col("state") == "one side") | (F.col("residual") > t.stitch_max_residual), "residual"))
    out = scored.join(residual, KEY).withColumn("overlap", F.col("w") - F.col("shift")).withColumn("refused", reason)
    return out.select(*KEY, "shift", "overlap", "ncc", "second_shift", "second_ncc", "state", "residual", "refused")


def page_offsets(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """Where each page stands on the canvas: the sum of the shifts before it (WIN-8)."""
    steps = images.select(*KEY).join(pairs.select(*KEY, "shift"), KEY, "left").withColumn("shift", F.coalesce("shift", F.lit(0)))
    return running_offsets(steps, ["video_id"], ["k"], "shift").select(*KEY, F.col("offset").cast("int").alias("offset"))


def canvases(images: DataFrame, offsets: DataFrame) -> DataFrame:
    """One white canvas a video with the darkest pixel of its pages (PRJ-21); a
    video's pages are one task's work."""
    kind = dict(images.dtypes)["video_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, right = int(pdf["h"].iloc[0]), int((pdf["offset"] + pdf["w"]).max())
        out = np.full((h, right), 255, np.uint8)
        for r in pdf.itertuples():
            part = out[:, r.offset:r.offset + r.w]
            np.minimum(part, pixels(r.px, r.h, r.w), out=part)
        return pd.DataFrame([(pdf["video_id"].iloc[0], 0, h, right, out.tobytes())], columns=["video_id", "k", "h", "w", "px"])

    placed = joined(images.select(*KEY, "h", "w", "px"), offsets, KEY)
    return placed.groupBy("video_id").applyInPandas(run, f"video_id {kind}, k int, h int, w int, px binary")
