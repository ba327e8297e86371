"""Rows of six even lines in images. Only profiles leave the pixels; runs, even
groups, peaks and merges are the operators over ordered rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notegrid.config import DEFAULTS, Thresholds
from notegrid.operators.image import ink_of, joined, pixels
from notegrid.operators.layout import origin_x
from notegrid.operators.ordered import even_groups, isolated_peaks, merge_spans, true_runs, weighted_runs
from notegrid.sources.shared import staged

KEY = ["video_id", "k"]


def line_covers(images: DataFrame) -> DataFrame:
    """(video_id, k, y, cover): the share of ink in each pixel row (PRJ-2, AGG-4)."""
    def run(batches):
        for pdf in batches:
            covers = [ink_of(pixels(px, h, w)).mean(axis=1) for px, h, w in zip(pdf["px"], pdf["h"], pdf["w"])]
            yield pd.DataFrame({"video_id": pdf["video_id"], "k": pdf["k"], "cover": covers})

    covers = images.select(*KEY, "h", "w", "px").mapInPandas(run, f"video_id {dict(images.dtypes)['video_id']}, k int, cover array<double>")
    return covers.select(*KEY, F.posexplode("cover").alias("y", "cover"))


def column_profiles(images: DataFrame, rows: DataFrame) -> DataFrame:
    """(video_id, k, row, x, full, cover): for each column whether all lines of
    the row have ink in it (AGG-6), and its share of ink from the first line to
    the last (AGG-4)."""
    both = joined(images.select(*KEY, "h", "w", "px"), rows.select(*KEY, "row", "line_spans"), KEY)

    def run(batches):
        for pdf in batches:
            full, cover = [], []
            for r in pdf.itertuples():
                ink = ink_of(pixels(r.px, r.h, r.w))
                spans = [(int(a), int(b) + 1) for a, b in r.line_spans]
                full.append(np.logical_and.reduce([ink[a:b].any(axis=0) for a, b in spans]))
                cover.append(ink[spans[0][0]:spans[-1][1]].mean(axis=0))
            yield pd.DataFrame({"video_id": pdf["video_id"], "k": pdf["k"], "row": pdf["row"], "full": full, "cover": cover})

    arrays = both.mapInPandas(run, f"video_id {dict(images.dtypes)['video_id']}, k int, row int, full array<boolean>, cover array<double>")
    return arrays.select(*KEY, "row", F.posexplode(F.arrays_zip("full", "cover")).alias("x", "z")).select(*KEY, "row", "x", "z.full", "z.cover")


def rows_of_images(images: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """A line per row of six even lines in each image (RED-4): video_id, k, row,
    line_y, line_spans, s, extent, bar_spans, bar_x, origin_x. A row without a
    long enough run of all six lines is left out. Pixels are read twice, for the
    lines and for the columns; what is read is staged."""
    each = [*KEY, "row"]
    spans = staged(weighted_runs(line_covers(images), KEY, "y", "cover", t.line_min_cover), "line-spans")
    places = spans.withColumn("_pos", F.row_number().over(Window.partitionBy(*KEY).orderBy("a")) - 1)
    found = even_groups(spans, KEY, "centre", "a", t.line_spacing_tol).withColumn("row", F.row_number().over(Window.partitionBy(*KEY).orderBy("pos")) - 1)
    members = found.withColumn("_pos", F.explode(F.sequence(F.col("pos"), F.col("pos") + 5))).join(places, [*KEY, "_pos"])
    lines = F.sort_array(F.collect_list(F.struct("a", "b", "centre")))  # six of them
    rows = members.groupBy(*each).agg(lines.alias("l"), F.first("s").alias("s"))
    rows = staged(rows.select(*each, "s", F.col("l.centre").alias("line_y"), F.transform("l", lambda x: F.array(x["a"], x["b"])).alias("line_spans")), "staff-lines")
    profiles = staged(column_profiles(images, rows), "staff-profiles")
    spacing = rows.select(*each, "s")
    long = true_runs(profiles, each, ["x"], F.col("full")).join(spacing, each).where(F.col("b") - F.col("a") + 1 >= F.lit(t.extent_min_run) * F.col("s"))
    extents = long.groupBy(*each).agg(F.min("a").alias("left"), F.max("b").alias("right"))
    bars = isolated_peaks(profiles, each, ["x"], "cover", t.bar_min_cover, t.bar_edge_max_cover).select(*each, "a", "b")
    bars = bars.join(extents, each).where("a >= left AND b <= right").select(*each, "a", "b").join(spacing, each)
    merged = merge_spans(bars, each, "a", "b", F.lit(t.bar_merge) * F.col("s"))
    merged = merged.groupBy(*each).agg(F.sort_array(F.collect_list(F.struct("a", "b", "centre"))).alias("bars"))
    out = rows.join(extents, each).join(merged, each, "left")
    none = F.array().cast("array<struct<a: int, b: int, centre: double>>")
    out = out.withColumn("bars", F.coalesce("bars", none)).withColumn("bar_x", F.col("bars.centre"))
    return out.select(*each, "line_y", "line_spans", "s", F.array("left", "right").alias("extent"), F.transform("bars", lambda x: F.array(x["a"], x["b"])).alias("bar_spans"), "bar_x", origin_x("bar_x", "left", "s").alias("origin_x"))
