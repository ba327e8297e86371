"""Jobs: what names a video, its crop, its layout, and why a job is refused."""

from __future__ import annotations

import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUTS = ("paged-strip",)
#: Where a video's id stands in a URL (a fixed value).
VIDEO_ID = r"(?:v=|youtu\.be/|/shorts/|/embed/)([A-Za-z0-9_-]{11})"
_NUMBER = r"\s*([+-]?[0-9]{1,9})\s*"
_CROP = "^" + ",".join([_NUMBER] * 4) + "$"


def is_url(source: str) -> Column:
    return F.col(source).rlike("^https?://")


def video_id(source: str) -> Column:
    """The id in a URL, null if it has none, or a file's name without its ending (STR-1, STR-2)."""
    name = F.regexp_extract(source, r"([^/]*)/*$", 1)
    stem = F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)
    found = F.regexp_extract(source, VIDEO_ID, 1)
    return F.when(is_url(source), F.nullif(found, F.lit(""))).otherwise(stem)


def output_path(source: str, output: str) -> Column:
    """The path a sheet was asked for, else one of its video's name (LAY-2)."""
    return F.coalesce(F.col(output), F.concat(F.lit("out/"), video_id(source), F.lit(".pdf")))


def crop_of(text: str) -> Column:
    """x, y, w, h of "x,y,w,h" with w and h above 0 and x and y not below, else null (STR-3)."""
    parts = [F.regexp_extract(text, _CROP, k + 1).try_cast("int") for k in range(4)]
    x, y, w, h = parts
    fits = F.coalesce((x >= 0) & (y >= 0) & (w > 0) & (h > 0), F.lit(False))
    return F.when(fits, F.struct(*[p.alias(n) for p, n in zip(parts, "xywh")]))


def job_refusals(jobs: DataFrame, source: str = "source", crop: str = "crop", layout: str = "layout", width: str = "width", height: str = "height") -> DataFrame:
    """``jobs`` plus video_id, area (the crop) and refused, the first reason of:
    no video id, no crop, bad crop, no layout, unknown layout, no frames (a
    header that could not be read), outside (CHK-1, CHK-2, SRC-2); null if a job may run."""
    out = jobs.withColumns({"video_id": video_id(source), "area": crop_of(crop)})
    size = (F.col(width) > 0) & (F.col(height) > 0)
    beyond = (F.col("area.x") + F.col("area.w") > F.col(width)) | (F.col("area.y") + F.col("area.h") > F.col(height))
    reason = (F.when(F.col("video_id").isNull(), "no video id").when(F.col(crop).isNull(), "no crop").when(F.col("area").isNull(), "bad crop")
              .when(F.col(layout).isNull(), "no layout").when(~F.col(layout).isin(*LAYOUTS), "unknown layout").when(~F.coalesce(size, F.lit(False)), "no frames").when(beyond, "outside"))
    return out.withColumn("refused", reason)


def read_args(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, args) of every .args file of a glob, shell-quoted words in order (SRC-9,
    SRC-10). Spark's file scan leaves out empty files; such a job lacks a crop anyway."""
    @F.pandas_udf("array<string>")
    def words(text: pd.Series) -> pd.Series:
        return text.map(shlex.split)

    texts = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]*)\.args$", 1).alias("video_id"), F.decode("content", "UTF-8").alias("value"))
    return texts.select("video_id", words("value").alias("args")).orderBy("video_id")
